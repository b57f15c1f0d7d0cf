"""A folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a local folder, which only a local session can use."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        at = own.get()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        at = tempfile.mkdtemp(prefix="strandlake-")
    return f"{at.rstrip('/')}/strandlake/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none, or one whose writing was cut off, what make gives is written there first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
