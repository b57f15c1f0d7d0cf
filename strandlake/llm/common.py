"""What the operators of this subpackage share: session preparation, shared scratch tables, Arrow maps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so batches are kept small.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and get Arrow batches of at most BATCH_ROWS rows."""
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local one, in a local session only:
    on a cluster the executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            at = option.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        else:
            own = tempfile.mkdtemp(prefix="strandlake-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(own)
            at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


_written: list[list[str]] = []


@contextmanager
def scratch_tables() -> Iterator[list[str]]:
    """The paths of all tables that materialize() writes inside of the block; release them when nothing reads them any more."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        _written.pop()


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to a table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"
    for held in _written:
        held.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


#: Bits of the filter of likely_in(), 8 MB whatever the size of the tables.
FILTER_BITS = 1 << 26


def split_likely(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose value in column (long) is among those of ids, and few others; and all other rows. A filter of fixed size, which
    goes before a join and keeps large rows without a partner out of its shuffle. With very many ids most rows are in the first. Hint the
    join to shuffle: a broadcast one would leave this map and the next in one task, with a Python worker each."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    marks = ids.select(place(column).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marks.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (r["b"] - 1) * len(r["m"])
        bits[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)
    (key,) = fresh(df, "place")

    def side(inside: bool) -> DataFrame:
        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                p = batch.column(key).to_numpy() - 1
                seen = shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1
                return batch.filter(pa.array(seen.astype(bool) == inside)).drop_columns([key])

            return step

        return map_arrow(df.withColumn(key, place(column)), make, df.schema)

    return side(True), side(False)


def likely_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The first part of split_likely()."""
    return split_likely(df, ids, column)[0]


#: Bytes of texts of a sample to learn from, for each of its classes.
SAMPLE_BYTES = 64 << 20


def bounded_sample(rows: DataFrame, most: int, most_bytes: int = SAMPLE_BYTES, cost: F.Column | None = None) -> DataFrame:
    """(h, y, text) of rows (text, y): equal texts of a class once, at most `most` of each class and most_bytes of their costs (else
    their bytes); those with the smallest hashes come first, and texts that don't fit into what is left are left out."""
    t = rows.where("text IS NOT NULL").select("y", "text", F.xxhash64("text").alias("h"))
    thin = t.select("y", "h", (F.octet_length("text") if cost is None else cost).cast("long").alias("cost")).groupBy("y", "h").agg(F.max("cost").alias("cost"))
    chosen = []
    for y in sorted(r["y"] for r in thin.select("y").distinct().collect()):
        left = most_bytes
        for r in thin.where(F.col("y") == y).orderBy("h").limit(most).collect():  # two numbers a text
            if r["cost"] <= left:
                left -= r["cost"]
                chosen.append((y, r["h"]))
    kept = rows.sparkSession.createDataFrame(chosen, "y int, h long")
    return t.join(F.broadcast(kept), ["y", "h"]).dropDuplicates(["y", "h"])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, with as many underscores before them as keep them apart from df's columns."""
    taken, lead = {c.lower() for c in df.columns}, "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Arrow map; make() runs once in each task and returns the function for its batches."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def crc_of_id(id_col: str) -> F.Column:
    """CRC-32 of an id's decimal text; the splits of labelled rows are made with it."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
