"""Query op9_sharding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents, one row for each row: null and empty texts have size 8, repeated rows and null ids are records
    like others; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
