"""Query op5_toxicity."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import crc_of_id, read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, one row for each row. Null, empty and wordless texts get the score of no match; repeated rows and ids
    are kept and score alike; a null id is not learned from; without labels the fixed entries count; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
