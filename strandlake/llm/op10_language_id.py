"""Query op10_language_id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .common import crc_of_id, read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, one row for each row. Null texts and those without a letter are und with score 0; repeated rows and
    ids are kept and predicted alike; a null id is not learned from; whole texts count, however long; without a known language all are
    und; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    return language_id.predicted(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
