"""Query op3_quality_classifier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_crf
from .common import crc_of_id, read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, one row for each row. Null, empty and wordless texts score 0; repeated rows and ids are kept and score
    alike; a null id is not held out nor learned from; without labels of both classes all other texts score 0.5; an empty table gives
    no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_crf.scored(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.3).cast("int").alias("predicted"),
    )
