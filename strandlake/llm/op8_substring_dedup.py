"""Query op8_substring_dedup: one row for each passage that goes."""

from pyspark.sql import DataFrame, SparkSession

from . import substring_dedup
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that go, with their words' places and the documents that keep them. Null ids and null, empty or wordless texts lose
    nothing; rows of one doc_id are one document; whole texts take part, however long; an empty table gives no rows."""
    found = substring_dedup.removals(read_table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "inline(spans)").selectExpr("doc_id", "kept_in", "cast(first as long) first_word", "n_words")
