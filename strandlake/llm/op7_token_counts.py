"""Query op7_token_counts."""

from pyspark.sql import DataFrame, SparkSession

from . import token_counts
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of all documents, one row for each row. Null and empty texts count 0; repeated rows and ids are kept; whole
    texts count, however long; an empty table gives no rows."""
    return token_counts.counted(read_table(spark, sf_dir, "documents"))
