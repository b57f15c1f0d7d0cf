"""Query op1_packing."""

from pyspark.sql import DataFrame, SparkSession

from . import packing
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids. A null or empty text is one id; repeated rows and ids are documents of their
    own, null ids stay null; texts are cut at window ends, however long; an empty table gives no rows."""
    return packing.digest(packing.pack(read_table(spark, sf_dir, "documents")))
