"""Query op11_token_files."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import token_files
from .common import read_table, shared_dir


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the array of all ids, and the CRC-32 of its ids, read back from files that this call writes to a
    new folder in the shared one and leaves there. A null or empty text is one id; repeated rows are documents of their own; null
    ids come first and stay null; an empty table gives no rows."""
    path = f"{shared_dir(spark)}/strandlake/token-files-{uuid.uuid4().hex}"
    token_files.write(read_table(spark, sf_dir, "documents"), path)
    return token_files.digest(spark, path)
