"""Query op6_simhash_dedup."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents, one row for each row. Null, empty and wordless texts have fingerprint zero and are
    linked like others; repeated rows are kept; a null id is never a component's id, and a fingerprint that only null ids have gets
    component null; an empty table gives no rows."""
    fps, _ = materialize(simhash.fingerprints(read_table(spark, sf_dir, "documents")), "fingerprints")
    return simhash.near_duplicates(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
