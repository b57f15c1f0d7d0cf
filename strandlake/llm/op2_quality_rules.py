"""Query op2_quality_rules."""

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents, one row for each row. Null, empty and wordless texts fail the base; repeated rows and
    ids are kept and get equal verdicts; whole texts count, however long; an empty table gives no rows."""
    return quality_rules.judged(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes"
    )
