"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns
of `documents`. A document with a null text passes the filters as an empty one. Texts are read whole, however long; rows that are
equal in doc_id and text count once from the second stage on; rows of one doc_id with unlike texts are judged each on its own;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontamination, packing, simhash, substring_dedup, toxicity
from strandlake.llm.common import fresh, materialize, read_table, release, scratch_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.5. Null and empty texts have none; rows and ids are kept as they are, repeated ones too."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.scored(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest doc_id.

    Rows that are equal in doc_id and text become one; of a doc_id with several texts each text is judged on its own, and those in
    one component stay together as one document. Documents without a word are copies of one another. Rows without a doc_id stay.
    """
    fps, _ = materialize(simhash.fingerprints(docs.where("doc_id is not null"), tid=True), "fingerprints")
    key, tid = fresh(docs, "gone", "tid")
    gone = simhash.near_duplicates(fps).where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("tid").alias(tid)).distinct()
    # one shuffle by the same two columns for both the join and the repeated rows
    known = docs.where("doc_id is not null").withColumn(key, F.col("doc_id").cast("long")).withColumn(tid, F.xxhash64("text"))
    stay = known.join(gone, [key, tid], "left_anti").dropDuplicates([key, tid]).drop(key, tid)
    return stay.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id keeps; n_chars is counted anew. A document of which nothing
    is left goes; null and empty texts stay as they are."""
    left = substring_dedup.deduplicate(docs)
    return left.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 stands in a benchmark window."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # apart from the operator's own columns
    text = inner[docs.columns.index("text")]
    found = decontamination.judged(decontamination.scan(docs.toDF(*inner), read_table(spark, sf_dir, "benchmark"), text_col=text))
    return found.where("not contaminated").select(*[F.col(c).alias(n) for c, n in zip(inner, docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows of 1024 tokens; a null or empty text is a document of one token, and repeated ids are documents
    of their own."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The models and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages leave of documents. A stage's scratch tables, and the table that it reads, are deleted once its
    own table is written; those of the last stage, which is read later, stay until the folder is cleaned."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_tables() as made:
            docs, new = materialize(stage(spark, docs, sf_dir), name)
        release(spark, *[p for p in made if p != new], *[path] * (path is not None))
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
