"""Query op4_decontamination."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents, one row for each row. Null and wordless texts have no words, so n_hit is 0; repeated rows and ids are
    kept; whole texts are scanned, however long; without items nothing is hit; an empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.judged(decontamination.scan(docs, read_table(spark, sf_dir, "benchmark")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0
),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM p),
q AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
),
h AS (SELECT q.doc_id, q.i, q.n, g.item_id FROM q JOIN g ON q.n = g.n AND array_to_string(q.w[q.i:q.i + q.n - 1], ' ') = g.s),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
