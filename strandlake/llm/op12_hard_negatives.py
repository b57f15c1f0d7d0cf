"""Query op12_hard_negatives."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives
from .common import read_table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 50, among all rows of embeddings; labels of rows whose vec_id is
    divisible by 7 are moved on by one first. See hard_negatives.mine for nulls, repeated rows and the empty table."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH vecs AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, cast(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vecs a JOIN vecs b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor, anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, cast(row_number() OVER w AS INTEGER) AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= 3"""
