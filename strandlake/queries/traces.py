"""Queries that align signals: the events of a user on a day, in order, are one signal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.fixtures import table
from strandlake.operators import signals

QUERIES, SQL = {}, {}
REFERENCES = {f"g{g}": np.array([(k * s + 7 * g) % 41 for k in range(n)], float) for g, (s, n) in enumerate([(11, 12), (5, 9), (17, 7), (1, 10)])}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _signals(spark, sf):
    """(id, samples, types), the samples of a user and day in the order of time."""
    ev = table(spark, sf, "events").select((F.col("user_id") * 100_000 + F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).cast("long").alias("id"), "ts", "event_id", F.col("value").cast("double").alias("v"), "event_type")
    rows = ev.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "v", "event_type"))).alias("x"))
    return rows.select("id", F.transform("x", lambda x: x["v"]).alias("samples"), F.transform("x", lambda x: x["event_type"]).alias("types"))


_REFS = ", ".join(f"('{g}', [{', '.join(map(str, r.tolist()))}]::DOUBLE[])" for g, r in REFERENCES.items())
#: The cost tables, cell by cell: cell (i, j) stands at i * n + j + 1 of c.
_TABLES = f"""WITH RECURSIVE s AS (
  SELECT user_id * 100000 + date_diff('day', DATE '2024-01-01', cast(ts AS DATE)) AS id, list(cast(value AS DOUBLE) ORDER BY ts, event_id) AS x,
    list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY 1),
refs AS (SELECT gene, r, len(r) AS n FROM (VALUES {_REFS}) v(gene, r)),
cut AS (SELECT id, x FROM s),
t AS (
  SELECT id, gene, x, r, len(x) AS m, n, 0 AS k, []::DOUBLE[] AS c FROM cut, refs WHERE len(x) > 0
  UNION ALL
  SELECT id, gene, x, r, m, n, k + 1, list_append(c, (x[k // n + 1] - r[k % n + 1]) * (x[k // n + 1] - r[k % n + 1]) +
    CASE WHEN k < n THEN 0 WHEN k % n = 0 THEN c[k - n + 1] ELSE least(c[k - n], c[k - n + 1], c[k]) END)
  FROM t WHERE k < m * n),
full_table AS (SELECT id, gene, m, n, c, list_min(c[(m - 1) * n + 1 : m * n]) AS cost FROM t WHERE k = m * n),
ends AS (SELECT *, list_position(c[(m - 1) * n + 1 : m * n], cost) - 1 AS last FROM full_table),
back AS (
  SELECT id, gene, n, c, cost, m - 1 AS i, last AS j, last, 0 AS step FROM ends
  UNION ALL
  SELECT id, gene, n, c, cost,
    CASE WHEN j = 0 OR c[i * n + j] >= least(c[(i - 1) * n + j], c[(i - 1) * n + j + 1]) THEN i - 1 ELSE i END,
    CASE WHEN j = 0 THEN j WHEN c[(i - 1) * n + j] <= least(c[(i - 1) * n + j + 1], c[i * n + j]) THEN j - 1 WHEN c[(i - 1) * n + j + 1] <= c[i * n + j] THEN j ELSE j - 1 END,
    last, step + 1
  FROM back WHERE i > 0)"""


@query("signal_paths", _TABLES + """
SELECT id, gene AS reference, cast(max(step) OVER (PARTITION BY id, gene) - step AS INTEGER) AS step, cast(i AS INTEGER) AS sample, cast(j AS INTEGER) AS place FROM back""")
def signal_paths(spark, sf):
    """The warping path of every signal on every reference, one row for a step."""
    found = signals.align(_signals(spark, sf), REFERENCES, normalise=False, with_path=True)
    return found.select("id", "reference", F.posexplode("path").alias("step", "p")).select("id", "reference", "step", "p.sample", "p.place")


_CUT = _TABLES.replace("cut AS (SELECT id, x FROM s)", "reads AS (SELECT id, types[1] <> 'click' AS success, CASE WHEN list_position(types, 'error') > 0 THEN x[1 : list_position(types, 'error') - 1] ELSE x END AS x FROM s),\ncut AS (SELECT id, x FROM reads WHERE success)")


@query("signal_reads", _CUT + """,
aligned AS (SELECT id, gene, sqrt(cost) AS score, last - j AS query_align_len FROM back WHERE i = 0)
SELECT r.id AS read_id, len(x) > 0 AND success AS success_align, w.gene AS ref_gene, round(score, 6) AS score, cast(query_align_len AS BIGINT) AS query_align_len, round(score / nullif(len(x), 0), 6) AS norm_score
FROM reads r LEFT JOIN (SELECT * FROM (VALUES ('g0'), ('g2'), ('unknown')) v(gene)) w ON r.success LEFT JOIN aligned a ON a.id = r.id AND a.gene = w.gene AND r.success""")
def signal_reads(spark, sf):
    """Signals cut at the first error, for two genes and one without a signal; days that start with a click have failed."""
    s = _signals(spark, sf)
    at = F.nullif(F.array_position("types", F.lit("error")), F.lit(0).cast("long"))
    reads = s.select(F.col("id").alias("read_id"), "samples", (at - 1).cast("int").alias("index_of_adapter"), (F.col("types")[0] != "click").alias("success"))
    found = signals.align_reads(reads, REFERENCES, ["g0", "g2", "unknown"], normalise=False)
    return found.select("read_id", "success_align", "ref_gene", F.round("score", 6).alias("score"), "query_align_len", F.round("norm_score", 6).alias("norm_score"))


@query("signal_nearest", _TABLES + """
SELECT id, gene AS reference, cast(last AS BIGINT) AS last, round(sqrt(cost), 6) AS distance FROM ends
QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, gene) = 1""")
def signal_nearest(spark, sf):
    """Every signal's nearest reference, found by bounds."""
    return signals.nearest_reference(_signals(spark, sf), REFERENCES, normalise=False).select("id", "reference", "last", F.round("distance", 6).alias("distance"))
