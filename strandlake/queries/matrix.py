"""Queries over the read x position matrix: filters, profiles, samples, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.fixtures import EMBEDDING_SQL, L_EMBEDDING, L_ORDER, ORDER_SQL, embedding_mods, embedding_reads, order_mods, order_reads
from strandlake.operators import filters, neighbours, relational

QUERIES, SQL = {}, {}


def r6(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _order(body: str) -> str:
    return f"WITH {ORDER_SQL}{body}"


def _emb(body: str) -> str:
    return f"WITH {EMBEDDING_SQL}{body}"


_COUNTS = """,
counts AS (SELECT r.read_id, r.cond, r.length, cast(count(m.pos) AS BIGINT) AS n_mods FROM reads r LEFT JOIN mods m ON r.read_id = m.read_id GROUP BY ALL)"""
_KEPT = _COUNTS + """,
kept AS (SELECT *, cast(n_mods AS DOUBLE) / 200 AS rate FROM counts WHERE cast(n_mods AS DOUBLE) / 200 > cast(0.0075 AS DOUBLE) AND cast(n_mods AS DOUBLE) / 200 < cast(0.025 AS DOUBLE))"""
_RATES = """,
spine AS (SELECT cast(unnest(range(0, 200)) AS BIGINT) AS pos),
rates AS (
  SELECT s.pos, cast(count(m.pos) AS BIGINT) AS n_mods, cast(count(m.pos) AS DOUBLE) / (SELECT count(*) FROM reads) AS rate
  FROM spine s LEFT JOIN (SELECT mods.* FROM mods SEMI JOIN reads ON mods.read_id = reads.read_id) m ON s.pos = m.pos GROUP BY s.pos)"""


@query("read_modrate_filter", _order(_KEPT + " SELECT read_id, cond, n_mods, round(rate, 6) AS rate FROM kept"))
def read_modrate_filter(spark, sf):
    return filters.filter_reads_by_rate(order_reads(spark, sf), order_mods(spark, sf), L_ORDER).select("read_id", "cond", "n_mods", r6("rate"))


@query("length_filter", _order(" SELECT read_id, length FROM reads WHERE length >= 160"))
def length_filter(spark, sf):
    return filters.filter_reads_by_length(order_reads(spark, sf), L_ORDER, 0.8).select("read_id", "length")


@query("minimum_filter", _order(_COUNTS + " SELECT read_id, n_mods FROM counts WHERE n_mods >= 1"))
def minimum_filter(spark, sf):
    return filters.with_minimum(order_reads(spark, sf), order_mods(spark, sf)).select("read_id", "n_mods")


@query("position_rates", _order(_RATES + " SELECT pos, n_mods, round(rate, 6) AS rate, rate > cast(0.02 AS DOUBLE) AND rate < 1.0 AS kept FROM rates"))
def position_rates(spark, sf):
    rates = filters.position_rates(order_reads(spark, sf), order_mods(spark, sf), L_ORDER)
    return filters.kept_positions(rates, 0.02, 1.0).select("pos", "n_mods", r6("rate"), "kept")


@query("position_modrate_zeroed", _order(_RATES + " SELECT m.read_id, m.pos FROM mods m JOIN rates r ON m.pos = r.pos WHERE r.rate > cast(0.02 AS DOUBLE) AND r.rate < 1.0"))
def position_modrate_zeroed(spark, sf):
    mods = order_mods(spark, sf)
    return filters.zero_positions(mods, filters.position_rates(order_reads(spark, sf), mods, L_ORDER), 0.02, 1.0).select("read_id", "pos")


@query("retained_positions", _order(" SELECT pos, cast(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS new_pos FROM (SELECT DISTINCT pos FROM mods)"))
def retained_positions(spark, sf):
    return filters.retained_positions(order_mods(spark, sf))


_PROFILE = """,
sizes AS (SELECT cond, count(*) AS n FROM reads GROUP BY cond),
spine AS (SELECT cond, n, cast(unnest(range(0, 200)) AS BIGINT) AS pos FROM sizes),
hits AS (SELECT cond, pos, count(*) AS c FROM mods JOIN reads ON mods.read_id = reads.read_id GROUP BY ALL),
profile AS (SELECT s.cond, s.pos, coalesce(h.c, 0) / s.n AS rate FROM spine s LEFT JOIN hits h ON s.cond = h.cond AND s.pos = h.pos)"""


@query("profile_by_condition", _order(_PROFILE + " SELECT cond, pos, round(rate, 6) AS rate FROM profile"))
def profile_by_condition(spark, sf):
    return filters.profile(order_reads(spark, sf), order_mods(spark, sf), L_ORDER).select("cond", "pos", r6("rate"))


@query("filtered_profile", f"WITH {ORDER_SQL}{_KEPT}, few AS (SELECT read_id, cond FROM kept)" + _PROFILE.replace("FROM reads", "FROM few").replace("JOIN reads ON mods.read_id = reads.read_id", "JOIN few ON mods.read_id = few.read_id") + " SELECT cond, pos, round(rate, 6) AS rate FROM profile")
def filtered_profile(spark, sf):
    reads, mods = order_reads(spark, sf), order_mods(spark, sf)
    return filters.profile(filters.filter_reads_by_rate(reads, mods, L_ORDER), mods, L_ORDER).select("cond", "pos", r6("rate"))


@query("global_modrate", _order(_COUNTS + " SELECT cond, cast(count(*) AS BIGINT) AS n_reads, round(cast(sum(n_mods) AS DOUBLE) * 100 / (count(*) * 200), 6) AS percent FROM counts GROUP BY cond"))
def global_modrate(spark, sf):
    return filters.global_rate(order_reads(spark, sf), order_mods(spark, sf), L_ORDER).select("cond", "n_reads", r6("percent"))


@query("mods_per_read_hist", _order(_COUNTS + ", h AS (SELECT n_mods, count(*) AS n FROM counts GROUP BY n_mods), s AS (SELECT cast(unnest(range(0, (SELECT max(n_mods) FROM counts) + 1)) AS BIGINT) AS n_mods) SELECT s.n_mods, cast(coalesce(h.n, 0) AS BIGINT) AS n_reads FROM s LEFT JOIN h ON s.n_mods = h.n_mods"))
def mods_per_read_hist(spark, sf):
    return filters.mods_histogram(order_reads(spark, sf), order_mods(spark, sf))


@query("filter_by_dist", _order(", g AS (SELECT read_id, pos - lag(pos, 1, 0) OVER (PARTITION BY read_id ORDER BY pos) AS gap FROM mods) SELECT read_id FROM reads WHERE read_id NOT IN (SELECT read_id FROM g WHERE gap < 4)"))
def filter_by_dist(spark, sf):
    return filters.filter_reads_by_distance(order_reads(spark, sf), order_mods(spark, sf)).select("read_id")


@query(
    "impute_by_dist",
    f"""WITH RECURSIVE {EMBEDDING_SQL},
o AS (SELECT read_id, pos, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS n FROM mods),
k(read_id, n, held, pos, kept) AS (
  SELECT read_id, cast(0 AS BIGINT), cast(0 AS BIGINT), cast(-1 AS BIGINT), false FROM (SELECT DISTINCT read_id FROM mods)
  UNION ALL
  SELECT o.read_id, o.n, CASE WHEN o.pos - k.held >= 4 THEN o.pos ELSE k.held END, o.pos, o.pos - k.held >= 4
  FROM k JOIN o ON o.read_id = k.read_id AND o.n = k.n + 1)
SELECT read_id, pos FROM k WHERE kept""",
)
def impute_by_dist(spark, sf):
    return filters.thin_by_distance(embedding_mods(spark, sf))


@query("collapse_bins", _order(" SELECT DISTINCT read_id, cast((pos // 5) * 5 AS BIGINT) AS pos FROM mods WHERE pos // 5 < 35"))
def collapse_bins(spark, sf):
    return filters.collapse_positions(order_mods(spark, sf), L_ORDER)


@query("depth_limit", _order(", c AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM reads GROUP BY cond)), o AS (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY read_id) AS i FROM reads) SELECT read_id, cond FROM o, c WHERE i <= c.n"))
def depth_limit(spark, sf):
    return filters.first_reads(order_reads(spark, sf), -1).select("read_id", "cond")


_SAMPLED = _KEPT + """,
least AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM kept GROUP BY cond)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY md5(concat(cast(read_id AS VARCHAR), '|386')), read_id) AS i FROM kept)"""


@query("downsample_equal", _order(_SAMPLED + " SELECT read_id, cond FROM ranked, least WHERE i <= least.n"))
def downsample_equal(spark, sf):
    kept = filters.filter_reads_by_rate(order_reads(spark, sf), order_mods(spark, sf), L_ORDER)
    return filters.downsample(kept, filters.equal_quota(kept)).select("read_id", "cond")


@query("downsample_prop", _order(_SAMPLED + " SELECT read_id, cond FROM ranked, least WHERE i <= CASE WHEN cond = 0 THEN cast(floor(2 * least.n * cast(0.3 AS DOUBLE)) AS BIGINT) ELSE 2 * least.n - cast(floor(2 * least.n * cast(0.3 AS DOUBLE)) AS BIGINT) END"))
def downsample_prop(spark, sf):
    kept = filters.filter_reads_by_rate(order_reads(spark, sf), order_mods(spark, sf), L_ORDER)
    return filters.downsample(kept, filters.equal_quota(kept, share=0.3)).select("read_id", "cond")


@query("union_conditions", _order(" SELECT m.read_id, m.pos, 'WT' AS sample FROM mods m JOIN reads r ON m.read_id = r.read_id WHERE cond = 0 UNION ALL SELECT m.read_id, m.pos, 'MT' AS sample FROM mods m JOIN reads r ON m.read_id = r.read_id WHERE cond = 1"))
def union_conditions(spark, sf):
    reads, mods = order_reads(spark, sf), order_mods(spark, sf)
    parts = [mods.join(reads.where(F.col("cond") == k), "read_id", "left_semi").select("read_id", "pos", F.lit(s).alias("sample")) for k, s in ((0, "WT"), (1, "MT"))]
    return parts[0].unionByName(parts[1])


@query("column_window_slice", _order(" SELECT read_id, pos FROM mods WHERE pos >= 50 AND pos < 150"))
def column_window_slice(spark, sf):
    return order_mods(spark, sf).where("pos >= 50 AND pos < 150")


@query("project_to_original", _order(_KEPT + " SELECT m.read_id, m.pos FROM mods m SEMI JOIN kept k ON m.read_id = k.read_id"))
def project_to_original(spark, sf):
    mods = order_mods(spark, sf)
    return relational.project(mods, filters.filter_reads_by_rate(order_reads(spark, sf), mods, L_ORDER)).select("read_id", "pos")


@query("anti_unassigned", _order(_KEPT + " SELECT read_id, cond FROM reads ANTI JOIN kept USING (read_id)"))
def anti_unassigned(spark, sf):
    reads = order_reads(spark, sf)
    return relational.unassigned(reads, filters.filter_reads_by_rate(reads, order_mods(spark, sf), L_ORDER)).select("read_id", "cond")


_EDGES = ", e AS (SELECT x.read_id AS a, y.read_id AS b, cast(count(*) AS BIGINT) AS score FROM mods x JOIN mods y ON x.pos = y.pos AND x.read_id < y.read_id GROUP BY ALL)"


@query("shared_mod_edges", _emb(_EDGES + " SELECT a, b, score FROM e WHERE score >= 3"))
def shared_mod_edges(spark, sf):
    return relational.shared_edges(embedding_mods(spark, sf), 3)


@query("cooccurrence_pairs", _emb(" SELECT x.pos AS i, y.pos AS j, cast(count(*) AS BIGINT) AS n11 FROM mods x JOIN mods y ON x.read_id = y.read_id AND x.pos <= y.pos GROUP BY ALL"))
def cooccurrence_pairs(spark, sf):
    return relational.cooccurrence(embedding_mods(spark, sf))


@query("cooccurrence_window", _order(" SELECT x.pos AS i, y.pos AS j, cast(count(*) AS BIGINT) AS n11 FROM mods x JOIN mods y ON x.read_id = y.read_id AND x.pos <= y.pos AND y.pos - x.pos < 100 GROUP BY ALL"))
def cooccurrence_window(spark, sf):
    return relational.cooccurrence(order_mods(spark, sf), 100)


_PAIRS = _EDGES + """,
n AS (SELECT read_id, count(*) AS n FROM mods GROUP BY read_id),
s AS (SELECT a, b, score, x.n + y.n - 2 * score AS l1, 1 - (x.n + y.n - 2 * score) / 64.0::DOUBLE AS similarity, score / (x.n + y.n - score) AS jaccard FROM e JOIN n x ON a = x.read_id JOIN n y ON b = y.read_id)"""


@query("pairwise_similarity", _emb(_PAIRS + " SELECT a, b, score AS shared, cast(l1 AS BIGINT) AS l1, round(similarity, 6) AS similarity, round(jaccard, 6) AS jaccard FROM s"))
def pairwise_similarity(spark, sf):
    return relational.pair_similarity(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING).select("a", "b", "shared", "l1", r6("similarity"), r6("jaccard"))


@query("similarity_summary", _emb(_PAIRS + " SELECT round(min(similarity), 6) AS least, round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.5), 6) AS median, round(max(similarity), 6) AS largest FROM s WHERE similarity <> 1"))
def similarity_summary(spark, sf):
    t = relational.similarity_summary(relational.pair_similarity(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING))
    return t.select(*[r6(c) for c in ("least", "mean", "median", "largest")])


@query("knn_graph", _emb(_PAIRS + ", b2 AS (SELECT a, b, jaccard FROM s UNION ALL SELECT b, a, jaccard FROM s), k AS (SELECT a, b, jaccard, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS rank FROM b2) SELECT a, cast(rank AS BIGINT) AS rank, b, round(jaccard, 6) AS jaccard FROM k WHERE rank <= 90"))
def knn_graph(spark, sf):
    return neighbours.nearest_by_jaccard(embedding_reads(spark, sf), embedding_mods(spark, sf)).select("a", "rank", "b", r6("jaccard"))


@query(
    "chisq_pairs",
    _emb(
        """,
c AS (SELECT pos, count(*) AS c FROM mods GROUP BY pos), p AS (SELECT cast(unnest(range(0, 64)) AS BIGINT) AS pos), pc AS (SELECT p.pos, coalesce(c.c, 0) AS c FROM p LEFT JOIN c ON p.pos = c.pos),
n AS (SELECT cast(count(*) AS DOUBLE) AS n FROM reads),
j AS (SELECT x.pos AS i, y.pos AS j, count(*) AS n11 FROM mods x JOIN mods y ON x.read_id = y.read_id AND x.pos < y.pos GROUP BY ALL),
t AS (SELECT x.pos AS i, y.pos AS j, x.c AS ci, y.c AS cj, n.n, coalesce(j.n11, 0) AS n11 FROM pc x JOIN pc y ON x.pos < y.pos CROSS JOIN n LEFT JOIN j ON j.i = x.pos AND j.j = y.pos),
u AS (SELECT *, ci - n11 AS n10, cj - n11 AS n01, n - ci - cj + n11 AS n00, ci * cj / n AS e11, ci * (n - cj) / n AS e10, (n - ci) * cj / n AS e01, (n - ci) * (n - cj) / n AS e00 FROM t)
SELECT i, j, cast(n11 AS BIGINT) AS n11, cast(n10 AS BIGINT) AS n10, cast(n01 AS BIGINT) AS n01, cast(n00 AS BIGINT) AS n00,
  round(pow(abs(n11 - e11) - least(0.5, abs(n11 - e11)), 2) / nullif(e11, 0) + pow(abs(n10 - e10) - least(0.5, abs(n10 - e10)), 2) / nullif(e10, 0)
    + pow(abs(n01 - e01) - least(0.5, abs(n01 - e01)), 2) / nullif(e01, 0) + pow(abs(n00 - e00) - least(0.5, abs(n00 - e00)), 2) / nullif(e00, 0), 6) + 0.0 AS chi2,
  round(log2((n11 + 1e-100) / (e11 + 1e-100)), 6) + 0.0 AS log2_oe
FROM u"""
    ),
)
def chisq_pairs(spark, sf):
    t = relational.chi_square_pairs(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING)
    return t.select("i", "j", "n11", "n10", "n01", "n00", r6("chi2"), r6("log2_oe"))


@query("dedup_abundance", _order(", l AS (SELECT read_id, string_agg(cast(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM mods GROUP BY read_id) SELECT coalesce(l.positions, '') AS positions, cast(count(*) AS BIGINT) AS n_reads, min(r.read_id) AS first_read FROM reads r LEFT JOIN l ON r.read_id = l.read_id GROUP BY 1"))
def dedup_abundance(spark, sf):
    return relational.abundance(order_reads(spark, sf), order_mods(spark, sf))


@query("predicted_counts", _emb(" SELECT label AS cluster, pos, cast(count(*) AS BIGINT) AS n FROM mods JOIN reads ON mods.read_id = reads.read_id GROUP BY ALL"))
def predicted_counts(spark, sf):
    return relational.group_counts(embedding_reads(spark, sf).select("read_id", F.col("label").alias("cluster")), embedding_mods(spark, sf))


@query(
    "medoid_by_counts",
    _emb(
        """,
pairs AS (
  SELECT a.label, a.read_id, sum((SELECT count(*) FROM (SELECT 1)) * 0 + x.na + y.nb - 2 * coalesce(s.c, 0)) AS distance
  FROM reads a JOIN reads b ON a.label = b.label
  JOIN (SELECT r.read_id, count(m.pos) AS na FROM reads r LEFT JOIN mods m ON r.read_id = m.read_id GROUP BY 1) x ON x.read_id = a.read_id
  JOIN (SELECT r.read_id, count(m.pos) AS nb FROM reads r LEFT JOIN mods m ON r.read_id = m.read_id GROUP BY 1) y ON y.read_id = b.read_id
  LEFT JOIN (SELECT p.read_id AS i, q.read_id AS j, count(*) AS c FROM mods p JOIN mods q ON p.pos = q.pos GROUP BY ALL) s ON s.i = a.read_id AND s.j = b.read_id
  GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, read_id) AS k FROM pairs)
SELECT label AS cluster, read_id, cast(distance AS BIGINT) AS distance FROM o WHERE k = 1""".replace("(SELECT count(*) FROM (SELECT 1)) * 0 + ", "")
    ),
)
def medoid_by_counts(spark, sf):
    return relational.medoids(embedding_reads(spark, sf).select("read_id", F.col("label").alias("cluster")), embedding_mods(spark, sf))
