"""Queries that evaluate clusters, fit mixtures, test windows, call regions, align signals and simulate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.fixtures import EMBEDDING_SQL, EVENT_SQL, L_EMBEDDING, L_ORDER, ORDER_SQL, bit_strings, embedding_mods, embedding_reads, event_profiles, order_mods, order_reads, order_sites, table
from strandlake.operators import clustering, communities, evaluate, filters, mixtures, nulls, regions, relational, shared_graph, signals, simulate, windows
from strandlake.plans import benchmark, heterogeneity, two_sample
from strandlake.queries.matrix import r6

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _emb(body: str) -> str:
    return f"WITH {EMBEDDING_SQL}{body}"


def _order(body: str) -> str:
    return f"WITH {ORDER_SQL}{body}"


def _assigned(spark, sf) -> DataFrame:
    """Reads with label as their cluster."""
    return embedding_reads(spark, sf).select("read_id", "cond", F.col("label").alias("cluster"))


# --- clusters and conditions ------------------------------------------------------------------------------------------

_PURITY = """,
base AS (SELECT cast(count(*) FILTER (cond = 0) AS DOUBLE) / count(*) AS base0, cast(count(*) FILTER (cond = 1) AS DOUBLE) / count(*) AS base1 FROM reads),
n AS (SELECT label AS cluster, cast(count(*) FILTER (cond = 0) AS BIGINT) AS n0, cast(count(*) FILTER (cond = 1) AS BIGINT) AS n1 FROM reads GROUP BY label),
ppv AS (SELECT *, cast(n0 AS DOUBLE) / (n0 + n1) AS ppv0, cast(n1 AS DOUBLE) / (n0 + n1) AS ppv1 FROM n, base),
purity AS (SELECT *, cast(CASE WHEN ppv1 - base1 > ppv0 - base0 THEN 1 ELSE 0 END AS BIGINT) AS best FROM ppv),
calls AS (SELECT *, CASE WHEN CASE WHEN best = 1 THEN ppv1 - base1 ELSE ppv0 - base0 END < cast(0.03 AS DOUBLE) THEN 'UN' WHEN best = 1 THEN 'MT' ELSE 'WT' END AS call FROM purity)"""


@query("cluster_ppv", _emb(_PURITY + " SELECT cluster, n0, n1, round(ppv0, 6) AS ppv0, round(ppv1, 6) AS ppv1, best, call FROM calls"))
def cluster_ppv(spark, sf):
    return evaluate.cluster_purity(_assigned(spark, sf), 0.03).select("cluster", "n0", "n1", r6("ppv0"), r6("ppv1"), "best", "call")


@query("flip_order", _emb(_PURITY + " SELECT cluster, best FROM purity"))
def flip_order(spark, sf):
    return evaluate.flip_order(_assigned(spark, sf))


@query("assignments_un", _emb(_PURITY + " SELECT read_id, cond, call FROM reads JOIN calls ON label = cluster"))
def assignments_un(spark, sf):
    return evaluate.called(_assigned(spark, sf), 0.03).select("read_id", "cond", "call")


@query("inferred_proportions", _emb(_PURITY + ", t AS (SELECT cond, best, count(*) AS n FROM reads JOIN purity ON label = cluster GROUP BY ALL) SELECT cond, best, cast(n AS BIGINT) AS n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY cond), 6) AS percent FROM t"))
def inferred_proportions(spark, sf):
    return evaluate.inferred_proportions(_assigned(spark, sf)).select("cond", "best", "n", r6("percent"))


@query(
    "split_unassigned",
    _emb(
        _PURITY
        + """,
a AS (SELECT read_id, cond, call FROM reads JOIN calls ON label = cluster),
s AS (SELECT cast(count(*) FILTER (cond = 0) AS DOUBLE) / count(*) AS share FROM a),
u AS (SELECT *, row_number() OVER (ORDER BY md5(concat(cast(read_id AS VARCHAR), '|386')), read_id) AS k, count(*) OVER () AS n FROM a WHERE call = 'UN')
SELECT read_id, call AS "group" FROM a WHERE call <> 'UN' UNION ALL SELECT read_id, CASE WHEN k <= floor(share * n) THEN 'WT' ELSE 'MT' END FROM u, s"""
    ),
)
def split_unassigned(spark, sf):
    return evaluate.split_unknown(evaluate.called(_assigned(spark, sf), 0.03)).select("read_id", "group")


def _labels(spark, sf) -> DataFrame:
    """truth: the label; cluster: the number of modifications, by fours."""
    reads = embedding_reads(spark, sf)
    n = filters.read_counts(reads, embedding_mods(spark, sf))
    return n.select("read_id", F.col("label").alias("truth"), F.floor(F.col("n_mods") / 4).alias("cluster"), (F.col("n_mods") % 2).cast("long").alias("odd"), "cond")


_LABELS = """,
c AS (SELECT r.read_id, r.label, r.cond, count(m.pos) AS n_mods FROM reads r LEFT JOIN mods m ON r.read_id = m.read_id GROUP BY ALL),
l AS (SELECT read_id, label AS truth, n_mods // 4 AS cluster, n_mods % 2 AS odd, cond FROM c),
t AS (SELECT truth, cast(cluster AS BIGINT) AS cluster, cast(count(*) AS BIGINT) AS n FROM l GROUP BY ALL)"""


@query("contingency", _emb(_LABELS + " SELECT truth, cluster, n FROM t"))
def contingency(spark, sf):
    return evaluate.contingency(_labels(spark, sf))


_AGREE = _LABELS + """,
s AS (
  SELECT (SELECT cast(sum(n) AS DOUBLE) FROM t) AS n, (SELECT sum(cast(n AS DOUBLE) * (n - 1) / 2) FROM t) AS c,
    (SELECT sum(cast(n AS DOUBLE) * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY truth)) AS a,
    (SELECT sum(cast(n AS DOUBLE) * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY cluster)) AS b),
p AS (SELECT *, n * (n - 1) / 2 AS p FROM s)"""


@query("agreement", _emb(_AGREE + " SELECT cast(n AS BIGINT) AS n, round((p + 2 * c - a - b) / p, 6) AS rand, round((c - a * b / p) / ((a + b) / 2 - a * b / p), 6) + 0.0 AS ari, round(c / sqrt(a * b), 6) AS fms FROM p"))
def agreement(spark, sf):
    return evaluate.agreement(evaluate.contingency(_labels(spark, sf))).select("n", r6("rand"), r6("ari"), r6("fms"))


@query("accuracy", _emb(_LABELS + ", h AS (SELECT avg(CASE WHEN odd = cond THEN 1.0::DOUBLE ELSE 0 END) AS h FROM l) SELECT round(greatest(h, 1 - h), 6) AS accuracy FROM h"))
def accuracy(spark, sf):
    return evaluate.accuracy(_labels(spark, sf), "cond", "odd").select(r6("accuracy"))


@query(
    "ami",
    _emb(
        _LABELS
        + """,
a AS (SELECT truth, cast(sum(n) AS BIGINT) AS a FROM t GROUP BY truth), b AS (SELECT cluster, cast(sum(n) AS BIGINT) AS b FROM t GROUP BY cluster),
z AS (SELECT cast(sum(n) AS DOUBLE) AS n FROM t),
h AS (SELECT (SELECT -sum(a / z.n * ln(a / z.n)) FROM a, z) AS ha, (SELECT -sum(b / z.n * ln(b / z.n)) FROM b, z) AS hb),
mi AS (SELECT sum(t.n / z.n * ln(z.n * t.n / (a * b))) AS mi FROM t JOIN a ON t.truth = a.truth JOIN b ON t.cluster = b.cluster, z),
k AS (SELECT a, b, z.n AS n, unnest(range(cast(greatest(1, a + b - z.n) AS BIGINT), least(a, b) + 1)) AS k FROM a, b, z),
e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e FROM k)
SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) + 0.0 AS ami FROM mi, e, h"""
    ),
)
def ami(spark, sf):
    return evaluate.mutual_information(evaluate.contingency(_labels(spark, sf))).select(r6("ami"))


_PROFILES = """,
size AS (SELECT label, cast(count(*) AS DOUBLE) AS n FROM reads GROUP BY label),
grid AS (SELECT label, n, cast(unnest(range(0, 64)) AS BIGINT) AS pos FROM size),
hit AS (SELECT label, pos, count(*) AS c FROM mods JOIN reads ON mods.read_id = reads.read_id GROUP BY ALL),
profile AS (SELECT g.label AS cluster, g.pos, coalesce(h.c, 0) / g.n AS rate FROM grid g LEFT JOIN hit h ON g.label = h.label AND g.pos = h.pos),
csize AS (SELECT cond, cast(count(*) AS DOUBLE) AS n FROM reads GROUP BY cond),
cgrid AS (SELECT cond, n, cast(unnest(range(0, 64)) AS BIGINT) AS pos FROM csize),
chit AS (SELECT cond, pos, count(*) AS c FROM mods JOIN reads ON mods.read_id = reads.read_id GROUP BY ALL),
cprofile AS (SELECT g.cond, g.pos, coalesce(h.c, 0) / g.n AS rate FROM cgrid g LEFT JOIN chit h ON g.cond = h.cond AND g.pos = h.pos)"""


def _profiles(spark, sf) -> DataFrame:
    return filters.profile(_assigned(spark, sf), embedding_mods(spark, sf), L_EMBEDDING, "cluster")


@query("profile_correlation", _emb(_PROFILES + " SELECT cluster, cond, round(corr(p.rate, c.rate), 6) AS r FROM profile p JOIN cprofile c ON p.pos = c.pos GROUP BY ALL"))
def profile_correlation(spark, sf):
    by_cond = filters.profile(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING, "cond")
    return evaluate.profile_correlation(_profiles(spark, sf), "cluster", by_cond, "cond").select("cluster", "cond", r6("r"))


_FACTOR = _PROFILES + ", f AS (SELECT greatest(1.5 * (quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25)), quantile_cont(rate, 0.9)) AS factor FROM profile)"


@query("norm_factor_reactivity", _emb(_FACTOR + " SELECT cluster, pos, round(rate, 6) AS rate, round(CASE WHEN rate < cast(0.08 AS DOUBLE) THEN -999 ELSE rate / factor END, 6) AS reactivity FROM profile, f"))
def norm_factor_reactivity(spark, sf):
    return evaluate.reactivities(_profiles(spark, sf), 0.08).select("cluster", "pos", r6("rate"), r6("reactivity"))


@query("mu_normalise_topn", _emb(_PROFILES + ", k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rate DESC, pos) AS k FROM profile), m AS (SELECT cluster, median(rate) AS m FROM k WHERE k <= 10 GROUP BY cluster) SELECT p.cluster, pos, round(least(1, rate / m), 3) AS norm FROM profile p JOIN m ON p.cluster = m.cluster"))
def mu_normalise_topn(spark, sf):
    return evaluate.capped_by_top(_profiles(spark, sf), "cluster", 10).select("cluster", "pos", "norm")


@query("cluster_scatter_r2", _emb(_PROFILES + ", b AS (SELECT p.cluster AS x, q.cluster AS y, p.rate AS rx, q.rate AS ry FROM profile p JOIN profile q ON p.pos = q.pos AND p.cluster < q.cluster WHERE p.rate > 0 AND q.rate > 0), s AS (SELECT x, y, rx / max(rx) OVER w AS rx, ry / max(ry) OVER w AS ry FROM b WINDOW w AS (PARTITION BY x, y)) SELECT x, y, cast(count(*) AS BIGINT) AS n, round(regr_slope(ry, rx), 6) + 0.0 AS slope, round(regr_r2(ry, rx), 6) + 0.0 AS r2 FROM s GROUP BY ALL"))
def cluster_scatter_r2(spark, sf):
    return evaluate.cluster_scatter(_profiles(spark, sf), "cluster").select("x", "y", "n", r6("slope"), r6("r2"))


# --- mixtures ---------------------------------------------------------------------------------------------------------

K = 2


def _sets(spark, sf) -> DataFrame:
    return mixtures.position_sets(embedding_reads(spark, sf), embedding_mods(spark, sf))


def _start() -> tuple[np.ndarray, np.ndarray]:
    return mixtures.hashed_start(K, L_EMBEDDING), np.full(K, 1 / K)


def _mu_rows(spark, mu: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, p, float(mu[k, p])) for k in range(mu.shape[0]) for p in range(mu.shape[1])], "cluster long, pos long, mu double").select("cluster", "pos", r6("mu"))


_EM0 = ", theta0 AS (SELECT k AS cluster, p AS pos, 0.02::DOUBLE + 0.2::DOUBLE * ((p * 31 + k * 17) % 97) / 97 AS mu, 0.5::DOUBLE AS pi FROM (SELECT cast(unnest(range(0, 2)) AS BIGINT) AS k), (SELECT cast(unnest(range(0, 64)) AS BIGINT) AS p))"


def _em(i: int, prior: str = "0", total: str = "0") -> str:
    """One round of EM from theta{i} to theta{i + 1}."""
    return f""",
c{i} AS (SELECT cluster, ln(any_value(pi)) + sum(ln(1 - mu + 1e-308)) AS const FROM theta{i} GROUP BY cluster),
s{i} AS (SELECT m.read_id, t.cluster, sum(ln(mu + 1e-308) - ln(1 - mu + 1e-308)) AS s FROM mods m JOIN theta{i} t ON m.pos = t.pos GROUP BY ALL),
l{i} AS (SELECT r.read_id, c.cluster, const + coalesce(s.s, 0) AS ll FROM reads r CROSS JOIN c{i} c LEFT JOIN s{i} s ON s.read_id = r.read_id AND s.cluster = c.cluster),
z{i} AS (SELECT l.*, m + ln(sum(exp(ll - m)) OVER (PARTITION BY read_id)) AS z FROM (SELECT *, max(ll) OVER (PARTITION BY read_id) AS m FROM l{i}) l),
p{i} AS (SELECT read_id, cluster, ll, exp(ll - z) AS post FROM z{i}),
n{i} AS (SELECT cluster, sum(post) AS n FROM p{i} GROUP BY cluster),
x{i} AS (SELECT p.cluster, m.pos, sum(p.post) AS x FROM mods m JOIN p{i} p ON m.read_id = p.read_id GROUP BY ALL),
theta{i + 1} AS (SELECT t.cluster, t.pos, (coalesce(x, 0) + {prior}) / (n + {total}) AS mu, n / (SELECT count(*) FROM reads) AS pi FROM theta{i} t JOIN n{i} n ON n.cluster = t.cluster LEFT JOIN x{i} x ON x.cluster = t.cluster AND x.pos = t.pos)"""


@query("bmm_em_step1", _emb(_EM0 + _em(0) + " SELECT cluster, pos, round(mu, 6) AS mu FROM theta1"))
def bmm_em_step1(spark, sf):
    mu, _ = mixtures.maximised(mixtures.em_pass(_sets(spark, sf), mixtures.Weights.of(*_start())))
    return _mu_rows(spark, mu)


@query("bmm_em_iter3", _emb(_EM0 + _em(0) + _em(1) + _em(2) + " SELECT cluster, pos, round(mu, 6) AS mu FROM theta3"))
def bmm_em_iter3(spark, sf):
    sets, (mu, pi) = _sets(spark, sf).cache(), _start()
    for _ in range(3):
        mu, pi = mixtures.maximised(mixtures.em_pass(sets, mixtures.Weights.of(mu, pi)))
    sets.unpersist()
    return _mu_rows(spark, mu)


@query("bmm_bic", _emb(_EM0 + _em(0) + ", q AS (SELECT sum(post * ll) AS ll, (SELECT count(*) FROM reads) AS n FROM p0) SELECT round(ll, 4) AS ll, round(ln(n) * 65 * 2 - 2 * ll, 4) AS bic FROM q"))
def bmm_bic(spark, sf):
    sets = _sets(spark, sf)
    ll = mixtures.em_pass(sets, mixtures.Weights.of(*_start())).complete
    n = sets.agg(F.sum("weight")).first()[0]
    return spark.createDataFrame([(round(ll, 4), round(mixtures.bic(n, K, L_EMBEDDING, ll), 4))], "ll double, bic double")


@query("bmm_predict", _emb(_EM0 + _em(0) + " SELECT read_id, arg_max(cluster, post) AS cluster, round(max(post), 6) AS post FROM p0 GROUP BY read_id"))
def bmm_predict(spark, sf):
    model = mixtures.Mixture(*_start(), 0.0, 0.0)
    found = two_sample.assignments(embedding_reads(spark, sf), embedding_mods(spark, sf), model)
    return found.select("read_id", "cluster", F.round(F.array_max("post"), 6).alias("post"))


@query("bmm_posterior_sums", _emb(" SELECT read_id, 1.0::DOUBLE AS total FROM reads"))
def bmm_posterior_sums(spark, sf):
    found = two_sample.assignments(embedding_reads(spark, sf), embedding_mods(spark, sf), mixtures.Mixture(*_start(), 0.0, 0.0))
    return found.select("read_id", F.round(F.aggregate("post", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_PRIOR = """,
q AS (SELECT (SELECT count(*) FROM reads) * 64.0::DOUBLE AS n, (SELECT count(*) FROM mods)::DOUBLE AS c),
q1 AS (SELECT *, (n + sqrt(n * n - 4 * c * (n - c))) / (2 * c) AS b0 FROM q),
q2 AS (SELECT *, ((b0 - c + n) + sqrt((b0 * c + n) * (b0 * c + n) + 4 * c * (c - n) * b0)) / (2 * (n - c)) AS a0 FROM q1),
q3 AS (SELECT *, (n - c) * a0 + c AS x FROM q2),
q4 AS (SELECT *, (x + sqrt(x * x - 4 * c * (n - c) * a0)) / (2 * c) AS beta FROM q3),
q5 AS (SELECT *, c * beta + n AS y FROM q4),
prior AS (SELECT beta, (y + sqrt(y * y + 4 * c * beta * (c - n))) / (2 * (n - c)) AS alpha FROM q5)"""


def _prior(spark, sf) -> tuple[float, float]:
    n, ones = _sets(spark, sf).agg(F.sum("weight"), F.sum(F.col("weight") * F.size("p"))).first()
    return mixtures.beta_prior(n * L_EMBEDDING, ones)


@query("hbbmm_prior", _emb(_PRIOR + " SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM prior"))
def hbbmm_prior(spark, sf):
    a, b = _prior(spark, sf)
    return spark.createDataFrame([(a, b)], "alpha double, beta double").select(r6("alpha"), r6("beta"))


@query("hbbmm_step1", _emb(_EM0 + _PRIOR + _em(0, "(SELECT alpha FROM prior) - 1", "(SELECT alpha + beta FROM prior) - 2") + " SELECT cluster, pos, round(least(1, greatest(0, mu)), 6) AS mu FROM theta1"))
def hbbmm_step1(spark, sf):
    mu, _ = mixtures.maximised(mixtures.em_pass(_sets(spark, sf), mixtures.Weights.of(*_start())), _prior(spark, sf))
    return _mu_rows(spark, mu)


@query(
    "spaced_probability",
    f"""WITH RECURSIVE {EMBEDDING_SQL.strip()},
mu AS (SELECT p, coalesce(n, 0) / (SELECT count(*) FROM reads) AS mu FROM (SELECT cast(unnest(range(0, 70)) AS BIGINT) AS p) LEFT JOIN (SELECT pos, count(*) AS n FROM mods GROUP BY pos) ON pos = p),
d(i, d1, d2, d3, d4) AS (
  SELECT cast(64 AS BIGINT), 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i - 1, (1 - m.mu) * d1 + m.mu * (SELECT coalesce(product(1 - q.mu), 1) FROM mu q WHERE q.p BETWEEN i AND least(63, i + 2)) * d4, d1, d2, d3
  FROM d JOIN mu m ON m.p = d.i - 1 WHERE i > 0)
SELECT i AS pos, round(d1, 6) AS d FROM d WHERE i < 64""",
)
def spaced_probability(spark, sf):
    """For the rates of all reads together."""
    rates = filters.position_rates(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING).orderBy("pos").collect()
    d = mixtures.spaced_probability(np.array([r["rate"] for r in rates]))
    return spark.createDataFrame([(i, float(d[i])) for i in range(L_EMBEDDING)], "pos long, d double").select("pos", r6("d"))


_EM100 = ", theta100 AS (SELECT cluster, pos, 0.02::DOUBLE + 0.2::DOUBLE * ((pos * 53 + cluster * 29) % 89) / 89 AS mu, 0.5::DOUBLE AS pi FROM theta0)"
_RUNS = "".join(_em(i) for i in range(6)) + _em(100) + "".join(_em(i) for i in range(101, 106))


@query("bmm_restarts", _emb(_EM0 + _EM100 + _RUNS + """, b AS (
  SELECT 0 AS run, round(ln((SELECT count(*) FROM reads)) * 65 * 2 - 2 * sum(post * ll), 4) AS bic FROM p5 UNION ALL
  SELECT 1, round(ln((SELECT count(*) FROM reads)) * 65 * 2 - 2 * sum(post * ll), 4) FROM p105)
SELECT t.cluster, t.pos, round(mu, 6) AS mu, b.run, bic FROM (SELECT *, 0 AS run FROM theta6 UNION ALL SELECT *, 1 FROM theta106) t JOIN (SELECT * FROM b ORDER BY bic LIMIT 1) b ON b.run = t.run"""))
def bmm_restarts(spark, sf):
    """The better of two runs of six rounds, which take their passes together."""
    p, k = np.arange(L_EMBEDDING)[None, :], np.arange(K)[:, None]
    starts = [mixtures.hashed_start(K, L_EMBEDDING), 0.02 + 0.2 * ((p * 53 + k * 29) % 89) / 89]
    each = [mixtures.fit(_sets(spark, sf), K, L_EMBEDDING, min_iters=6, max_iters=6, starts=[x]).bic for x in starts]
    best = mixtures.fit(_sets(spark, sf), K, L_EMBEDDING, min_iters=6, max_iters=6, starts=starts)
    run = int(np.argmin(each))
    return _mu_rows(spark, best.mu).select("cluster", "pos", "mu", F.lit(run).alias("run"), F.lit(round(best.bic, 4)).alias("bic"))


@query("bmm_fit")
def bmm_fit(spark, sf):
    m = mixtures.fit(_sets(spark, sf), 3, L_EMBEDDING)
    return _mu_rows(spark, m.mu)


@query("hbbmm_fit")
def hbbmm_fit(spark, sf):
    m = mixtures.fit(_sets(spark, sf), 2, L_EMBEDDING, hierarchical=True)
    return _mu_rows(spark, m.mu)


@query("bmm_vi")
def bmm_vi(spark, sf):
    m = mixtures.fit_variational(_sets(spark, sf), 3, L_EMBEDDING)
    return _mu_rows(spark, m.mu)


@query("spaced_em_fit")
def spaced_em_fit(spark, sf):
    """EM over the reads without close modifications."""
    reads, mods = embedding_reads(spark, sf), embedding_mods(spark, sf)
    kept = filters.filter_reads_by_distance(reads, mods)
    fits = mixtures.fit_spaced(mixtures.position_sets(kept, mods.join(kept.select("read_id"), "read_id", "left_semi")), 2, L_EMBEDDING)
    rows = [(len(m.pi), k, float(m.pi[k]), float(t), m.ll, m.bic) for m in fits for k, t in enumerate(mixtures.true_shares(m))]
    return spark.createDataFrame(rows, "clusters long, cluster long, observed double, true_share double, ll double, bic double")


@query("two_sample_purity")
def two_sample_purity(spark, sf):
    s = two_sample.Settings(length=L_ORDER)
    return two_sample.analyse(order_reads(spark, sf), order_mods(spark, sf), s)["purity"]


@query("fold_constraints", _emb(_PROFILES + ", k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rate DESC, pos) AS k FROM profile), m AS (SELECT cluster, median(rate) AS m FROM k WHERE k <= 10 GROUP BY cluster) SELECT p.cluster, pos, CASE WHEN pos % 4 IN (0, 3) THEN round(least(1, rate / m), 3) ELSE -999.0::DOUBLE END AS \"constraint\" FROM profile p JOIN m ON p.cluster = m.cluster"))
def fold_constraints(spark, sf):
    return evaluate.fold_constraints(_profiles(spark, sf), "cluster", "ATGC" * (L_EMBEDDING // 4), 10)


@query("predicted_by_bits", _emb(" SELECT read_id, label % 3 AS cluster FROM reads WHERE (label * 13 % 7) / 7.0::DOUBLE >= cast(0.5 AS DOUBLE)"))
def predicted_by_bits(spark, sf):
    """Each read's text predicted twice: the later line holds."""
    bits = bit_strings(spark, sf)
    first = bits.select(F.lit(0).alias("line"), "bits", F.lit(9).cast("long").alias("cluster"), F.lit(1.0).alias("post"))
    second = bits.select(F.lit(1).alias("line"), "bits", (F.col("label") % 3).alias("cluster"), (F.col("label") * 13 % 7 / 7.0).alias("post"))
    return relational.predicted_by_bits(bits.select("read_id", "bits"), first.unionByName(second)).select("read_id", "cluster")


@query("simulation_benchmark")
def simulation_benchmark(spark, sf):
    s = simulate.Simulation(depth=300, length=60, similarity=0.2, rate=0.2)
    return benchmark.run(spark, s, "bmm").unionByName(benchmark.run(spark, s, "kmeans"))


# --- windows and null libraries ---------------------------------------------------------------------------------------


@query("window_coords", 'SELECT cast(s AS BIGINT) AS "start", cast(s + 100 AS BIGINT) AS "end", cast(s + 50 AS BIGINT) AS mid FROM (SELECT unnest(range(10, 110, 7)) AS s)')
def window_coords(spark, sf):
    return windows.window_coords(spark, L_ORDER, 100, 7, 10)


_CONDS = f"""WITH {EVENT_SQL},
pairs AS (SELECT a.pos, a.value AS x, b.value AS y, a.coverage AS cx, b.coverage AS cy FROM profiles a JOIN profiles b ON a.pos = b.pos WHERE a.cond = 0 AND b.cond = 1)"""


@query("window_profile_corr", _CONDS + ', c AS (SELECT pos, corr(x, y) OVER w AS r, count(*) OVER w AS n FROM pairs WINDOW w AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT pos AS "start", pos + 10 AS mid, round(r, 6) + 0.0 AS r FROM c WHERE n = 20')
def window_profile_corr(spark, sf):
    return windows.window_correlation(regions.paired_profiles(event_profiles(spark, sf)).select("pos", "x", "y"), 20).select("start", "mid", r6("r"))


@query("moving_sum", f"WITH {EVENT_SQL}, n AS (SELECT pos, cast(sum(coverage) AS BIGINT) AS n FROM profiles GROUP BY pos) SELECT pos, n, cast(sum(n) OVER (ORDER BY pos RANGE BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS BIGINT) AS total FROM n")
def moving_sum(spark, sf):
    n = event_profiles(spark, sf).groupBy("pos").agg(F.sum("coverage").alias("n"))
    return windows.moving_sum(n, 24)


@query("intervals_islands", _order(", d AS (SELECT DISTINCT read_id, pos FROM mods), g AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM d) SELECT read_id, min(pos) AS first, max(pos) AS last, cast(count(*) AS BIGINT) AS n FROM g GROUP BY read_id, g"))
def intervals_islands(spark, sf):
    return windows.islands(order_sites(spark, sf), by=("read_id",))


_GRAM = """,
w AS (SELECT cast(unnest(range(0, 100, 25)) AS BIGINT) AS s),
g AS (SELECT w.s, x.pos AS i, y.pos AS j, count(*) AS n FROM w JOIN mods x ON x.pos >= w.s AND x.pos < w.s + 100 JOIN mods y ON y.read_id = x.read_id AND y.pos >= w.s AND y.pos < w.s + 100 GROUP BY ALL)"""


@query("svd_spectrum", _order(_GRAM + ' SELECT s AS "start", s + 100 AS "end", round(cast(sum(n) FILTER (i = j) AS DOUBLE), 3) AS sigma2, round(cast(sum(n * n) AS DOUBLE), 3) AS sigma4 FROM g GROUP BY s'))
def svd_spectrum(spark, sf):
    t = windows.window_entropy(order_mods(spark, sf), L_ORDER, 100, 25)
    return t.select("start", "end", F.round("sigma2", 3).alias("sigma2"), F.round("sigma4", 3).alias("sigma4"))


@query("svd_entropy")
def svd_entropy(spark, sf):
    return windows.window_entropy(order_mods(spark, sf), L_ORDER, 100, 25, 30).select("start", "end", r6("entropy"))


SEEDS = [386, 387]


@query("null_position_margins", _order(" SELECT s.seed, pos, cast(count(*) AS BIGINT) AS n FROM mods, (SELECT unnest([386, 387]) AS seed) s GROUP BY ALL"))
def null_position_margins(spark, sf):
    return nulls.shuffled_library(order_mods(spark, sf), SEEDS, 2).groupBy("seed", "pos").agg(F.count("*").alias("n"))


@query("null_read_margins", _order(" SELECT s.seed, read_id, cast(count(*) AS BIGINT) AS n FROM mods, (SELECT unnest([386, 387]) AS seed) s GROUP BY ALL"))
def null_read_margins(spark, sf):
    made = nulls.shuffled_reads(order_mods(spark, sf), SEEDS, 2)
    return made.select("seed", "read_id", F.size(F.array_distinct("p")).cast("long").alias("n"))


@query(
    "null_one_round",
    _order(""",
s AS (SELECT cast(unnest([386, 387]) AS BIGINT) AS seed), r AS (SELECT DISTINCT read_id FROM mods), n AS (SELECT greatest(1, count(*) // 5000) AS n FROM r),
o AS (SELECT seed, read_id, md5(seed || '|' || read_id || '|0') AS o FROM s, r),
k AS (SELECT seed, read_id, q, row_number() OVER (PARTITION BY seed, q ORDER BY o, read_id) AS k FROM (SELECT *, cast('0x' || substr(o, 1, 8) AS BIGINT) % (SELECT n FROM n) AS q FROM o)),
pair AS (SELECT x.seed, x.read_id AS ra, y.read_id AS rb FROM k x LEFT JOIN k y ON y.seed = x.seed AND y.q = x.q AND y.k = x.k + 1 WHERE x.k % 2 = 1),
cell AS (SELECT seed, ra, rb, pos, sum(a) AS a, sum(b) AS b FROM (
  SELECT p.seed, ra, rb, pos, 1 AS a, 0 AS b FROM pair p JOIN mods m ON m.read_id = ra UNION ALL SELECT p.seed, ra, rb, pos, 0, 1 FROM pair p JOIN mods m ON m.read_id = rb) GROUP BY ALL),
free AS (SELECT seed, ra, rb, pos, row_number() OVER (PARTITION BY seed, ra ORDER BY md5(seed || '|' || ra || '|0|' || pos), pos) AS k, sum(a) OVER (PARTITION BY seed, ra) AS na FROM cell WHERE a + b = 1)
SELECT seed, ra AS read_id, pos FROM cell WHERE a + b = 2 UNION ALL SELECT seed, rb, pos FROM cell WHERE a + b = 2
UNION ALL SELECT seed, CASE WHEN k <= na THEN ra ELSE rb END, pos FROM free"""),
)
def null_one_round(spark, sf):
    """The reads after one round of trading."""
    return nulls.shuffled_library(order_mods(spark, sf), SEEDS, 1).select(F.col("seed").cast("long").alias("seed"), "read_id", "pos")


@query("null_independent")
def null_independent(spark, sf):
    reads, mods = embedding_reads(spark, sf), embedding_mods(spark, sf)
    made = nulls.independent_reads(filters.position_rates(reads, mods, L_EMBEDDING), filters.mods_histogram(reads, mods), L_EMBEDDING)
    return made.groupBy("pos").agg(F.count("*").alias("n"))


@query("call_sites_normal")
def call_sites_normal(spark, sf):
    return heterogeneity.analyse(order_mods(spark, sf), heterogeneity.Settings(L_ORDER))["tests"].drop("null_mean", "difference")


_ENTROPIES = f"""WITH {EVENT_SQL},
o AS (SELECT pos AS "start", value AS entropy FROM profiles WHERE cond = 0),
s AS (SELECT p.pos AS "start", k.seed, p.value * (0.5::DOUBLE + (p.pos * 31 + k.seed * 17) % 97 / 97.0::DOUBLE) AS entropy FROM profiles p, (SELECT unnest(range(0, 20)) AS seed) k WHERE cond = 1)"""


@query("permtest_pvalues", _ENTROPIES + ' SELECT o."start", round(o.entropy, 6) AS entropy, round(1 - count(*) FILTER (o.entropy < s.entropy) / count(*), 6) AS p, 1 - count(*) FILTER (o.entropy < s.entropy) / count(*) < cast(0.05 AS DOUBLE) AS significant FROM o JOIN s ON o."start" = s."start" GROUP BY o."start", o.entropy')
def permtest_pvalues(spark, sf):
    p = event_profiles(spark, sf)
    observed = p.where("cond = 0").select(F.col("pos").alias("start"), F.col("value").alias("entropy"))
    seeds = spark.range(20).withColumnRenamed("id", "seed")
    null = p.where("cond = 1").join(F.broadcast(seeds)).select(F.col("pos").alias("start"), "seed", (F.col("value") * (0.5 + (F.col("pos") * 31 + F.col("seed") * 17) % 97 / 97.0)).alias("entropy"))
    return windows.permutation_test(observed, null).select("start", r6("entropy"), r6("p"), "significant")


# --- scores -----------------------------------------------------------------------------------------------------------

_SCORES = "WITH s AS (SELECT cast(value AS DOUBLE) AS score, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END AS truth FROM events)"


def _scores(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    first = ev.agg(F.min("event_type").alias("t"))
    return ev.join(F.broadcast(first)).select(F.col("value").cast("double").alias("score"), F.when(F.col("event_type") == F.col("t"), 1).otherwise(0).alias("truth"))


@query("roc_auc", _SCORES + ", r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s), n AS (SELECT cast(count(*) FILTER (truth = 1) AS DOUBLE) AS p, cast(count(*) FILTER (truth = 0) AS DOUBLE) AS n FROM s) SELECT round(((SELECT sum(r) FROM r WHERE truth = 1) - p * (p + 1) / 2) / (p * n), 6) AS auc FROM n")
def roc_auc(spark, sf):
    return windows.auc(_scores(spark, sf)).select(r6("auc"))


_ROC = _SCORES + ", g AS (SELECT score AS threshold, count(*) FILTER (truth = 1) AS tp, count(*) FILTER (truth = 0) AS fp FROM s GROUP BY score), c AS (SELECT threshold, cast(sum(tp) OVER w AS DOUBLE) / sum(tp) OVER () AS tpr, cast(sum(fp) OVER w AS DOUBLE) / sum(fp) OVER () AS fpr FROM g WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("roc_points", _ROC + " SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c")
def roc_points(spark, sf):
    return windows.roc(_scores(spark, sf)).select(r6("threshold"), r6("tpr"), r6("fpr"))


@query("best_threshold", _ROC + " SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c ORDER BY round((1 - fpr) * tpr, 9) DESC, c.threshold DESC LIMIT 1")
def best_threshold(spark, sf):
    return windows.best_threshold(windows.roc(_scores(spark, sf))).select(r6("threshold"), r6("tpr"), r6("fpr"))


@query("classification", _SCORES + ", c AS (SELECT count(*) FILTER (score > 50 AND truth = 1) AS tp, count(*) FILTER (score > 50 AND truth = 0) AS fp, count(*) FILTER (score <= 50 AND truth = 1) AS fn, count(*) AS n FROM s) SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS \"precision\", round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def classification(spark, sf):
    calls = _scores(spark, sf).withColumn("predicted", F.when(F.col("score") > 50, 1).otherwise(0))
    return windows.classification(calls).select(*[r6(c) for c in ("accuracy", "recall", "precision", "f1")])


# --- regions and signals ----------------------------------------------------------------------------------------------


@query("identify_dsr", _CONDS + ", t AS (SELECT *, count(*) OVER w AS n, corr(x, y) OVER w AS r, sum(abs(x - y)) OVER w AS d FROM pairs WINDOW w AS (ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 4 FOLLOWING)) SELECT pos, round(r, 6) + 0.0 AS r, round(d, 4) AS diff FROM t WHERE n = 10 AND pos >= 5 AND pos < 715 AND r < cast(0.93 AS DOUBLE) AND d > cast(0.25 AS DOUBLE) AND cx >= 5 AND cy >= 5")
def identify_dsr(spark, sf):
    found = regions.differential_sites(regions.paired_profiles(event_profiles(spark, sf)), 720, 10, least_coverage=5)
    return found.select("pos", r6("r"), F.round("diff", 4).alias("diff"))


@query("coverage_sum", f"WITH {EVENT_SQL}, s AS (SELECT cast(unnest(range(0, 720)) AS BIGINT) AS pos) SELECT s.pos, cast(coalesce(sum(coverage), 0) AS BIGINT) AS coverage FROM s LEFT JOIN profiles p ON p.pos = s.pos GROUP BY s.pos")
def coverage_sum(spark, sf):
    return regions.coverage(event_profiles(spark, sf).select("pos", "coverage"), 720)


_ANNOTATIONS = [("0", 0, 240, 480, 720), ("1", 0, 100, 100, 700)]


@query("tabulate_regions", f"WITH {EVENT_SQL}, reg AS (SELECT * FROM (VALUES ('0', 0, 240, 0), ('0', 240, 480, 1), ('0', 480, 720, 2), ('1', 0, 100, 0), ('1', 100, 700, 2)) v(chrom, s, e, code)), h AS (SELECT p.cond, p.pos, min(code) AS code FROM profiles p LEFT JOIN reg ON cast(p.cond AS VARCHAR) = chrom AND p.pos >= s AND p.pos < e GROUP BY ALL) SELECT cast(coalesce(code, -1) AS BIGINT) AS code, cast(count(*) AS BIGINT) AS n FROM h GROUP BY code")
def tabulate_regions(spark, sf):
    ann = spark.createDataFrame(_ANNOTATIONS, "chrom string, tx_start long, utr5 long, utr3 long, tx_end long")
    sites = event_profiles(spark, sf).select(F.col("cond").cast("string").alias("chrom"), "pos")
    return regions.counted_by_region(sites, regions.transcript_regions(ann)).select(F.coalesce("code", F.lit(-1).cast("long")).alias("code"), "n")


_CHIMERIC = """WITH m AS (SELECT l_orderkey AS iid, cast(l_quantity AS BIGINT) AS counts, (2 * (l_partkey % 700) + 20) // 2 AS m1, (2 * (l_suppkey * 37 % 700) + 20) // 2 AS m2 FROM lineitem),
iv AS (SELECT counts, unnest([m1, m2]) AS m FROM m WHERE abs(m1 - m2) < 300 AND m1 >= 0 AND m2 <= 720),
w AS (SELECT cast(unnest(range(0, 620, 31)) AS BIGINT) AS s),
j AS (SELECT w.s, sum(counts) AS c, sum(counts * ln(counts::DOUBLE)) AS l FROM w JOIN iv ON m - 5 < w.s + 100 AND w.s < m + 5 GROUP BY w.s)"""


@query("splash_entropy", _CHIMERIC + ' SELECT w.s AS "start", w.s + 100 AS "end", round(coalesce(ln(c::DOUBLE) - l / c, 0), 6) AS entropy FROM w LEFT JOIN j ON j.s = w.s')
def splash_entropy(spark, sf):
    li = table(spark, sf, "lineitem")
    a, b = F.col("l_partkey") % 700, F.col("l_suppkey") * 37 % 700
    pairs = li.select(F.col("l_orderkey").alias("iid"), a.alias("s1"), (a + 20).alias("e1"), b.alias("s2"), (b + 20).alias("e2"), F.col("l_quantity").cast("long").alias("counts"))
    return regions.interval_entropy(regions.chimeric_intervals(pairs, 0, 720), windows.window_coords(spark, 720, 100, 31)).select("start", "end", r6("entropy"))


@query("zscore_signal", "WITH s AS (SELECT user_id AS id, avg(cast(value AS DOUBLE)) AS m, stddev_pop(cast(value AS DOUBLE)) AS d FROM events GROUP BY user_id) SELECT event_id, round(coalesce((cast(value AS DOUBLE) - m) / nullif(d, 0), 0), 5) + 0.0 AS z FROM events JOIN s ON user_id = id")
def zscore_signal(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").alias("id"), F.col("value").cast("double").alias("value"))
    return regions.z_scores(ev).select("event_id", F.round("z", 5).alias("z"))


@query("dtw_self", "SELECT user_id AS id, cast(0 AS BIGINT) AS first, cast(count(*) - 1 AS BIGINT) AS final_length, 0.0::DOUBLE AS distance FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY user_id")
def dtw_self(spark, sf):
    """The series of the first user on itself: it lies on itself whole."""
    ev = table(spark, sf, "events")
    one = ev.join(F.broadcast(ev.agg(F.min("user_id").alias("user_id"))), "user_id")
    series = one.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("value")))).alias("x"))
    series = series.select("id", F.transform("x", lambda x: x["value"]).alias("samples"))
    ref = {"self": np.array(series.first()["samples"])}
    return signals.align(series, ref).select("id", "first", "final_length", F.round("distance", 6).alias("distance"))


@query("dtw_self_all", "SELECT user_id AS id, cast(0 AS BIGINT) AS first, cast(count(*) - 1 AS BIGINT) AS final_length, 0.0::DOUBLE AS distance FROM events GROUP BY user_id")
def dtw_self_all(spark, sf):
    """The series of every user on itself."""
    ev = table(spark, sf, "events")
    series = ev.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("value")))).alias("x"))
    found = signals.align_self(series.select("id", F.transform("x", lambda x: x["value"]).alias("samples")))
    return found.select("id", "first", "final_length", F.round("distance", 6).alias("distance"))


@query("dtw_one_sample", "SELECT event_id AS id, cast(j AS BIGINT) AS first, cast(j AS BIGINT) AS last, round(d, 6) AS distance, round(d, 6) AS norm_score FROM (SELECT event_id, j, abs(cast(value AS DOUBLE) - j) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(cast(value AS DOUBLE) - j), j) AS k FROM events, (SELECT unnest(range(0, 40)) AS j)) WHERE k = 1")
def dtw_one_sample(spark, sf):
    """Signals of one sample lie on the nearest place of a ramp."""
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array(F.col("value").cast("double")).alias("samples"))
    return signals.align(ev, {"ramp": np.arange(40.0)}, normalise=False).select("id", "first", "last", F.round("distance", 6).alias("distance"), F.round("norm_score", 6).alias("norm_score"))


@query("dtw_two_samples", "WITH s AS (SELECT user_id AS id, cast(min_by(value, k) AS DOUBLE) AS a, cast(max_by(value, k) AS DOUBLE) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 2 GROUP BY user_id HAVING count(*) = 2), r AS (SELECT j, cast(j * 37 % 101 AS DOUBLE) AS r, CASE WHEN j < 59 THEN cast((j + 1) * 37 % 101 AS DOUBLE) END AS n FROM (SELECT unnest(range(0, 60)) AS j)) SELECT id, round(sqrt(min(pow(a - r, 2) + least(pow(b - r, 2), coalesce(pow(b - n, 2), 1e18)))), 6) AS distance FROM s, r GROUP BY id")
def dtw_two_samples(spark, sf):
    """The first two values of each user against a jagged reference: the second sample stays at the first one's place or goes one on."""
    ev = table(spark, sf, "events")
    series = ev.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("value")))).alias("x"))
    two = series.where(F.size("x") >= 2).select("id", F.transform(F.slice("x", 1, 2), lambda x: x["value"]).alias("samples"))
    return signals.align(two, {"jagged": np.arange(60.0) * 37 % 101}, normalise=False).select("id", F.round("distance", 6).alias("distance"))


@query("dtw_subseq")
def dtw_subseq(spark, sf):
    ev = table(spark, sf, "events")
    series = ev.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("value")))).alias("x"))
    wave = {"sine": np.sin(np.arange(40) / 3), "ramp": np.arange(40.0)}
    return signals.align(series.select("id", F.transform("x", lambda x: x["value"]).alias("samples")), wave)


# --- communities, embeddings, simulation ------------------------------------------------------------------------------


def _round_sql(k: int) -> str:
    """One round of moves from the table homes{k} to homes{k + 1}."""
    return f"""
mass{k} AS (SELECT home, sum(degree) AS mass, count(*) AS size FROM homes{k} GROUP BY home),
links{k} AS (
  SELECT a, h.home AS c, sum(w) AS w FROM e JOIN homes{k} h ON h.id = b
  WHERE (substr(md5(cast(a AS VARCHAR) || '|{k // 2}'), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')) = {"true" if k % 2 == 0 else "false"} GROUP BY a, h.home),
gains{k} AS (
  SELECT l.a, l.c, x.home, w - 1.0::DOUBLE * x.degree * m.mass / total AS gain, o.size = 1 AND m.size = 1 AND l.c > x.home AS turned,
    coalesce(max(CASE WHEN l.c = x.home THEN w END) OVER (PARTITION BY l.a), 0.0) - 1.0::DOUBLE * x.degree * (o.mass - x.degree) / total AS stay
  FROM links{k} l JOIN homes{k} x ON x.id = l.a JOIN mass{k} o ON o.home = x.home JOIN mass{k} m ON m.home = l.c, total),
best{k} AS (SELECT * FROM gains{k} WHERE c <> home AND NOT turned QUALIFY row_number() OVER (PARTITION BY a ORDER BY gain DESC, c) = 1),
homes{k + 1} AS (SELECT h.id, coalesce(b.c, h.home) AS home, h.degree FROM homes{k} h LEFT JOIN best{k} b ON b.a = h.id AND b.gain > b.stay + cast(1e-12 AS DOUBLE))"""


_MOVED = f"""WITH {EMBEDDING_SQL.strip()},
half AS (SELECT x.read_id AS a, y.read_id AS b, cast(count(*) AS DOUBLE) AS w FROM mods x JOIN mods y ON x.pos = y.pos AND x.read_id < y.read_id GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT a, b, w FROM half UNION ALL SELECT b, a, w FROM half),
homes0 AS (SELECT a AS id, a AS home, sum(w) AS degree FROM e GROUP BY a),
total AS (SELECT sum(degree) AS total FROM homes0),{",".join(_round_sql(k) for k in range(4))}"""


def _graph(spark, sf) -> shared_graph.SharedGraph:
    return shared_graph.shared_graph(embedding_mods(spark, sf), 3)


@query("louvain_moves", _MOVED + " SELECT id AS read_id, home AS cluster FROM homes4")
def louvain_moves(spark, sf):
    """Where the first four rounds of moves have brought each read, by modularity."""
    nodes = communities.after_rounds(_graph(spark, sf), 4)
    return nodes.select(F.col("id").alias("read_id"), F.col("home").alias("cluster"))


@query("louvain_modularity", _MOVED + """ SELECT round((SELECT sum(w) FROM e JOIN homes4 x ON x.id = a JOIN homes4 y ON y.id = b WHERE x.home = y.home) / total
  - (SELECT sum(m * m) FROM (SELECT sum(degree) AS m FROM homes4 GROUP BY home)) / (total * total), 9) AS modularity FROM total""")
def louvain_modularity(spark, sf):
    """Modularity after the first four rounds."""
    edges = _graph(spark, sf)
    nodes = communities.after_rounds(edges, 4)
    return spark.createDataFrame([(round(communities.modularity(nodes, edges), 9),)], "modularity double")


@query("louvain")
def louvain(spark, sf):
    return communities.communities(embedding_reads(spark, sf), _graph(spark, sf))


@query("leiden")
def leiden(spark, sf):
    return communities.communities(embedding_reads(spark, sf), _graph(spark, sf), refine=True)


@query("community_cover", _emb(" SELECT cast(count(*) AS BIGINT) AS reads, cast(count(DISTINCT read_id) AS BIGINT) AS distinct_reads FROM reads"))
def community_cover(spark, sf):
    """Every read is in exactly one community."""
    return louvain(spark, sf).agg(F.count("*").alias("reads"), F.count_distinct("read_id").alias("distinct_reads"))


@query("kmeans")
def kmeans(spark, sf):
    points = clustering.vectors(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING)
    return clustering.k_means(points, 10).select("read_id", "label", "cluster")


@query("pca")
def pca(spark, sf):
    points = clustering.vectors(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING)
    return clustering.principal_components(points).select("read_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def _profile_matrix(spark, sf) -> tuple[list[int], np.ndarray]:
    """Profiles of the clusters as an array: a few rows, whatever the number of reads."""
    rows = _profiles(spark, sf).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "rate"))).alias("x")).orderBy("cluster").collect()
    return [r["cluster"] for r in rows], np.array([[c["rate"] for c in r["x"]] for r in rows])


@query("dendrogram")
def dendrogram(spark, sf):
    """Cluster profiles by complete linkage on correlation distance."""
    names, x = _profile_matrix(spark, sf)
    labels = clustering.hierarchical(1 - np.corrcoef(x), 3, "complete")
    return spark.createDataFrame([(int(n), int(g)) for n, g in zip(names, labels)], "cluster long, branch long")


@query("profile_clusters")
def profile_clusters(spark, sf):
    """Cluster profiles by Ward linkage, by medoids, and placed in a plane."""
    names, x = _profile_matrix(spark, sf)
    d2 = clustering.squared_distances(x)
    ward, (medoid, _), at = clustering.hierarchical(d2, 3), clustering.k_medoids(np.sqrt(d2), 3), clustering.classical_scaling(np.sqrt(d2))
    return spark.createDataFrame([(int(n), int(w), int(m), float(a), float(b)) for n, w, m, (a, b) in zip(names, ward, medoid, at)], "cluster long, ward long, medoid long, x double, y double")


_HASH = "cast(('0x' || substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query("sim_truths", f"SELECT id AS read_id, cast(CASE WHEN u < cast(0.5 AS DOUBLE) THEN 0 ELSE 1 END AS BIGINT) AS truth FROM (SELECT id, {_HASH.format("'truth|' || id || '|386'")} AS u FROM (SELECT cast(unnest(range(0, 100)) AS BIGINT) AS id))")
def sim_truths(spark, sf):
    return simulate.truths(spark, simulate.Simulation())


_SIM = f"""WITH g AS (SELECT cast(unnest(range(0, 2)) AS BIGINT) AS cluster), p AS (SELECT cast(unnest(range(0, 100)) AS BIGINT) AS pos),
st AS (SELECT cluster, pos, ({_HASH.format("'base|' || pos || '|386'")} < 0.5) <> (cluster > 0 AND {_HASH.format("'flip|' || cluster || '|' || pos || '|386'")} < 0.5) AS unpaired FROM g, p)"""


@query("sim_probed")
def sim_probed(spark, sf):
    s = simulate.Simulation(length=400, shares=simulate.MIXTURES["A3"])
    return simulate.probed_library(spark, s).groupBy("truth", "pos").agg(F.count("*").alias("n"))


@query("sim_structures", _SIM + " SELECT cluster, pos, unpaired FROM st")
def sim_structures(spark, sf):
    return simulate.structures(spark, simulate.Simulation())


def _library_sql(rate: str) -> str:
    return (
        _SIM
        + f""",
t AS (SELECT id AS read_id, CASE WHEN {_HASH.format("'truth|' || id || '|386'")} < 0.5 THEN 0 ELSE 1 END AS truth FROM (SELECT cast(unnest(range(0, 100)) AS BIGINT) AS id)),
o AS (SELECT cluster, avg(CASE WHEN unpaired THEN 1.0::DOUBLE ELSE 0 END) AS open FROM st GROUP BY cluster)
SELECT read_id, cast(truth AS BIGINT) AS truth, pos FROM t JOIN st ON truth = st.cluster JOIN o ON o.cluster = st.cluster
WHERE (unpaired AND {_HASH.format("'mod|' || read_id || '|' || pos || '|386'")} < least(1, cast({rate} AS DOUBLE) / open)) OR {_HASH.format("'err|' || read_id || '|' || pos || '|386'")} < cast(0.001 AS DOUBLE)"""
    )


@query("sim_library", _library_sql("0.02"))
def sim_library(spark, sf):
    """False positives on top of the rate."""
    return simulate.library(spark, simulate.Simulation(false_positives=0.001, on_top=True))


@query("sim_library_net", _library_sql("0.019"))
def sim_library_net(spark, sf):
    """The rate is that of all modifications."""
    return simulate.library(spark, simulate.Simulation(false_positives=0.001))
