"""Properties of kernels that SQL doesn't express, and of text formats."""

import inspect
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.functions import stats
from strandlake.operators import bitvec, clustering, communities, evaluate, filters, mixtures, nulls, ordered, regions, relational, signals, simulate, structure, windows
from strandlake.plans import benchmark, ensembles, folding, heterogeneity, library, two_sample
from strandlake.queries import ensembles as ensemble_queries
from strandlake.queries import models
from strandlake.sources import readers, writers
from strandlake.sources.scratch import kept

PROFILES = np.array([[0.1, 0.9] * 5, [0.1] * 5 + [0.9] * 5, [0.9] * 5 + [0.1] * 5])


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(386)
    truth = rng.integers(0, 3, 600)
    bits = rng.random((600, 10)) < PROFILES[truth]
    reads = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "read_id long, truth long")
    mods = spark.createDataFrame([(int(i), int(p)) for i, p in zip(*np.nonzero(bits))], "read_id long, pos long")
    return reads, mods, bits


def _ari(spark, found):
    return evaluate.agreement(evaluate.contingency(found)).first()["ari"]


def test_mixture_recovers_profiles(spark, mixture):
    reads, mods, _ = mixture
    model = mixtures.fit(mixtures.position_sets(reads, mods), 3, 10, min_iters=8, max_iters=14, seed=1)
    found = two_sample.assignments(reads, mods, model)
    assert _ari(spark, found) > 0.8
    again = mixtures.fit_variational(mixtures.position_sets(reads, mods), 3, 10, updates=14, seed=1)
    assert _ari(spark, two_sample.assignments(reads, mods, again)) > 0.7


def test_sparse_pass_equals_dense(spark, mixture):
    reads, mods, bits = mixture
    mu, pi = mixtures.hashed_start(2, 10), np.array([0.4, 0.6])
    sums = mixtures.em_pass(mixtures.position_sets(reads, mods), mixtures.Weights.of(mu, pi))
    ll = np.log(pi) + bits @ np.log(mu).T + (~bits) @ np.log(1 - mu).T
    top = ll.max(1, keepdims=True)
    z = top[:, 0] + np.log(np.exp(ll - top).sum(1))
    post = np.exp(ll - z[:, None])
    assert np.allclose(sums.counts, post.T @ bits) and np.allclose(sums.totals, post.sum(0))
    assert np.isclose(sums.marginal, z.sum()) and np.isclose(sums.complete, (post * ll).sum())


def test_spaced_probability_by_enumeration():
    mu = np.array([0.3, 0.1, 0.4, 0.2, 0.5, 0.3, 0.2])
    total, mean = 0.0, np.zeros(7)
    for bits in itertools.product((0, 1), repeat=7):
        at = np.flatnonzero(bits)
        if len(at) > 1 and np.diff(at).min() < 4:
            continue
        p = np.prod(np.where(bits, mu, 1 - mu))
        total += p
        mean += p * np.array(bits)
    assert np.isclose(mixtures.spaced_probability(mu)[0], total)
    assert np.allclose(mixtures.spaced_means(mu), mean / total)
    assert np.allclose(mixtures.solve_spaced(mean / total, rounds=5000), mu, atol=1e-4)


def test_shuffle_keeps_margins_and_changes_pairs(spark, mixture):
    _, mods, _ = mixture
    null = nulls.shuffled_library(mods, [1, 2], 2).cache()
    assert null.count() == null.distinct().count() == 2 * mods.count()
    for key in ("pos", "read_id"):
        real = {r[0]: r[1] for r in mods.groupBy(key).count().collect()}
        for seed in (1, 2):
            assert {r[0]: r[1] for r in null.where(f"seed = {seed}").groupBy(key).count().collect()} == real
    assert null.where("seed = 1").select("read_id", "pos").exceptAll(mods).count() > 100


def test_independent_reads_meet_the_quota(spark, mixture):
    reads, mods, _ = mixture
    hist = filters.mods_histogram(reads, mods)
    made = nulls.independent_reads(filters.position_rates(reads, mods, 10), hist, 10, 5000)
    got = {r[0]: r[1] for r in made.groupBy("read_id").agg(F.count("*").alias("n")).groupBy("n").count().collect()}
    want = {r[0]: r[1] for r in hist.collect()}
    assert all(n <= want[k] for k, n in got.items()) and sum(got.values()) > 400


def test_window_entropy_equals_svd(spark, mixture):
    _, mods, bits = mixture
    got = {r["start"]: r["entropy"] for r in windows.window_entropy(mods, 10, 6, 2).collect()}
    assert sorted(got) == [0, 2]
    for start, value in got.items():
        s = np.linalg.svd(bits[:, start : start + 6].astype(float), compute_uv=False)
        p = s / s.sum()
        assert np.isclose(value, -(p * np.log(p)).sum())


def test_statistics():
    assert np.isclose(stats.incomplete_beta(2, 3, 0.4), 0.5248)
    assert np.isclose(stats.digamma(np.array([1.0]))[0], -0.5772156649)
    assert np.isclose(stats.adjusted_mutual_information(np.diag([5, 5])), 1.0)
    assert stats.correlation_p_value(0.9, 10) < 0.001


def test_louvain_finds_cliques():
    a, b = np.array([(i, j) for c in (0, 5) for i in range(c, c + 5) for j in range(i + 1, c + 5)] + [(4, 5)]).T
    w = np.ones(len(a))
    for refine in (False, True):
        labels = clustering.louvain(10, a, b, w, refine=refine)
        assert len(set(labels[:5])) == len(set(labels[5:])) == 1 and labels[0] != labels[9]
        assert clustering.modularity(labels, a, b, w) > 0.4


def test_small_clusterings():
    x = np.concatenate([np.zeros((4, 2)), np.ones((4, 2)) * 5]) + np.random.default_rng(1).normal(0, 0.1, (8, 2))
    d = clustering.squared_distances(x)
    for labels in (clustering.hierarchical(d, 2), clustering.hierarchical(np.sqrt(d), 2, "complete"), clustering.k_medoids(np.sqrt(d), 2)[0]):
        assert len(set(labels[:4])) == len(set(labels[4:])) == 1 and labels[0] != labels[7]
    y = clustering.classical_scaling(np.sqrt(d))
    assert np.allclose(clustering.squared_distances(y), d, atol=1e-6)
    full = clustering.soft_impute(np.outer([0.5, 0.8, 0.9], [0.5, 0.7, 0.0]))
    assert full.shape == (3, 3) and clustering.binarise(full).sum() == 3


def test_subsequence_alignment():
    ref = np.sin(np.arange(60) / 4)
    first, last, d = signals.subsequence_path(ref, ref[20:40])
    assert (first, last) == (20, 39) and d == 0


def test_unbalanced_structures(spark):
    s = spark.createDataFrame([(1, "((.))"), (2, "())("), (3, ""), (4, "((.)")], "struct_id long, db string")
    assert [tuple(r) for r in structure.base_pairs(s).orderBy("struct_id", "i").collect()] == [(1, 0, 4), (1, 1, 3)]
    assert [r["is_balanced"] for r in structure.balanced(s).orderBy("struct_id").collect()] == [True, False, True, False]


def test_filters_with_empty_reads(spark):
    reads = spark.createDataFrame([(1, 0, 10), (2, 1, 10)], "read_id long, cond long, length long")
    mods = spark.createDataFrame([], "read_id long, pos long")
    assert filters.read_counts(reads, mods).agg(F.sum("n_mods")).first()[0] == 0
    assert filters.position_rates(reads, mods, 5).where("rate = 0").count() == 5
    assert filters.mods_histogram(reads, mods).collect() == [(0, 2)]


def test_thinning(spark):
    mods = spark.createDataFrame([(1, p) for p in (2, 5, 7, 9, 20)], "read_id long, pos long")
    assert sorted(r["pos"] for r in filters.thin_by_distance(mods).collect()) == [5, 9, 20]


def test_text_formats(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% x\n3 8 4\n1 1 1\n1 8 1\n3 4 1\n2 2 0\n")
    (tmp_path / "ids.csv").write_text("0,a,8,0\n1,b,2,0\n2,c,7,1\n")
    (tmp_path / "sizes.tsv").write_text("g\t8\nh\t5\n")
    reads, mods = readers.read_matrix(spark, str(tmp_path / "m.mtx"), str(tmp_path / "ids.csv"), "g", str(tmp_path / "sizes.tsv"))
    assert sorted(r["read_id"] for r in reads.collect()) == ["a", "c"]
    assert sorted(map(tuple, mods.collect())) == [("a", 0), ("a", 7), ("c", 3)]
    with pytest.raises(Exception, match="wider"):
        readers.matrix_market(spark, str(tmp_path / "m.mtx"), 5).collect()
    writers.write_lines(writers.bit_vector_lines(reads, mods, 8), str(tmp_path / "bv"))
    back = readers.bit_vectors(spark, str(tmp_path / "bv"))
    assert sorted(map(tuple, back.collect())) == [("a.1", "10000001", 2.0), ("c.1", "00010000", 1.0)]
    (tmp_path / "x.fa").write_text(">s1 first\nACG\nTT\n>s2\nggg\n")
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "x.fa")).collect())) == [("s1", "ACGTT"), ("s2", "GGG")]
    (tmp_path / "x.ct").write_text("5 title\n1 A 0 2 5 1\n2 C 1 3 0 2\n3 G 2 4 0 3\n4 U 3 5 0 4\n5 U 4 0 1 5\n")
    assert sorted(map(tuple, readers.connect_table(spark, str(tmp_path / "x.ct")).collect())) == [(0, 4), (4, 0)]
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr\t99\tg\t1\t60\t4M\t=\t3\t0\tACGT\tIIII\tMD:Z:4\nr\t147\tg\t3\t60\t4M\t=\t1\t0\tGTAC\tIIII\tMD:Z:4\nq\t99\tg\t1\t60\t4M\t=\t9\t0\tACGT\tIIII\n")
    aligned = readers.paired(readers.sam(spark, str(tmp_path / "x.sam")))
    assert sorted((r["qname"], r["mate"]) for r in aligned.collect()) == [("r", 1), ("r", 2)]
    (tmp_path / "q.txt").write_text("score symbol\n0 !\n40 I\n")
    assert readers.phred(spark, str(tmp_path / "q.txt")) == {"!": 0, "I": 40}


def test_matrix_with_an_empty_sidecar_column(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("0,a\n1,b\n")
    assert readers.read_ids(spark, str(tmp_path / "ids.csv")).where("length is null").count() == 2


def test_model_files(spark, tmp_path, mixture):
    m = mixtures.Mixture(PROFILES, np.full(3, 1 / 3), -1.0, 2.0, [(1, -1.0, -1.0)])
    writers.write_mixture(spark, m, str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "model/model_mu")).count() == 10


def test_fold_plan(spark):
    seqs = spark.createDataFrame([("a", "ACGU", None), ("b", "GG", [0.1, -999.0])], "id string, seq string, reactivity array<double>")
    out = folding.fold(seqs, lambda seq, react, t, n: ["." * len(seq)] * n, n=2)
    assert sorted(map(tuple, out.collect())) == [("a", 0, "...."), ("a", 1, "...."), ("b", 0, ".."), ("b", 1, "..")]


def test_masked_profiles(spark):
    rows = [(0, p, float("nan") if p == 3 else float(p), 9) for p in range(20)] + [(1, p, float(p), 9) for p in range(20)]
    pairs = regions.paired_profiles(spark.createDataFrame(rows, "cond long, pos long, value double, coverage long"))
    assert pairs.where("x is null").count() == 1
    assert regions.differential_sites(pairs, 20, 4, 2.0, -1.0, 1).agg(F.min("pos")).first()[0] == 6


def test_bit_filters(spark):
    v = spark.createDataFrame([(1, "0A00T0"), (2, "0A000T"), (3, "0?A000"), (4, "......")], "read_id long, bits string")
    got = {r["read_id"]: r["reason"] for r in bitvec.filter_reasons(v, 6, 0.5).collect()}
    assert got[4] == "info" and got[3] == "surroundings" and got[1] == "distance" and got[2] == "ok"


def test_probed_reads(spark):
    s = simulate.Simulation(depth=60, length=300, shares=simulate.MIXTURES["A2"])
    open_at = {(r["cluster"], r["pos"]) for r in simulate.structures(spark, s).where("unpaired").collect()}
    for probe in ("NAI", "1AI", "poisson", "fixed"):
        rows = simulate.probed_library(spark, s, probe).collect()
        assert rows and {(r["truth"], r["pos"]) for r in rows} <= open_at
    assert all(abs(sum(v) - 1) < 1e-9 for v in simulate.MIXTURES.values()) and len(simulate.MIXTURES) == 20


def test_ranks_and_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(v), int(g)) for i, (v, g) in enumerate(zip(rng.integers(0, 40, 500), rng.integers(0, 2, 500)))]
    df = spark.createDataFrame(rows, "id long, v double, g long")
    got = ordered.rank(df, ordered.quantile_bucket(df, "v", 16), ["v", "id"], ("g",)).collect()
    for g in (0, 1):
        want = sorted((v, i) for i, v, x in rows if x == g)
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [i for _, i in want]
    down = ordered.running(df, {"s": F.col("v")}, ordered.quantile_bucket(df, "v", 16), ["v", "id"], descending=True).collect()
    top = sorted(down, key=lambda r: (-r["v"], r["id"]))
    assert np.allclose(np.cumsum([r["v"] for r in top]), [r["s"] for r in top])


def test_running_rates_stream(spark, tmp_path):
    from strandlake.streaming import running_rates

    rows = [("g", i % 3, i % 5, f"2024-01-01 0{i % 2}:10:00") for i in range(40)]
    df = spark.createDataFrame(rows, "gene string, read_id int, pos int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = running_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["window"]["start"].hour, r["pos"]): r["n"] for r in spark.table("rates").collect()}
    assert len(got) == 10 and set(got.values()) == {4}


def test_library_of_samples(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "read_id string, row_idx long"), spark.createDataFrame([("x", 3), ("y", 9), ("z", 4)], "read_id string, pos long")
    b = spark.createDataFrame([("x", 0), ("w", 1)], "read_id string, row_idx long"), spark.createDataFrame([("x", 4), ("w", 5)], "read_id string, pos long")
    reads, mods = library.load({"a": a, "b": b}, 2, 6)
    assert sorted((r["sample"], r["read_id"]) for r in reads.collect()) == [("a", "x"), ("b", "w"), ("b", "x")]
    assert sorted(tuple(r) for r in mods.select("sample", "pos").collect()) == [("a", 3), ("b", 4), ("b", 5)]


def test_heterogeneity_plan(spark, mixture):
    _, mods, _ = mixture
    out = heterogeneity.analyse(mods, heterogeneity.Settings(10, 6, 2, seeds=(1, 2, 3), rounds=3))
    assert out["tests"].count() == 2 and out["tests"].where("difference > 0").count() == 2
    assert out["simulated"].count() == 6


@pytest.mark.parametrize("method", ["kmeans", "ward", "kmedoids", "spectral"])
def test_benchmark_methods(spark, method):
    s = simulate.Simulation(depth=80, length=60, similarity=0.0, rate=0.3)
    row = benchmark.run(spark, s, method).first()
    assert row["ari"] > 0.9 and row["accuracy"] > 0.95


def test_registered_fits_run_to_the_operators_defaults(spark, monkeypatch, mixture):
    reads, mods, _ = mixture
    seen = {}

    class Stop(Exception):
        pass

    def recorder(name, f):
        def stop(*args, **kwargs):
            bound = inspect.signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = bound.arguments
            raise Stop

        return stop

    for module, name in ((mixtures, "fit"), (mixtures, "fit_variational"), (mixtures, "fit_spaced"), (two_sample, "analyse")):
        monkeypatch.setattr(module, name, recorder(name, getattr(module, name)))
    for name in ("embedding_reads", "order_reads"):
        monkeypatch.setattr(models, name, lambda *_: reads)
    for name in ("embedding_mods", "order_mods"):
        monkeypatch.setattr(models, name, lambda *_: mods)
    for query, name, want in (
        ("bmm_fit", "fit", {"min_iters": 20, "max_iters": 1000}),
        ("hbbmm_fit", "fit", {"min_iters": 20, "max_iters": 1000, "hierarchical": True}),
        ("bmm_vi", "fit_variational", {"updates": 1000}),
        ("spaced_em_fit", "fit_spaced", {"runs": 10, "min_iters": 300, "max_iters": 1000}),
        ("two_sample_purity", "analyse", {"s": two_sample.Settings(length=models.L_ORDER)}),
    ):
        with pytest.raises(Stop):
            models.QUERIES[query](spark, "")
        assert {k: seen[name][k] for k in want} == want


def test_independent_reads_fill_every_quota(spark):
    """Reads with five modifications are rare under these rates, but their quota is filled, with the rates' conditional margins."""
    p = [0.01, 0.02, 0.03, 0.05, 0.08, 0.1]
    rates = spark.createDataFrame(list(enumerate(p)), "pos long, rate double")
    quotas = {0: 7, 1: 5000, 5: 2500}
    made = nulls.independent_reads(rates, spark.createDataFrame(list(quotas.items()), "n_mods long, n_reads long"), 6).toPandas()
    n = made.groupby("read_id")["pos"].agg(["count", "nunique"])
    assert (n["count"] == n["nunique"]).all() and n["count"].value_counts().to_dict() == {1: 5000, 5: 2500}
    odds = np.array(p) / (1 - np.array(p))
    for k, share in ((1, odds / odds.sum()), (5, 1 - (1 / odds) / (1 / odds).sum())):
        got = made[made["read_id"].isin(n.index[n["count"] == k])]["pos"].value_counts().reindex(range(6), fill_value=0) / quotas[k]
        assert np.allclose(got, share, atol=0.04)
    with pytest.raises(ValueError):
        nulls.independent_reads(rates.withColumn("rate", F.when(F.col("pos") > 2, F.col("rate")).otherwise(0.0)), spark.createDataFrame([(4, 1)], "n_mods long, n_reads long"), 6)


def test_registered_heterogeneity_uses_the_whole_plan(spark, monkeypatch, mixture):
    seen, analyse = [], heterogeneity.analyse
    monkeypatch.setattr(models, "order_mods", lambda *_: mixture[1])
    monkeypatch.setattr(heterogeneity, "analyse", lambda mods, s: seen.append(s) or analyse(mods, s))
    models.QUERIES["call_sites_normal"](spark, "")
    assert [(s.length, len(s.seeds), s.rounds, s.step) for s in seen] == [(models.L_ORDER, 20, 4, 10)]


def test_every_series_lies_on_itself(spark):
    x = spark.createDataFrame([(1, [1.0, 3.0, 2.0]), (2, [5.0]), (3, []), (4, [0.5, 4.0, 4.5, 0.1])], "id long, samples array<double>")
    got = sorted(tuple(r) for r in signals.align_self(x).collect())
    assert got == [(1, 0, 2, 2, 0.0), (2, 0, 0, 0, 0.0), (4, 0, 3, 3, 0.0)]


def test_series_with_equal_ends_lie_on_themselves_whole(spark):
    x = [(1, [1.0, 2.0, 2.0]), (2, [3.0, 3.0, 3.0, 3.0]), (3, [1.0, 1.0, 4.0, 1.0, 1.0]), (4, [float(v) for v in np.repeat(np.arange(30) % 7, 6)])]
    got = sorted(tuple(r) for r in signals.align_self(spark.createDataFrame(x, "id long, samples array<double>")).collect())
    assert got == [(k, 0, len(s) - 1, len(s) - 1, 0.0) for k, s in x]


def test_dtw_self_all_has_every_user(spark, monkeypatch):
    ev = spark.createDataFrame([(i, i % 3, i, float(i * 7 % 11)) for i in range(15)], "event_id long, user_id long, ts long, value double")
    monkeypatch.setattr(models, "table", lambda *_: ev)
    assert sorted(tuple(r) for r in models.QUERIES["dtw_self_all"](spark, "").collect()) == [(u, 0, 4, 0.0) for u in range(3)]


def test_em_on_the_driver_is_that_of_the_executors(spark, mixture):
    reads, mods = mixture[0], mixture[1]
    sets = mixtures.position_sets(reads, mods)
    local = mixtures.gathered(sets)
    w = mixtures.Weights.of(mixtures.hashed_start(3, 10), np.full(3, 1 / 3))
    a, b = mixtures.em_pass(sets, w), mixtures.em_pass(local, w)
    assert np.allclose(a.counts, b.counts) and np.allclose(a.totals, b.totals) and np.allclose((a.complete, a.marginal), (b.complete, b.marginal))
    assert mixtures.gathered(sets, 5) is None
    starts = [np.random.default_rng(k).beta(1.5, 20, (2, 10)) for k in range(4)]
    each = [mixtures.fit(sets, 2, 10, min_iters=2, threshold=0.01, starts=[x]) for x in starts]
    best = mixtures.fit(sets, 2, 10, min_iters=2, threshold=0.01, starts=starts)  # runs end at different rounds
    one = min(each, key=lambda m: m.bic)
    assert np.allclose(best.mu, one.mu, atol=1e-9) and best.converged == one.converged and len(best.trace) == len(one.trace)
    assert len({len(m.trace) for m in each}) > 1
    assert len(mixtures.fit(sets, 2, 10, min_iters=130, max_iters=100, threshold=np.inf).trace) == 130
    assert not mixtures.fit(sets, 2, 10, min_iters=2, max_iters=2, threshold=0.0).converged


def test_shuffled_library_reads_its_input_once_a_round(spark):
    rng = np.random.default_rng(3)
    mods = spark.createDataFrame([(f"r{i}", int(p)) for i in range(300) for p in rng.choice(30, 4, replace=False)], "read_id string, pos long")
    sizes = []
    for rounds in (1, 4):
        plan = nulls.shuffled_library(mods, [1, 2], rounds, 50)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append((plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation ["), plan.count("Window ")))
    assert sizes[0][0] == sizes[1][0] and sizes[1][1] == 4 * sizes[0][1]
    made, real = nulls.shuffled_library(mods, [1, 2], 4, 50).toPandas(), mods.toPandas()
    for seed in (1, 2):
        own = made[made["seed"] == seed]
        assert own.groupby("pos").size().equals(real.groupby("pos").size()) and own.groupby("read_id").size().equals(real.groupby("read_id").size())
        assert not own.duplicated().any()
        assert len(own.merge(real, on=["read_id", "pos"])) < 0.5 * len(real)


def test_tables_are_made_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(5)
    for _ in range(2):
        assert kept(spark, str(tmp_path / "t"), make).count() == 5
    assert made == [1]
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert kept(spark, str(tmp_path / "t"), make).count() == 5 and made == [1, 1]


def test_entropies_are_kept(spark, mixture, tmp_path):
    s = heterogeneity.Settings(10, window=4, step=2, components=3, seeds=(1, 2, 3), rounds=1)
    show = lambda t: sorted((r["start"], round(r["entropy"], 6), round(r["null_mean"], 6)) for r in t["tests"].collect())
    first = show(heterogeneity.analyse(mixture[1], s, str(tmp_path)))
    assert len(list(tmp_path.iterdir())) == 2 and first
    assert show(heterogeneity.analyse(mixture[1].limit(0), s, str(tmp_path))) == first == show(heterogeneity.analyse(mixture[1], s))


def test_leiden_refines():
    rng = np.random.default_rng(21)
    for _ in range(12):
        n = 60
        group = rng.integers(0, 5, n)
        a, b = np.nonzero(np.triu(rng.random((n, n)) < np.where(group[:, None] == group[None], 0.5, 0.05), 1))
        w = rng.random(len(a)) + 0.5
        plain, fine = (clustering.louvain(n, a, b, w, refine=r) for r in (False, True))
        assert clustering.modularity(fine, a, b, w) > clustering.modularity(plain, a, b, w) - 0.02
        nbrs = clustering._adjacency(n, a, b, w)[0]
        assert len(set(clustering._connected(n, nbrs, fine))) == len(set(fine))  # every community is connected
    # parts of a community that hang together by nothing aren't merged
    a, b = np.array([0, 1, 3, 4]), np.array([1, 2, 4, 5])
    nbrs, _ = clustering._adjacency(6, a, b, np.ones(4))
    degree = np.array([1.0, 2, 1, 1, 2, 1])
    part = clustering._refined(6, nbrs, degree, 8.0, np.zeros(6, int), 1.0, np.random.default_rng(0))
    assert not set(part[:3]) & set(part[3:])


def test_communities_of_string_ids_and_genes(spark):
    edges = [(g, f"{g}{a}", f"{g}{b}", 1.0) for g in "xy" for k in (0, 10) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [("x", "x3", "x10", 1.0)]
    reads = spark.createDataFrame([(g, f"{g}{i}") for g in "xy" for i in (*range(4), *range(10, 14), 99)], "gene string, read_id string")
    e = spark.createDataFrame(edges, "gene string, a string, b string, score double")
    got = {(r["gene"], r["read_id"]): r["cluster"] for r in communities.communities(reads, e, by=("gene",)).collect()}
    assert len(got) == 18 and got["x", "x99"] == "x99"
    assert all(got[g, f"{g}{i}"] == (f"{g}0" if i < 4 else f"{g}10") for g in "xy" for i in (*range(4), *range(10, 14)))
    one = communities.communities(reads.where("gene = 'x'").select("read_id"), e.where("gene = 'x'"))
    assert dict(one.dtypes) == {"read_id": "string", "cluster": "string"} and one.count() == 9


def test_lloyd_steps_lead_to_the_nearest_means(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((40, 12)) < 0.4).astype(int)
    reads = spark.createDataFrame([(i,) for i in range(40)], "read_id long")
    mods = spark.createDataFrame([(int(i), int(p)) for i, p in zip(*np.nonzero(x))], "read_id long, pos long")
    start = spark.createDataFrame([(i, i % 3) for i in range(40)], "read_id long, cluster long")
    got = {r["read_id"]: (r["cluster"], r["distance"]) for r in clustering.lloyd_step(reads, mods, start, 12).collect()}
    means = np.stack([x[np.arange(40) % 3 == k].mean(0) for k in range(3)])
    d = ((x[:, None, :] - means[None]) ** 2).sum(2)
    assert all(got[i][0] == int(np.round(d[i], 9).argmin()) and abs(got[i][1] - d[i].min()) < 1e-8 for i in range(40))


def test_readers_take_apart_what_stands_together(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mtx").write_text("%%MatrixMarket\n3 4 2\n1 1 1\n3 4 1\n")
    (tmp_path / "m" / "b.mtx").write_text("%%MatrixMarket\n% x\n2 9 2\n2 9 1\n1 2 0\n")
    got = {(r["matrix"].rsplit("/", 1)[1], r["row_idx"], r["pos"]) for r in readers.matrix_market(spark, str(tmp_path / "m"), named=True).collect()}
    assert got == {("a.mtx", 0, 0), ("a.mtx", 2, 3), ("b.mtx", 1, 8)}
    (tmp_path / "f.fa").write_text(">g1 first > second\nacg\nT\n\n>g2\nGG>x\n>g3\n")
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "f.fa")).orderBy("id").collect()] == [("g1", "ACGT"), ("g2", "GG>X"), ("g3", "")]
    (tmp_path / "p.svg").write_text('<svg>\n<text y="2.5"\n class="t" x="1">A</text><text x="3" y="4">G\n</text>\n<text x="3">no</text></svg>')
    assert sorted(tuple(r) for r in readers.svg_texts(spark, str(tmp_path / "p.svg")).collect()) == [(1.0, 2.5, "A"), (3.0, 4.0, "G\n")]
    (tmp_path / "d.csv").write_text("0,1,2\n0,1,1\n0,0,0\n")
    assert sorted((r["bits"], r["p"]) for r in readers.dense_table(spark, str(tmp_path / "d.csv"), ",").collect()) == [("000", []), ("011", [1, 2])]
    sam = "q\t{}\tr\t5\t9\t3M\t=\t9\t0\tACG\tIII\tMD:Z:3\n"
    (tmp_path / "x.sam").write_text("@HD\tx\n" + sam.format(99) + sam.format(99 + 256) + sam.format(2048 + 147))
    assert [r["flag"] for r in readers.sam(spark, str(tmp_path / "x.sam")).collect()] == [99] and readers.sam(spark, str(tmp_path / "x.sam"), True).count() == 3


def test_similarity_scores_are_over_the_length_of_the_query(spark):
    x = spark.createDataFrame([(1, [0.0, 2.0, 0.0])], "id long, samples array<double>")
    (r,) = signals.align(x, {"flat": np.zeros(5)}, normalise=False).collect()
    assert r["distance"] == 2.0 and abs(r["norm_score"] - 2 / 3) < 1e-12


def test_rejected_libraries_follow_the_margins(spark, mixture):
    reads, mods, _ = mixture
    got = heterogeneity.rejected_library(reads, mods, 10, limit=20_000)
    assert got["position_fit"].first()["r2"] > 0.8 and got["read_fit"].first()["r2"] > 0.9
    quotas = got["quotas"].collect()
    assert sum(r["quota"] for r in quotas) == 600 - reads.join(mods, "read_id", "left_anti").count() and all(r["n"] <= r["quota"] for r in quotas)


def test_imputed_matrices_and_the_hierarchical_prior(spark, mixture):
    reads, mods, bits = mixture
    few = mods.where("(read_id + 3 * pos) % 4 = 0")  # the percentile needs fewer ones than it leaves
    made = two_sample.imputed(reads, few, 10, 70)
    assert made.dtypes == mods.dtypes and few.count() <= made.count() <= 0.3 * bits.size + 1
    assert few.join(made, ["read_id", "pos"], "left_anti").count() == 0
    with pytest.raises(ValueError):
        two_sample.imputed(reads, mods, 10**6)
    conds = reads.withColumn("cond", F.col("read_id") % 2)
    for extra in ({"hierarchical": True}, {"impute": True}):
        s = two_sample.Settings(10, read_low=0.0, read_high=1.1, clusters=2, min_iters=5, max_iters=10, **extra)
        assert 1 <= two_sample.analyse(conds, few, s)["purity"].count() <= 2


def test_positions_by_gene(spark):
    mods = spark.createDataFrame([("a", 5), ("a", 5), ("a", 9), ("b", 9), ("b", 2)], "gene string, pos long")
    assert sorted(tuple(r) for r in filters.retained_positions(mods, ("gene",)).collect()) == [("a", 5, 0), ("a", 9, 1), ("b", 2, 0), ("b", 9, 1)]
    x = spark.createDataFrame([(g, p, float(p * k % 7), float(p * p % 5)) for g, k in (("a", 3), ("b", 2)) for p in range(12)], "gene string, pos long, x double, y double")
    both = sorted(tuple(r) for r in windows.window_correlation(x, 5, ("gene",)).collect())
    one = [("a", *r) for r in sorted(tuple(r) for r in windows.window_correlation(x.where("gene = 'a'"), 5).collect())]
    assert both[: len(one)] == one and len(both) == 2 * len(one)
    total = {(r["gene"], r["pos"]): r["total"] for r in windows.moving_sum(x, 4, "x", ("gene",)).collect()}
    assert total["b", 0] == 0.0 + 2.0


def test_matched_pairs():
    assert structure.matched("((..)())") == [(0, 7), (1, 4), (5, 6)]
    assert structure.matched("(()") == structure.matched("())") == structure.matched(None) == structure.matched("..") == []


def test_command_lines(spark, tmp_path):
    rng = np.random.default_rng(1)
    bits = (rng.random((60, 8)) < np.array([[0.1] * 4 + [0.9] * 4, [0.9] * 4 + [0.1] * 4])[np.arange(60) % 2]).astype(int)
    (tmp_path / "t.csv").write_text("\n".join([",".join(map(str, range(8))), *(",".join(map(str, r)) for r in bits)]) + "\n")
    for name in ("bmm", "hbbmm", "vi", "spaced"):
        out = str(tmp_path / name)
        cli.run(spark, [name, str(tmp_path / "t.csv"), out, "--runs", "2", "--min-iters", "5"])
        assert spark.read.text(f"{out}/posteriors").count() == 60 and spark.read.parquet(f"{out}/model/model_mu").count() == 8
        assert spark.read.parquet(f"{out}/log_runs").count() >= 1 and spark.read.parquet(f"{out}/histogram").agg(F.sum("n_reads")).first()[0] == 60
    cli.run(spark, ["simulate", str(tmp_path / "sim"), "--depth", "30", "--length", "20", "--rate", "0.2", "--methods", "kmeans", "ward"])
    assert spark.read.parquet(str(tmp_path / "sim" / "scores")).count() == 2


def test_ensembles(spark):
    dbs = ["((...))....", "((....))...", "((...))....", "....((...))", "...((....))", "....((...))", "....((...))"]
    structs = spark.createDataFrame(list(enumerate(dbs)), "struct_id long, db string")
    for method in ("kmeans", "bmm"):
        got = ensembles.analyse(structs, 11, ensembles.Settings(method=method), lambda reads: reads.withColumn("truth", (F.col("read_id") > 2).cast("long")))
        assert got["concordance"].first()[0] == 1.0
        assert {(r["n"], r["db"]) for r in got["centres"].collect()} == {(3, "((...))...."), (4, "....((...))")}
        (pair,) = got["similarity"].collect()
        assert abs(pair["similarity"] - (1 - 6 / 11)) < 1e-12 and abs(pair["jaccard"] - 4 / 10) < 1e-12
    made = ensembles.generated(spark.createDataFrame([("s", "ACGU", None)], "id string, seq string, reactivity array<double>"), lambda seq, react, t, n: ["." * len(seq)] * n, 3)
    assert made.count() == 3


def test_exploded_positions_are_not_broadcast(spark, tmp_path):
    """What an explode makes looks as small to the planner as the table it comes from; it must not be sent through the driver."""
    path = str(tmp_path / "orders.parquet")
    spark.range(2000).select(F.col("id").alias("o_orderkey")).write.parquet(path)
    for name in ("ensemble_centres", "ensemble_similarity", "ensemble_lloyd", "ensemble_concordance"):
        plan = ensemble_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        joined = [line for line in plan.splitlines() if "Join" in line]
        assert all("strategy=broadcast" in line for line in joined), (name, joined)
        made = {r[0] for r in ensemble_queries.QUERIES[name](spark, str(tmp_path)).limit(9).collect()}
        assert made
    reads = spark.createDataFrame([(i, i % 2) for i in range(6)], "read_id long, cluster long")
    mods = spark.createDataFrame([(i, p) for i in range(5) for p in range(i % 2, 4)], "read_id long, pos long")
    got = {r["cluster"]: (r["read_id"], r["distance"]) for r in relational.medoids(reads, mods).collect()}
    assert got == {0: (0, 0), 1: (1, 3)}
    assert clustering.lloyd_step(reads, mods, reads, 4).count() == 6


def test_shuffled_reads_are_shuffled_once(spark):
    rng = np.random.default_rng(3)
    mods = spark.createDataFrame([(f"r{i}", int(p)) for i in range(300) for p in rng.choice(30, 4, replace=False)], "read_id string, pos long")
    exchanges = []
    for rounds in (1, 4):
        made = nulls.shuffled_reads(mods, [1, 2], rounds, 20, 50)
        exchanges.append(made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert exchanges[0] == exchanges[1]
    assert all(len(set(r["p"])) == len(r["p"]) == 4 for r in made.collect()) and made.count() == 600
    # as many partitions as shares, whatever the setting
    assert made.rdd.getNumPartitions() == 12
    null = made.select("seed", "read_id", F.explode("p").alias("pos"))
    assert {(r["pos"], r["count"]) for r in mods.groupBy("pos").count().collect()} == {(r["pos"], r["count"] // 2) for r in null.groupBy("pos").count().collect()}


def test_pairs_are_counted_without_a_join_by_structure(spark):
    structs = spark.createDataFrame([(1, "a", "((..))"), (2, "a", "(....)"), (3, "a", "(...))"), (4, "b", "......")], "struct_id long, head string, db string")
    made = structure.pair_probabilities(structs, ("head",))
    assert "struct_id" not in [a.name() for a in _attributes(made)]
    assert sorted((r["head"], r["i"], r["j"], round(r["p"], 6)) for r in made.collect()) == [("a", 0, 5, 0.666667), ("a", 1, 4, 0.333333)]
    assert {r["head"]: r["db"] for r in structure.ensemble_centroids(structs, ("head",)).collect()} == {"a": "(....)", "b": "......"}


def _attributes(df):
    """Columns that the joins of a plan compare."""
    plan, found = df._jdf.queryExecution().optimizedPlan(), []
    stack = [plan]
    while stack:
        node = stack.pop()
        children = node.children()
        stack += [children.apply(k) for k in range(children.length())]
        if node.nodeName() == "Join" and node.condition().isDefined():
            names = node.condition().get().references().toSeq()
            found += [names.apply(k) for k in range(names.length())]
    return found
