"""Passes over few position sets."""

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import mixtures


def test_few_sets_are_few_tasks(spark):
    reads = spark.range(300).withColumnRenamed("id", "read_id")
    mods = reads.selectExpr("read_id", "explode(array(read_id % 7, 7 + read_id % 11)) as pos")
    sets = mixtures.position_sets(reads, mods).repartition(50, "p")
    kept = mixtures.kept_sets(sets)
    assert kept.rdd.getNumPartitions() <= 4
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, sets.collect()))
    kept.unpersist()


def test_a_pass_reads_packed_sets(spark):
    """Sets come as a row a batch, and a pass has no shuffle; the sums are those of a dense matrix."""
    rng = np.random.default_rng(5)
    x = rng.random((700, 30)) < 0.1
    x[:20] = False
    sets = spark.createDataFrame([(np.flatnonzero(r).tolist(), int(w)) for r, w in zip(x, rng.integers(1, 5, len(x)))], "p array<int>, weight long")
    weight = np.array([r.weight for r in sets.collect()], float)
    kept = mixtures.kept_packed(sets.repartition(2))
    assert kept.count() <= 4 and tuple(kept.agg(F.sum("n"), F.sum("ones")).first()) == (weight.sum(), weight @ x.sum(1))
    runs = [mixtures.Weights.of(rng.beta(1.5, 20, (3, 30)), np.full(3, 1 / 3)) for _ in range(2)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("a pass", "")
    got = mixtures.em_passes(kept, runs)
    stages = [len(jobs.getJobInfo(j).stageIds) for j in jobs.getJobIdsForGroup("a pass")]
    spark.sparkContext.setJobGroup("", "")
    assert stages == [1]
    for w, sums in zip(runs, got):
        ll = x @ w.by_pos.T + w.const
        total = np.logaddexp.reduce(ll, axis=1)
        post = np.exp(ll - total[:, None]) * weight[:, None]
        assert np.allclose(sums.counts, post.T @ x) and np.allclose(sums.totals, post.sum(0))
        assert np.isclose(sums.complete, (post * ll).sum()) and np.isclose(sums.marginal, weight @ total)
    wide = mixtures.Weights.of(np.full((3, 5000), 0.1), np.full(3, 1 / 3))
    assert np.allclose(mixtures.em_pass(kept, wide).counts[:, :30].sum(0), weight @ x)
    kept.unpersist()
