"""Null libraries whose reads trade in arrays against those that trade in rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import nulls, windows
from strandlake.plans import heterogeneity


def test_keys_are_those_of_md5():
    names = np.array([b"7", b"123456", b"x" * 30, b"r12"])
    which = np.array([0, 2, 1, 2])
    for tails in ([b"|0", b"|0|5", b"|0|123"], [b"|" + b"y" * 40] * 3):
        want = [int(hashlib.md5(b"386|" + n + tails[k]).hexdigest()[:16], 16) for n, k in zip(names.tolist(), which)]
        assert nulls._keys(386, names, tails, which).tolist() == want


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"r{i}", lambda i: "a long name of a read, of more than a block " + str(i)])
def test_counts_are_those_of_the_traded_reads(spark, name):
    rng = np.random.default_rng(7)
    rows = [(name(7 * i), int(p)) for i in range(301) for p in rng.choice(30, rng.integers(1, 6), replace=False)]
    mods = spark.createDataFrame(rows, f"read_id {'string' if isinstance(name(0), str) else 'long'}, pos long")
    for rounds in (1, 3):
        reads = nulls.shuffled_reads(mods, [1, 386], rounds, 40, 90)
        want = {}
        for r in reads.collect():
            for i in r.p:
                for j in r.p:
                    if i <= j < i + 12:
                        want[r.seed, i, j] = want.get((r.seed, i, j), 0) + 1
        got = nulls.shuffled_cooccurrence(nulls.position_lists(mods), [1, 386], 30, 12, rounds, 40, 90)
        assert {(r.seed, r.i, r.j): r.n11 for r in got.collect()} == want


def test_simulated_windows_make_no_row_for_each_read_and_round(spark, monkeypatch):
    rng = np.random.default_rng(8)
    mods = spark.createDataFrame([(i, int(p)) for i in range(200) for p in rng.choice(10, 3, replace=False)], "read_id long, pos long")
    made = nulls.shuffled_reads(mods, [1, 2], 2).withColumn("p", F.array_sort("p"))
    want = windows.window_entropy_of_sets(made, 10, 6, 2, 3, ("seed",)).collect()
    monkeypatch.setattr(nulls, "_traded", None)
    got = heterogeneity.analyse(mods, heterogeneity.Settings(10, 6, 2, 3, seeds=(1, 2), rounds=2))["simulated"].collect()
    show = lambda rows: sorted((r.seed, r.start, round(r.entropy, 9)) for r in rows)
    assert show(got) == show(want)
