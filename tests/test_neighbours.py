"""Nearest reads against all pairs."""

import numpy as np
import pytest

from strandlake.operators import neighbours


def tables(spark, x, genes=None):
    n = len(x)
    gene = ["g"] * n if genes is None else genes
    reads = spark.createDataFrame([(i, gene[i]) for i in range(n)], "read_id long, gene string")
    mods = spark.createDataFrame([(int(i), int(p), gene[i]) for i, p in zip(*np.nonzero(x))], "read_id long, pos long, gene string")
    return reads, mods


def wanted(x, k, jaccard, genes=None):
    x = x.astype(int)
    n, shared = x.sum(1), x @ x.T
    both = n[:, None] + n[None]
    out = []
    for a in range(len(x)):
        others = [b for b in range(len(x)) if b != a and (genes is None or genes[a] == genes[b]) and (shared[a, b] or not jaccard)]
        value = {b: shared[a, b] / (both[a, b] - shared[a, b]) if jaccard else int(both[a, b] - 2 * shared[a, b]) for b in others}
        order = sorted(others, key=lambda b: (-value[b] if jaccard else value[b], b))[:k]
        out += [(a, r + 1, b, value[b]) for r, b in enumerate(order)]
    return out


@pytest.mark.parametrize("jaccard", [True, False])
@pytest.mark.parametrize(("density", "k", "width"), [(0.03, 6, 20), (0.3, 4, 20), (0.3, 100, 20), (0.05, 5, 150)])
def test_nearest_reads(spark, jaccard, density, k, width):
    """Reads that share nothing are neighbours by L1 too, and reads that share with most of the small ones find theirs."""
    rng = np.random.default_rng(31)
    x = rng.random((70, width)) < density * np.linspace(0.2, 2, 70)[:, None]
    x[40:48] = x[3]
    f = neighbours.nearest_by_jaccard if jaccard else neighbours.nearest_by_l1
    got = sorted(tuple(r) for r in f(*tables(spark, x), k, block=7).collect())
    assert got == wanted(x, k, jaccard)


@pytest.mark.parametrize("jaccard", [True, False])
def test_rounds_and_groups(spark, jaccard):
    """Samples that grow over three rounds; genes are done together and never meet."""
    rng = np.random.default_rng(32)
    x = rng.random((600, 30)) < 0.15
    genes = [f"g{i % 3}" for i in range(600)]
    f = neighbours.nearest_by_jaccard if jaccard else neighbours.nearest_by_l1
    got = sorted((r.a, r["rank"], r.b, r[4]) for r in f(*tables(spark, x, genes), 2, by=("gene",), seed_block=9).collect())
    assert got == wanted(x, 2, jaccard, genes)


def test_pairs_are_made_in_proportion_to_reads(spark):
    """Clusters of reads with few changes each: what is made per read and neighbour doesn't grow with the table."""
    rng = np.random.default_rng(33)
    made = []
    for n in (500, 4000):
        x = np.repeat(rng.random((n // 20, 60)) < 0.2, 20, 0) ^ (rng.random((n, 60)) < 0.02)
        made.append(neighbours.near_pairs_by_jaccard(*tables(spark, x), 5, seed_block=64).count() / (5 * n))
    assert made[1] < 1.5 * made[0] < 15


@pytest.mark.parametrize("jaccard", [True, False])
@pytest.mark.parametrize("width", [24, 90])
def test_lookups_by_subsets(spark, monkeypatch, jaccard, width):
    """Each pair is taken once, whatever the sizes, levels and copies of its reads; large reads are looked up by fewer positions."""
    monkeypatch.setattr(neighbours, "LISTED", 1)
    monkeypatch.setattr(neighbours, "SUBSETS", 40)
    rng = np.random.default_rng(34)
    x = rng.random((300, width)) < np.linspace(0.02, 0.45, 300)[:, None]
    x[50:70], x[200:215] = x[50], x[200]
    f = neighbours.nearest_by_jaccard if jaccard else neighbours.nearest_by_l1
    got = sorted(tuple(r) for r in f(*tables(spark, x), 4, block=20, seed_block=8).collect())
    assert got == wanted(x, 4, jaccard)


def test_pairs_looked_at_follow_reads(spark):
    """Reads without clusters: lists that are looked up stay about as long with eight times the reads (single positions: 8 times as long)."""
    rng = np.random.default_rng(35)
    looked = []
    for n in (1000, 8000):
        sets, _ = neighbours.position_sets(*tables(spark, rng.random((n, 64)) < 0.115))
        level, _ = neighbours._level(sets, ())
        looked.append(n * 0.115**level)
    assert looked[1] < 2 * looked[0]
    sizes = list(range(1, 19))
    assert neighbours._asks(sizes, 3, True, 1024)(7, 1.0) == [(3, 0, 7, 3)]


@pytest.mark.parametrize("jaccard", [True, False])
def test_guesses_that_fail(spark, monkeypatch, jaccard):
    """Reads that find fewer than k by a guess are looked up again."""
    monkeypatch.setattr(neighbours, "SPREAD", -1)
    x = np.random.default_rng(36).random((500, 30)) < 0.2
    f = neighbours.nearest_by_jaccard if jaccard else neighbours.nearest_by_l1
    got = sorted(tuple(r) for r in f(*tables(spark, x), 12, seed_block=40).collect())
    assert got == wanted(x, 12, jaccard)


def test_copies_are_listed_as_often_as_they_can_be_near(spark):
    """A group of copies makes pairs in proportion to it and not to its square."""
    x = np.zeros((400, 12), bool)
    x[:, 2:5] = True
    x[300:, 6] = True
    assert neighbours.near_pairs_by_jaccard(*tables(spark, x), 3).count() <= 400 * 4
    assert sorted(tuple(r) for r in neighbours.nearest_by_jaccard(*tables(spark, x), 3).collect()) == wanted(x, 3, True)


def test_empty_tables(spark):
    reads, mods = tables(spark, np.zeros((3, 4), bool))
    assert neighbours.nearest_by_jaccard(reads, mods, 2).count() == 0
    assert sorted(tuple(r) for r in neighbours.nearest_by_l1(reads, mods, 2).collect()) == wanted(np.zeros((3, 4)), 2, False)
    assert neighbours.nearest_by_l1(reads.limit(0), mods, 2).count() == 0
