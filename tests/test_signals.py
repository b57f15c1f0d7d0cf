"""Alignment of signals against a table filled cell by cell."""

import numpy as np
import pytest

from strandlake.operators import signals


def brute(query, reference):
    """Cost, and the path that prefers the diagonal, then the cell above."""
    m, n = len(query), len(reference)
    c = np.full((m, n), np.inf)
    for i in range(m):
        for j in range(n):
            step = (query[i] - reference[j]) ** 2
            ways = [c[i - 1, j - 1] if i and j else np.inf, c[i - 1, j] if i else np.inf, c[i, j - 1] if i and j else np.inf]
            c[i, j] = step + (min(ways) if i else 0)
    i, j = m - 1, int(np.argmin(c[-1]))
    cost, path = c[i, j], [(i, j)]
    while i:
        ways = [c[i - 1, j - 1] if j else np.inf, c[i - 1, j], c[i, j - 1] if j else np.inf]
        k = int(np.argmin(ways))
        i, j = i - (k != 2), j - (k != 1)
        path.append((i, j))
    return cost, path[::-1]


def some(rng, n, low=1, high=30, whole=False):
    return [rng.integers(0, 4, k).astype(float) if whole else rng.normal(size=k) for k in rng.integers(low, high, n)]


@pytest.mark.parametrize("bits_bytes", [signals.BITS_BYTES, 300])
@pytest.mark.parametrize("whole", [False, True])
def test_paths_are_those_of_the_whole_table(bits_bytes, whole):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        queries, reference = some(rng, 12, whole=whole), some(rng, 1, n, n + 1, whole)[0]
        cost, paths = signals.paths(queries, reference, bits_bytes)
        for q, c, p in zip(queries, cost, paths):
            want, path = brute(q, reference)
            assert c == pytest.approx(want) and list(map(tuple, p.tolist())) == path


@pytest.mark.parametrize("whole", [False, True])
def test_cascade_finds_the_nearest_reference(whole, monkeypatch):
    monkeypatch.setattr(signals, "LOOK", 5)
    rng = np.random.default_rng(4)
    references = some(rng, 25, 3, 60, whole)
    queries = some(rng, 40, 2, 40, whole) + [r.copy() for r in references[::5]]
    which, cost, end, left = signals.cascade(queries, references)
    for k, q in enumerate(queries):
        all_costs = [brute(q, r) for r in references]
        best = min(c for c, _ in all_costs)
        assert cost[k] == pytest.approx(best)
        first = min(r for r, (c, _) in enumerate(all_costs) if c == pytest.approx(best))
        assert which[k] == first or all_costs[which[k]][0] == pytest.approx(best)
        assert end[k] == all_costs[which[k]][1][-1][1]
    assert (left[:, 1] <= left[:, 0]).all() and left[:, 1].mean() < len(references)


def test_bounds_leave_most_references_out():
    rng = np.random.default_rng(5)
    references = [np.cumsum(rng.normal(size=300)) + 40 * k for k in range(30)]
    queries = [references[k][50:120] + rng.normal(scale=0.1, size=70) for k in rng.integers(0, 30, 50)]
    which, _, _, left = signals.cascade(queries, references)
    assert left[:, 1].mean() < 5
    assert [int(w) for w in which] == [min(range(30), key=lambda r: signals.paths([q], references[r])[0][0]) for q in queries]


def test_long_signals_in_bounded_memory():
    rng = np.random.default_rng(6)
    reference = np.cumsum(rng.normal(size=6000))
    query = np.repeat(reference[1000:3000], 2) + rng.normal(scale=0.01, size=4000)
    cost, (path,) = signals.paths([query], reference, 1 << 20)
    assert cost[0] < 4 and abs(path[0, 1] - 1000) < 3 and abs(path[-1, 1] - 2999) < 3
    assert (np.diff(path, axis=0).sum(1) >= 1).all() and (np.diff(path, axis=0) <= 1).all()


def test_reads_are_cut_skipped_and_left_null(spark):
    rows = [
        ("a", [0.0, 1.0, 2.0, 9.0, 9.0], 3, True), ("b", [0.0, 1.0], 2, False), ("c", [1.0, 2.0], 0, True), ("d", [], None, True),
        ("e", None, 1, True), ("f", [1.0, None], None, True), ("g", [5.0, 5.0, 7.0], -1, None), ("h", [2.0, float("nan")], 1, True), ("i", [3.0], None, True),
    ]
    reads = spark.createDataFrame(rows, "read_id string, samples array<double>, index_of_adapter int, success boolean").repartition(2)
    ramp = {"ramp": np.arange(6.0), "none": np.array([])}
    got = {(r.read_id, r.ref_gene): r for r in signals.align_reads(reads, ramp, ["ramp", "none", "unknown"], normalise=False).collect()}
    assert {k for k in got if k[1] is None} == {("b", None), ("g", None)} and len(got) == 7 * 3 + 2
    a = got["a", "ramp"]
    assert [(p["sample"], p["place"]) for p in a.path] == [(0, 0), (1, 1), (2, 2)] and (a.score, a.query_align_len, a.norm_score, a.success_align) == (0.0, 2, 0.0, True)
    assert got["a", "none"].path is None and got["a", "none"].success_align and got["a", "unknown"].score is None
    for k in "cdefh":
        assert got[k, "ramp"].path is None and not got[k, "ramp"].success_align
    assert got["i", "ramp"].score == 0.0 and not got["b", None].success_align
    assert signals.align_reads(reads.limit(0), ramp).count() == 0
    assert signals.align_reads(reads, {}, []).where("success_align").count() == 0


def test_nearest_reference_and_paths_of_tables(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0]), (2, [30.0]), (3, []), (4, None)], "id long, samples array<double>")
    refs = {"low": np.arange(5.0), "high": np.arange(30.0, 40.0), "void": np.array([]), "also": np.arange(5.0)}
    got = sorted(map(tuple, signals.nearest_reference(x, refs, normalise=False).collect()))
    assert got == [(1, "also", 2, 0.0), (2, "high", 0, 0.0)]
    assert signals.nearest_reference(x, {}).count() == 0
    (r, *_) = signals.align(x, {"low": refs["low"]}, normalise=False, with_path=True).orderBy("id").collect()
    assert [tuple(p) for p in r.path] == [(0, 1), (1, 2)]
