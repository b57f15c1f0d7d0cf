"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import hard_negatives, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, apart double, score int, v string"


def brute(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    """All results; rows are (vec_id, embedding, label)."""
    taken = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    out = []
    for a, (i, v, label) in enumerate(taken):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, m) for b, (j, w, m) in enumerate(taken) if b != a]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:positives]:
            fit = [s for s in scored if s[4] != label and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(i, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 1, "y") for r in rows], SCHEMA).repartition(3)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def clustered(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dim))
    at = rng.integers(0, 5, n)
    return [(int(i), (centres[c] + rng.normal(0, 0.05, dim)).tolist(), int((c + (rng.random() < 0.3)) % 5)) for i, c in enumerate(at)]


ODD = [
    (None, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], 1), (3, None, 1), (4, [1.0] * 6, None), (5, [float("nan")] * 6, 2), (6, [float("inf")] * 6, 2),
    (7, [None] * 6, 0), (50, [], 1), (100, [1.0], 1), (150, [0.0] * 6, 2), (200, [-1.0] * 7, 3), (-50, [0.3] * 6, 1), (11, [0.3] * 6, 2),
]


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 700])
def test_equal_to_all_pairs(spark, anchor_bytes):
    rows = clustered(300, 1) + ODD + [ODD[-1]] * 40 + [(250, [0.3] * 6, 1)] * 2
    stats = []
    assert mined(table(spark, rows), anchor_bytes=anchor_bytes, stats=stats) == brute(rows)
    assert len(stats) >= 2 and all(a >= b >= c for a, b, c in stats)


def test_ties_in_large_groups_of_copies(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(400)] + [(1000 + i, [0.4, 0.2], 2) for i in range(300)]
    assert mined(table(spark, rows)) == brute(rows)


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 4) * 1e5).tolist(), i % 3) for i in range(120)]
    assert mined(table(spark, rows)) == brute(rows)
    huge = [(i, [3e38, -3e38], i % 2) for i in range(60)]  # beyond 64 bits: held at the ends of the range
    assert all(abs(r[4]) <= 2**63 and abs(r[5]) <= 2**63 for r in mined(table(spark, huge), low=0, high=100))


def test_brackets_leave_far_rows_out(spark):
    stats = []
    rows = clustered(4000, 5, dim=3)
    assert mined(table(spark, rows), stats=stats) == brute(rows)
    # what the brackets alone leave, whatever the labels
    (met, _, left), (met_again, _, left_again) = stats
    assert left < 0.8 * met and left_again < 0.35 * met_again


def test_other_counts_and_windows(spark):
    rows = clustered(200, 9)
    more = {"positives": 2, "negatives": 4, "low": 10, "high": 120}
    assert mined(table(spark, rows), **more) == brute(rows, **more)


def test_query_without_rows_or_anchors(spark, tmp_path):
    for name, rows in (("none", []), ("no_anchor", [(1, [1.0], 0), (2, [1.0], 0)]), ("alone", [(50, [1.0], 0)])):
        spark.createDataFrame([(*r, "x", 0.5, 1, "y") for r in rows], SCHEMA).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = op12_hard_negatives.query(spark, str(tmp_path / name))
        assert got.count() == 0 and got.columns[0] == "anchor_id"
