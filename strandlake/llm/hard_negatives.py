"""Hard negatives by a pivot table.

Inner products become distances: with M the largest norm, a row x gets one more component sqrt(M^2 - |x|^2) and an anchor q the
component 0, so that |q' - x'|^2 = |q|^2 + M^2 - 2 qx. The table holds each row's distances to some pivots. By the triangle
inequality |d(q', p') - d(p', x')| <= d(q', x') <= d(q', p') + d(p', x'), so every pivot brackets every score; a row is checked
exactly only if its bracket allows it into a result, first for whole blocks of rows (the least and largest distance to each pivot),
then row by row. Rows of a partition are sorted by their nearest pivot, which keeps the blocks' ranges narrow.

Anchors go to the tasks in chunks of bounded size; each chunk is one pass over the table for its positives and one for its
negatives. A task holds the best few of its own rows for each anchor and sends only these, so no group meets in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, prepare, shared_dir

PIVOTS = 16
#: Pivots are picked, each farthest from those before it, among so many rows that a hash picks.
PIVOT_SAMPLE = 1024
#: About so many bytes of anchors are with the tasks at a time, and so many of them are compared with a block at a time.
ANCHOR_BYTES, ANCHOR_ROWS = 32 << 20, 256
#: Above this share of a block's pairs, survivors are checked by one matrix product, below it pair by pair.
DENSE = 0.125
LAST_ID = np.iinfo(np.int64).max


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """int64 rows of dim components; shorter vectors end in zeros."""
    n, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class _Space:
    """What holds for all rows: components, the largest norm, and whether doubles hold every score exactly."""

    def __init__(self, dim: int, largest: float, top: float):
        self.dim, self.top2 = dim, top
        self.stored = np.dtype("<i2" if largest < 1 << 15 else "<i8")
        # scores are multiplied by a block's rows and must stay whole numbers
        self.kind = np.float64 if dim * largest * largest * (1 << 12) < 2**53 else object
        self.slack = 1e-6 * np.sqrt(top)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """With the further component."""
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.top2 - (x * x).sum(1), 0))]

    @staticmethod
    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
        return np.sqrt(np.maximum(d2, 0))


def _whole(x: np.ndarray) -> np.ndarray:
    """Scores as int64; beyond its range they stay at its ends."""
    if x.dtype != object:
        return x.astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(max(int(v), low), high) for v in x.ravel()], np.int64).reshape(x.shape)


class _Best:
    """For each anchor and window the best k rows so far: by score from above, then by id."""

    def __init__(self, anchors: int, windows: int, k: int, kind):
        self.score = np.full((anchors, windows, k), -np.inf, kind)
        self.id = np.full((anchors, windows, k), LAST_ID, np.int64)

    def add(self, at: np.ndarray, j: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[at, j], score], 1), np.concatenate([self.id[at, j], ids], 1)
        k = self.score.shape[2]
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[at, j], self.id[at, j] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


class _Anchors:
    """A chunk of anchors, as numpy arrays; windows (anchors x windows) hold the least and largest score wanted."""

    def __init__(self, space: _Space, table: pa.Table, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), space.stored).reshape(-1, space.dim)
        self.x, self.low, self.high, self.same = x.astype(space.kind), low, high, same
        f = x.astype(np.float64)
        self.norm2 = (f * f).sum(1)
        self.apart = space.apart(np.c_[f, np.zeros(len(f))], space.raised(pivots)).astype(np.float32)


def _scan(space: _Space, a: _Anchors, best: _Best, part: slice, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, apart: np.ndarray, seen: np.ndarray) -> None:
    """Put what a block (sorted by id) has for the anchors of part into best. seen: pairs met, left after the blocks' brackets, left
    after the rows' brackets."""
    k = best.score.shape[2]
    at = np.arange(part.start, part.stop)
    seen[0] += len(at) * len(ids)
    # a row must reach the least of the windows' bounds, or of what they have already, and not be beyond all windows
    need = np.maximum(a.low[at], best.score[at, :, -1]).min(1).astype(np.float64)
    most = a.high[at].max(1).astype(np.float64)

    def bracket(near: np.ndarray, far: np.ndarray, keep: np.ndarray) -> np.ndarray:
        base = a.norm2[at[keep]] + space.top2
        base = base.reshape(-1, *[1] * (near.ndim - 1))
        upper = (base - np.square(np.maximum(near - space.slack, 0))) / 2 + 1
        lower = (base - np.square(far + space.slack)) / 2 - 1
        shape = (-1, *[1] * (near.ndim - 1))
        return (upper >= need[keep].reshape(shape)) & (lower <= most[keep].reshape(shape))

    first, last = apart.min(0)[None], apart.max(0)[None]
    mine = a.apart[at]
    alive = bracket(np.maximum(np.maximum(first - mine, mine - last), 0).max(1), (mine + last).min(1), np.arange(len(at)))
    at, mine, need, most = at[alive], mine[alive], need[alive], most[alive]
    seen[1] += len(at) * len(ids)
    if not len(at):
        return
    near, far = np.zeros((len(at), len(ids)), np.float32), np.full((len(at), len(ids)), np.inf, np.float32)
    for p in range(apart.shape[1]):
        np.maximum(near, np.abs(mine[:, p : p + 1] - apart[None, :, p]), out=near)
        np.minimum(far, mine[:, p : p + 1] + apart[None, :, p], out=far)
    allowed = bracket(near, far, np.arange(len(at)))
    seen[2] += int(allowed.sum())
    allowed &= (a.label[at][:, None] == labels[None]) == a.same
    allowed &= a.row[at][:, None] != rows[None]
    some, cols = allowed.any(1), np.flatnonzero(allowed.any(0))
    at, allowed = at[some], allowed[np.ix_(some, cols)]
    if not len(at):
        return
    ids, x, m = ids[cols], x[cols].astype(space.kind), len(cols)
    if space.kind is object or allowed.mean() > DENSE:
        score = a.x[at] @ x.T
    else:
        i, j = np.nonzero(allowed)
        score = np.zeros((len(at), m))
        for s in range(0, len(i), 1 << 14):
            score[i[s : s + (1 << 14)], j[s : s + (1 << 14)]] = np.einsum("ij,ij->i", a.x[at][i[s : s + (1 << 14)]], x[j[s : s + (1 << 14)]])
    # unique keys: of equal scores the smaller id is better, and ids rise along the block
    keys = score * m + np.arange(m - 1, -1, -1)
    for w in range(a.low.shape[1]):
        fits = allowed & (score >= a.low[at, w][:, None]) & (score <= a.high[at, w][:, None])
        here = np.where(fits, keys, -np.inf)
        top = here.max(1)
        go = np.flatnonzero((top > -np.inf) & (top >= best.score[at, w, -1] * m))
        if not len(go):
            continue
        here = here[go]
        pick = np.argpartition(here, m - k, axis=1)[:, m - k :] if m > k and space.kind is np.float64 else np.argsort(-here, axis=1)[:, :k]
        fine = np.take_along_axis(here, pick, 1) > -np.inf
        best.add(at[go], w, np.where(fine, np.take_along_axis(score[go], pick, 1), -np.inf), np.where(fine, ids[pick], LAST_ID))


def _best(space: _Space, table: DataFrame, chunk: pa.Table, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, counts: list) -> DataFrame:
    """(anchor, window, id, score, rank): for each anchor (its place in chunk) and window the first k rows of the same label, or of
    others. counts: accumulators for the pairs met, left by the blocks' brackets, left by the rows' brackets."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((chunk, pivots, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pivots, low, high = shared.value
        a, seen = _Anchors(space, table, pivots, low, high, same), np.zeros(3, np.int64)
        best = _Best(len(a.row), low.shape[1], k, space.kind)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").fill_null(LAST_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), space.stored).reshape(-1, space.dim)[order]
            apart = np.frombuffer(b"".join(b.column("apart").to_pylist()), "<f4").reshape(len(order), -1)[order]
            rows, labels = b.column("row").to_numpy()[order], b.column("label").to_numpy()[order]
            for s in range(0, len(a.row), ANCHOR_ROWS):
                _scan(space, a, best, slice(s, min(s + ANCHOR_ROWS, len(a.row))), rows, ids[order], labels, x, apart, seen)
        for total, n in zip(counts, seen.tolist()):
            total.add(n)
        i, w, r = np.nonzero(best.score > -np.inf)
        ids = best.id[i, w, r]
        for s in range(0, len(i), 10_000):
            t = slice(s, s + 10_000)
            cols = [pa.array(i[t].astype(np.int32)), pa.array(w[t].astype(np.int32)), pa.array(ids[t], mask=ids[t] == LAST_ID), pa.array(_whole(best.score[i[t], w[t], r[t]]))]
            yield pa.RecordBatch.from_arrays(cols, ["anchor", "win", "id", "score"])

    prepare(spark)
    found = table.select("row", "vec_id", "label", "vec", "apart").mapInArrow(run, "anchor int, win int, id long, score long")
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _integers(df: DataFrame, anchor: Column, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(row, vec_id, label, v, anchor) of the rows that take part, components as whole numbers."""
    x = F.col("v")
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(x, lambda c: F.floor(c * scale)).alias("v"), "anchor")


def _measure(rows: DataFrame) -> tuple[int, float, float, int]:
    """Components, the largest one, the largest squared norm, and anchors of all rows."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            dim = pc.max(pc.list_value_length(b.column("v"))).as_py()
            x = _vectors(b.column("v"), dim).astype(np.float64)
            return pa.RecordBatch.from_pylist([{"dim": dim, "largest": float(np.abs(x).max(initial=0)), "top": float((x * x).sum(1).max()), "n": int(b.column("anchor").to_numpy(zero_copy_only=False).sum())}])

        return step

    got = map_arrow(rows.select("v", "anchor"), make, "dim long, largest double, top double, n long").agg(F.max("dim"), F.max("largest"), F.max("top"), F.sum("n")).first()
    return got[0] or 0, got[1] or 0.0, got[2] or 0.0, got[3] or 0


def _pivots(space: _Space, rows: DataFrame, count: int) -> np.ndarray:
    """Rows far from each other in the raised space; PIVOT_SAMPLE rows, picked by a hash, are looked at."""
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", "row")).limit(PIVOT_SAMPLE).toArrow()
    x = _vectors(sample.column("v").combine_chunks(), space.dim)
    high, picked = space.raised(x), [0]
    away = space.apart(high, high[:1])[:, 0]
    while len(picked) < min(count, len(x)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, space.apart(high, high[picked[-1:]])[:, 0])
    return x[picked]


def pivot_table(rows: DataFrame, space: _Space, pivots: np.ndarray) -> DataFrame:
    """(row, vec_id, label, vec, apart, anchor): apart holds the distances to the pivots; rows of a partition are sorted by the nearest."""
    high = space.raised(pivots)

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            x = _vectors(b.column("v"), space.dim)
            apart = space.apart(space.raised(x), high).astype("<f4")
            vec = pa.array([r.tobytes() for r in x.astype(space.stored)], pa.binary())
            near = pa.array(apart.argmin(1).astype(np.int32))
            cols = [*(b.column(c) for c in ("row", "vec_id", "label")), vec, pa.array([r.tobytes() for r in apart], pa.binary()), near, b.column("anchor")]
            return pa.RecordBatch.from_arrays(cols, ["row", "vec_id", "label", "vec", "apart", "near", "anchor"])

        return step

    made = map_arrow(rows, make, "row long, vec_id long, label long, vec binary, apart binary, near int, anchor boolean")
    return made.sortWithinPartitions("near", F.substring("apart", 1, 4)).drop("near")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS, anchor_bytes: int = ANCHOR_BYTES, stats: list | None = None,
) -> DataFrame:
    """For each anchor and each of its positives the first hard negatives: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Components become floor(scale * x) and a score is the integer inner product; higher scores come first, ties by smaller id. An
    anchor's positives are its first `positives` other rows of the same label; its negatives those of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. All are exact: the brackets only leave out what can't be
    in a result.

    Rows with a null label, a null vector or a null or non-finite component take no part; null ids take part after all others of
    their score, and are no anchors unless `anchor` says so. Rows are told apart by themselves, not by their ids: of a row that stands
    twice one is a positive of the other. Shorter vectors count as ending in zeros. Components and scores beyond 64 bits stay at
    the ends of that range. An empty table, or one without anchors, gives no rows. Other columns of df are not read.

    stats: gets, for each pass, the number of pairs met, left by the blocks' brackets, and left by the rows' brackets, whatever their labels.
    """
    spark = df.sparkSession
    rows = _integers(df, anchor, id_col, vec_col, label_col, scale)
    dim, largest, top, n = _measure(rows)
    if not n:
        return spark.createDataFrame([], OUT)
    space = _Space(max(dim, 1), largest, top)
    chosen = _pivots(space, rows, pivots)
    table, _ = materialize(pivot_table(rows, space, chosen), "pivot-table")
    chunks = -(-n * (8 * (space.dim + len(chosen)) + 100) // anchor_bytes)
    path = f"{shared_dir(spark)}/strandlake/negatives-{uuid.uuid4().hex}"
    for c in range(chunks):
        anchors = table.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c)
        chunk = anchors.select("row", "vec_id", "label", "vec").toArrow()  # about anchor_bytes
        if not chunk.num_rows:
            continue
        every = np.zeros((chunk.num_rows, 1))
        counts = [[spark.sparkContext.accumulator(0) for _ in range(3)] for _ in range(2)]
        first = _best(space, table, chunk, chosen, every - np.inf, every + np.inf, True, positives, counts[0])
        near = first.select("anchor", "id", "score", "rank").toArrow()  # `positives` rows an anchor
        at, rank, score = (near.column(x).to_numpy() for x in ("anchor", "rank", "score"))
        bounds = np.full((2, chunk.num_rows, positives), np.inf, object if space.kind is object else np.float64)
        bounds[1] = -np.inf  # nothing is wanted of a positive that isn't there
        whole = score.astype(object) if space.kind is object else score
        bounds[0][at, rank - 1], bounds[1][at, rank - 1] = -(-low * whole // 100), high * whole // 100
        second = _best(space, table, chunk, chosen, bounds[0], bounds[1], False, negatives, counts[1])
        names = spark.createDataFrame(pa.table({"anchor": pa.array(at), "win": pa.array(rank - 1), "positive_id": near.column("id"), "positive_score": near.column("score"), "anchor_id": chunk.column("vec_id").take(pa.array(at))}))
        found = second.join(F.broadcast(names), ["anchor", "win"])
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.write.mode("append").parquet(path)
        if stats is not None:
            stats += [[x.value for x in c] for c in counts]
    return spark.read.schema(OUT).parquet(path)

