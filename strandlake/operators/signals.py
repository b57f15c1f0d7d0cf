"""Subsequence alignment of raw signals to reference signals by dynamic time warping.

A query is matched whole; it may start and end anywhere in the reference. Cell (i, j) of the cost table is the squared difference
of sample i and place j plus the least of the cells (i-1, j-1), (i-1, j) and (i, j-1); row 0 has the difference alone.

The tables of all queries of a batch are filled together, one anti-diagonal at a time: its cells depend on the two before it only,
so a step is a few numpy operations over queries x rows. For the warping path each cell leaves two bits (came from above, came from
the left; else from both). Bits of long tables are made twice: the two front lines are kept at the start of each stretch of
diagonals, and the path is traced back stretch by stretch from there, so memory does not grow with the product of the lengths.

The nearest of many references is found by a cascade: bounds from the reference's range, then from its nearest values, then the
table itself, which is left as soon as nothing in it can become better than what is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that the fronts of the queries filled together take, and those of the bits of one stretch of diagonals.
FRONT_BYTES, BITS_BYTES = 8 << 20, 64 << 20
#: Diagonals between two looks at whether a table can be left.
LOOK = 64


def scaled(x: np.ndarray) -> np.ndarray:
    s = x.std()
    return (x - x.mean()) / s if s > 0 else np.zeros_like(x)


class _Tables:
    """The cost tables of some queries on one reference, diagonal by diagonal."""

    def __init__(self, queries: list[np.ndarray], reference: np.ndarray, late: bool = False):
        self.late = late  # of equal ends the last one
        self.size = np.array([len(q) for q in queries])
        self.rows, self.n, self.back = int(self.size.max()), len(reference), reference[::-1].copy()
        self.q = np.zeros((len(queries), self.rows))
        for row, q in zip(self.q, queries):
            row[: len(q)] = q
        self.which = np.arange(len(queries))
        self.cost, self.end = np.full(len(queries), np.inf), np.zeros(len(queries), np.int64)

    @property
    def diagonals(self) -> int:
        return self.rows + self.n - 1

    def start(self) -> list[np.ndarray]:
        """Fronts of the last two diagonals, and room for the next; row i is at i + 1, and what is no cell costs more than any."""
        return [np.full((len(self.q), self.rows + 1), np.inf) for _ in range(3)]

    def advance(self, fronts: list[np.ndarray], first: int, last: int, bits: list | None = None, score: bool = True) -> None:
        """Fill the diagonals first to last - 1."""
        m, n = self.rows, self.n
        for k in range(first, last):
            before, one, new = fronts
            lo, hi = max(0, k - n + 1), min(m - 1, k)
            step = np.square(self.q[:, lo : hi + 1] - self.back[n - 1 - k + lo : n - k + hi])
            both, above, left = before[:, lo : hi + 1], one[:, lo : hi + 1], one[:, lo + 1 : hi + 2]
            least = np.minimum(both, above)
            if bits is not None:
                bits.append((lo, np.packbits(above < both, axis=1), np.packbits(left < least, axis=1)))
            np.minimum(least, left, out=least)
            np.add(least, step, out=new[:, lo + 1 : hi + 2])
            if lo == 0:
                new[:, 1] = step[:, 0]
            if score:
                j = k - self.size + 1
                at = np.flatnonzero((j >= 0) & (j < n))
                value = new[at, self.size[at]]
                known = self.cost[self.which[at]]
                better = value <= known if self.late else value < known
                got = self.which[at[better]]
                self.cost[got], self.end[got] = value[better], j[at[better]]
            fronts[:] = one, new, before

    def drop(self, fronts: list[np.ndarray], alive: np.ndarray) -> None:
        """Go on with some queries only."""
        self.q, self.size, self.which = self.q[alive], self.size[alive], self.which[alive]
        fronts[:] = [f[alive] for f in fronts]


def distances(queries: list[np.ndarray], reference: np.ndarray, cutoff: np.ndarray | None = None, near: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The least cost and the place where it ends, for each query; infinite where it is above the query's cutoff, though such a
    cost may be given too. near: for each query the least cost of each sample with any place of the reference."""
    t = _Tables(queries, reference)
    fronts = t.start()
    if cutoff is None:
        t.advance(fronts, 0, t.diagonals)
        return t.cost, t.end
    rest = np.zeros((len(queries), t.rows + 1))  # what the samples behind row i cost at least
    for row, x in zip(rest, near):
        row[1 : len(x) + 1] = x.sum() - np.cumsum(x)
    rest[np.arange(t.rows + 1)[None] > t.size[:, None]] = np.inf
    suffix_low, suffix_high = (f.accumulate(t.back)[::-1] for f in (np.minimum, np.maximum))
    slack = 1 - 1e-9  # sums in another order
    for k in range(0, t.diagonals, LOOK):
        t.advance(fronts, k, min(k + LOOK, t.diagonals))
        begun = (np.minimum(fronts[0], fronts[1])[:, 1:] + rest[t.which][:, 1 : t.rows + 1]).min(1)
        k += LOOK
        if k < t.n:  # starts that are still to come see the rest of the reference only
            out = np.maximum(np.maximum(suffix_low[k] - t.q, t.q - suffix_high[k]), 0)
            out[np.arange(t.rows)[None] >= t.size[:, None]] = 0
            begun = np.minimum(begun, np.square(out).sum(1))
        known = np.minimum(t.cost[t.which], np.nextafter(cutoff[t.which], np.inf))
        alive = begun * slack < known
        if not alive.any():
            break
        if alive.mean() < 0.7:
            t.drop(fronts, alive)
    return t.cost, t.end


def paths(queries: list[np.ndarray], reference: np.ndarray, bits_bytes: int = BITS_BYTES, late: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The least cost, and the warping path as rows of (sample, place), for each query. Of equal ways back the diagonal is taken,
    then the one from above; of equal ends the first, or with late the last."""
    t = _Tables(queries, reference, late)
    n, fronts = len(queries), t.start()
    stretch = max(1, bits_bytes // max(1, n * t.rows // 4 + 64))
    kept, bits = {}, []
    for k in range(0, t.diagonals, stretch):
        if t.diagonals > stretch:
            kept[k] = [f.copy() for f in fronts[:2]]
        t.advance(fronts, k, min(k + stretch, t.diagonals), bits if t.diagonals <= stretch else None)
    i, j = t.size - 1, t.end.copy()
    steps = [[(i.copy(), j.copy(), np.arange(n))]]
    for k in range((t.diagonals - 1) // stretch * stretch, -1, -stretch):
        if not ((i > 0) & (i + j >= k)).any():
            continue
        if k in kept:
            bits = []
            t.advance([*kept.pop(k), np.full_like(fronts[0], np.inf)], k, min(k + stretch, t.diagonals), bits, score=False)
        while len(at := np.flatnonzero((i > 0) & (i + j >= k))):
            above, left = _origins(bits, i[at] + j[at] - k, at, i[at])
            i[at] -= ~left
            j[at] -= left | ~above
            steps[-1].append((i[at].copy(), j[at].copy(), at))
    all_i, all_j, who = (np.concatenate([s[c] for s in steps[0]]) for c in range(3))
    order = np.lexsort((-np.arange(len(who)), who))
    pairs = np.stack([all_i, all_j], 1)[order]
    return t.cost, np.split(pairs, np.cumsum(np.bincount(who, minlength=n))[:-1])


def _origins(bits: list, diagonal: np.ndarray, query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a cell came from above, and whether it came from the left, by the bits of its diagonal."""
    above, left = np.empty(len(query), bool), np.empty(len(query), bool)
    for d in np.unique(diagonal):
        here = diagonal == d
        lo, up, side = bits[d]
        at = row[here] - lo
        shift = (7 - (at & 7)).astype(np.uint8)
        above[here], left[here] = up[query[here], at >> 3] >> shift & 1, side[query[here], at >> 3] >> shift & 1
    return above, left


def _alike(queries: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of queries of similar lengths, not more together than FRONT_BYTES allow."""
    order = sorted(range(len(queries)), key=lambda k: len(queries[k]))
    held: list[int] = []
    for k in order:
        n = len(queries[k])
        if held and (n > 1.5 * len(queries[held[0]]) + 16 or 24 * n * (len(held) + 1) > FRONT_BYTES):
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def nearest_values(query: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The least squared difference of each sample with any place of a reference, whose values are given in order."""
    at = np.searchsorted(ordered, query)
    return np.square(np.minimum(np.abs(query - ordered[np.minimum(at, len(ordered) - 1)]), np.abs(query - ordered[np.maximum(at - 1, 0)])))


def cascade(queries: list[np.ndarray], references: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query the nearest reference (of equal ones the first), the cost and the place where it ends there; and how many
    references the bounds of the range, then those of the nearest values, have left to it."""
    n = len(queries)
    low, high = np.array([r.min() for r in references]), np.array([r.max() for r in references])
    bound = np.array([[np.square(np.maximum(np.maximum(a - q, q - b), 0)).sum() for a, b in zip(low, high)] for q in queries])
    cost, which, end, left = np.full(n, np.inf), np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    order, rows = np.argsort(bound, axis=1, kind="stable"), np.arange(n)
    ordered = [np.sort(r) for r in references]
    for turn in range(len(references)):  # every query goes through the references from its smallest bound on
        r_of = order[:, turn]
        first = np.flatnonzero(bound[rows, r_of] * (1 - 1e-9) <= cost)
        if not len(first):
            break
        left[first, 0] += 1
        near = {k: nearest_values(queries[k], ordered[r_of[k]]) for k in first}
        second = np.array([k for k in first if near[k].sum() * (1 - 1e-9) <= cost[k]], np.int64)
        left[second, 1] += 1
        for r in np.unique(r_of[second]):
            mine = second[r_of[second] == r]
            for some in _alike([queries[k] for k in mine]):
                at = mine[some]
                c, e = distances([queries[k] for k in at], references[r], cost[at], [near[k] for k in at])
                better = (c < cost[at]) | ((c == cost[at]) & np.isfinite(c) & (r < which[at]))
                cost[at[better]], end[at[better]], which[at[better]] = c[better], e[better], r
    return which, cost, end, left


def subsequence_path(reference: np.ndarray, query: np.ndarray, late: bool = False) -> tuple[int, int, float]:
    """First and last place in the reference where the query fits best, and the root of the summed squared differences."""
    cost, found = paths([np.asarray(query, float)], np.asarray(reference, float), late=late)
    return int(found[0][0, 1]), int(found[0][-1, 1]), float(np.sqrt(cost[0]))


def _aligned(queries: list[np.ndarray], reference: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """paths() of any number of queries of any lengths."""
    cost, found = np.zeros(len(queries)), [np.empty((0, 2), np.int64)] * len(queries)
    for some in _alike(queries):
        c, p = paths([queries[k] for k in some], reference)
        cost[some] = c
        for k, x in zip(some, p):
            found[k] = x
    return cost, found


def _samples(column: pa.Array) -> list[np.ndarray | None]:
    """Signals as arrays; None for what can't be aligned: null, or with a null or non-finite sample."""
    out: list[np.ndarray | None] = []
    for x in column:
        x = None if not x.is_valid else x.values
        values = None if x is None or x.null_count else x.to_numpy().astype(float)
        out.append(values if values is not None and np.isfinite(values).all() else None)
    return out


def _mapped(df: DataFrame, step: Callable[[pa.RecordBatch], pa.Table], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from step(b).to_batches()

    return df.mapInArrow(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


PATH = "array<struct<sample:int,place:int>>"
_PATH = pa.list_(pa.struct([("sample", pa.int32()), ("place", pa.int32())]))


def _path_column(found: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if p is None else len(p) for p in found]
    flat = np.concatenate([np.empty((0, 2), np.int64), *[p for p in found if p is not None]]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], fields=list(_PATH.value_type))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(p is None for p in found), False]))
    return pa.ListArray.from_arrays(offsets, pairs)


def align_self(signals: DataFrame) -> DataFrame:
    """(id, first, last, final_length, distance) of every signal (id, samples) on itself, as it is; those without samples, or with
    a null or non-finite one, have no rows. Of equal ends the last is taken: a signal that ends in equal samples lies on itself whole too."""

    def step(b: pa.RecordBatch) -> pa.Table:
        x = _samples(b.column("samples"))
        at = [k for k, s in enumerate(x) if s is not None and len(s)]
        got = [subsequence_path(x[k], x[k], late=True) for k in at]  # each has a reference of its own
        first, last = (np.array([g[c] for g in got], np.int64) for c in (0, 1))
        return pa.table({"id": b.column("id").take(pa.array(at, pa.int64())), "first": first, "last": last, "final_length": last - first, "distance": np.array([g[2] for g in got], float)})

    return _mapped(signals.select("id", "samples"), step, f"id {_kind(signals, 'id')}, first long, last long, final_length long, distance double")


def align(signals: DataFrame, references: dict[str, np.ndarray], normalise: bool = True, with_path: bool = False) -> DataFrame:
    """(id, reference, first, last, final_length, distance, similarity, norm_score[, path]) of every signal (id, samples) on every
    reference; signals without samples, or with a null or non-finite one, have no rows. norm_score: the distance over the query's
    length; path: (sample, place) from the first to the last.

    References are few and are broadcast; signals are aligned where they are, those of one Arrow batch together.
    """
    given = {k: np.asarray(v, float) for k, v in references.items() if len(v)}
    shared = signals.sparkSession.sparkContext.broadcast({k: scaled(v) if normalise else v for k, v in given.items()})

    def step(b: pa.RecordBatch) -> pa.Table:
        x = _samples(b.column("samples"))
        at = [k for k, s in enumerate(x) if s is not None and len(s)]
        queries = [scaled(x[k]) if normalise else x[k] for k in at]
        tables = []
        for name, reference in shared.value.items():
            cost, found = _aligned(queries, reference)
            first, last = (np.array([p[e, 1] for p in found], np.int64) for e in (0, -1))
            d, size = np.sqrt(cost), np.array([len(q) for q in queries], float)
            t = {"id": b.column("id").take(pa.array(at, pa.int64())), "reference": pa.array([name] * len(at), pa.string()), "first": first, "last": last}
            t |= {"final_length": last - first, "distance": d, "similarity": 1 / (1 + d), "norm_score": d / size}
            tables.append(pa.table(t | ({"path": _path_column(found)} if with_path else {})))
        return pa.concat_tables(tables) if tables else pa.table({})

    schema = f"id {_kind(signals, 'id')}, reference string, first long, last long, final_length long, distance double, similarity double, norm_score double"
    return _mapped(signals.select("id", "samples"), step, schema + (f", path {PATH}" if with_path else ""))


def nearest_reference(signals: DataFrame, references: dict[str, np.ndarray], normalise: bool = True) -> DataFrame:
    """(id, reference, last, distance) of every signal's nearest reference, of equal ones the first by name; most references are left
    out by bounds. Signals that can't be aligned have no rows."""
    names = sorted(k for k, v in references.items() if len(v))
    shared = signals.sparkSession.sparkContext.broadcast([scaled(np.asarray(references[k], float)) if normalise else np.asarray(references[k], float) for k in names])

    def step(b: pa.RecordBatch) -> pa.Table:
        x = _samples(b.column("samples"))
        at = [k for k, s in enumerate(x) if s is not None and len(s)] if names else []
        which, cost, end, _ = cascade([scaled(x[k]) if normalise else x[k] for k in at], shared.value) if at else (np.empty(0, int), np.empty(0), np.empty(0, int), None)
        return pa.table({"id": b.column("id").take(pa.array(at, pa.int64())), "reference": pa.array([names[w] for w in which], pa.string()), "last": end.astype(np.int64), "distance": np.sqrt(cost)})

    return _mapped(signals.select("id", "samples"), step, f"id {_kind(signals, 'id')}, reference string, last long, distance double")


def align_reads(reads: DataFrame, references: dict[str, np.ndarray], genes: list[str] | None = None, normalise: bool = True) -> DataFrame:
    """Alignments of preprocessed reads (read_id, samples, index_of_adapter, success) on the references of genes (None: all).

    (read_id, success_align, ref_gene, path, score, query_align_len, norm_score): samples from the adapter on are cut off (a negative
    index counts from the end, a null one cuts nothing). A read with success has a row for each gene; nothing aligns where no sample
    is left, one is null or not finite, or the gene has no signal: path, score and the lengths are null there. success_align says
    whether the read aligns to any gene. A read without success has one row, without a gene.
    """
    wanted = sorted(references) if genes is None else genes
    given = {k: np.asarray(references[k], float) for k in wanted if len(references.get(k, ()))}
    shared = reads.sparkSession.sparkContext.broadcast({k: scaled(v) if normalise else v for k, v in given.items()})

    def step(b: pa.RecordBatch) -> pa.Table:
        x, good = _samples(b.column("samples")), b.column("success").fill_null(False).to_pylist()
        cut = [s if s is None else s[:k] for s, k in zip(x, b.column("index_of_adapter").to_pylist())]
        at = [k for k, s in enumerate(cut) if good[k] and s is not None and len(s)]
        queries = [scaled(cut[k]) if normalise else cut[k] for k in at]
        rows: list[tuple[int, str | None, np.ndarray | None, float | None]] = [(k, None, None, None) for k, g in enumerate(good) if not g]
        for gene in wanted:
            missing = [k for k, g in enumerate(good) if g]
            if gene in shared.value:
                cost, found = _aligned(queries, shared.value[gene])
                rows += [(k, gene, p, float(np.sqrt(c))) for k, c, p in zip(at, cost, found)]
                missing = sorted(set(missing) - set(at))
            rows += [(k, gene, None, None) for k in missing]
        aligned = {k for k, _, p, _ in rows if p is not None}
        return pa.table({
            "read_id": b.column("read_id").take(pa.array([r[0] for r in rows], pa.int64())),
            "success_align": pa.array([r[0] in aligned for r in rows]),
            "ref_gene": pa.array([r[1] for r in rows], pa.string()),
            "path": _path_column([r[2] for r in rows]),
            "score": pa.array([r[3] for r in rows], pa.float64()),
            "query_align_len": pa.array([None if r[2] is None else int(r[2][-1, 1] - r[2][0, 1]) for r in rows], pa.int64()),
            "norm_score": pa.array([None if r[3] is None else r[3] / len(cut[r[0]]) for r in rows], pa.float64()),
        })

    schema = f"read_id {_kind(reads, 'read_id')}, success_align boolean, ref_gene string, path {PATH}, score double, query_align_len long, norm_score double"
    return _mapped(reads.select("read_id", "samples", "index_of_adapter", "success"), step, schema)
