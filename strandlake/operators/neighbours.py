"""The k nearest reads of every read, by the sets of their modified positions.

No list of all pairs that share a position is made. First every read gets a bound on its k-th neighbour from reads that are likely to
be near: reads are sorted by their positions in the order of a hash, so that sets which agree on the first ones stand together, and
each block of the sorted table is compared within itself. Then the bound says how many positions a nearer read of some size must
share, so only the rarest few of a read's positions are looked up (a prefix of its set in the order of rarity), and a pair goes on
only if it meets the bound of the read that asks. Not single positions are looked up, whose lists grow with the reads, but several
at once: reads that must share o positions share all subsets of `level` <= o of these, so both are dealt out by such subsets. The level
rises with the logarithm of the reads, so lists stay about as long as they are. A pair is taken at the first of its common subsets.

Of reads with the same positions only the k + 1 first by id are listed: the others are no one's neighbours.

Where a block is a small part of the table the bounds tighten in rounds: each looks up a sample of the reads, GROW times as large as the
one before, and takes from it a guess that should leave enough in the next: of k reads a GROW-th is in the sample, and SPREAD times the
root of it is allowed for chance. Only how many reads there are of each value goes through a shuffle then. The last round is over all
reads, and reads that find fewer than k by their guess are looked up again by the bound of their block, which is no guess. So pairs are
made in proportion to reads x k, and to the reads that tie; the number of rounds grows with the logarithm of the reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.relational import BLOCK
from strandlake.sources.scratch import scratch_path

#: Orders in which reads are sorted for the bounds, and reads of a block at least.
ORDERS, SEED_BLOCK = 2, 512
#: By so much samples grow from round to round; for how many deviations a guess allows.
GROW, SPREAD = 8, 4
#: Positions that are looked up at once, at most; so many subsets of a read for each number of positions; reads of a list, about.
LEVELS, SUBSETS, LISTED = 6, 1024, 64
#: Subsets in an Arrow batch.
BATCH = 1 << 18


def position_sets(reads: DataFrame, mods: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(by, read_id, n, l, m0, m1, ...) of all reads, and the number of masks: l holds (r, c), the place of each position in the order of
    rarity in its group and the reads that have it; bit r of the masks is set."""
    counts = mods.groupBy(*by, "pos").agg(F.countDistinct("read_id").alias("c"))  # one row for each position of a gene
    ranked = counts.select(*by, "pos", "c", (F.row_number().over(Window.partitionBy(*by).orderBy("c", "pos")) - 1).alias("r"))
    words = max(1, -(-((ranked.agg(F.max("r")).first()[0] or 0) + 1) // 64))
    of = lambda w: F.col("r").between(64 * w, 64 * w + 63)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("r") % 64).cast("int"))
    masks = [F.bit_or(F.when(of(w), bit)).alias(f"m{w}") for w in range(words)]
    lists = mods.join(F.broadcast(ranked), [*by, "pos"]).groupBy(*by, "read_id").agg(F.sort_array(F.collect_set(F.struct("r", "c"))).alias("l"), *masks)
    every = reads.select(*by, "read_id").distinct().join(lists, [*by, "read_id"], "left")
    none = F.array().cast("array<struct<r:int,c:bigint>>")
    every = every.select(*by, "read_id", F.coalesce("l", none).alias("l"), *[F.coalesce(f"m{w}", F.lit(0).cast("long")).alias(f"m{w}") for w in range(words)])
    return every.withColumn("n", F.size("l").cast("long")), words


def _seeded(sets: DataFrame, words: int, k: int, jaccard: bool, by: tuple[str, ...], seed_block: int) -> DataFrame:
    """sets with bound: what the k-th neighbour reaches at least (similarity) or at most (distance); null where no k were found."""
    size = max(seed_block, 4 * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = np.stack([b.column(f"m{w}").to_numpy() for w in range(words)], 1).astype("<i8")
            group = b.column("g").dictionary_encode().indices.to_numpy()
            bounds = np.full(b.num_rows, np.nan)
            edges = [*range(0, max(1, b.num_rows - size // 2), size), b.num_rows]  # no small block at the end
            for first, last in zip(edges, edges[1:]):
                x = np.unpackbits(masks[first:last].view(np.uint8), axis=1).astype(np.float64)
                n, shared = x.sum(1), x @ x.T
                other = group[first:last, None] == group[None, first:last]
                np.fill_diagonal(other, False)
                both = n[:, None] + n[None]
                value = -shared / np.maximum(both - shared, 1) if jaccard else both - 2 * shared
                value = np.where(other & ((shared > 0) | (not jaccard)), value, np.inf)
                if last - first > k:
                    kth = np.partition(value, k - 1, axis=1)[:, k - 1]
                    bounds[first:last] = np.where(np.isfinite(kth), -kth if jaccard else kth, np.nan)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*by, "read_id")), pa.array(bounds, mask=np.isnan(bounds))], [*by, "read_id", "bound"])

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "read_id")) + ", bound double"
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    found = []
    for t in range(ORDERS):
        key = F.sort_array(F.transform("l", lambda x, t=t: F.xxhash64(x["r"], F.lit(t))))
        rows = sets.select(*by, "read_id", group.alias("g"), key.alias("key"), *[f"m{w}" for w in range(words)])
        rows = rows.repartitionByRange("g", "key", "read_id").sortWithinPartitions("g", "key", "read_id").drop("key")
        found.append(rows.mapInArrow(run, schema))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = F.max("bound") if jaccard else F.min("bound")
    return sets.join(every.groupBy(*by, "read_id").agg(best.alias("bound")), [*by, "read_id"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bounded(sets: DataFrame, words: int, k: int, jaccard: bool, by: tuple[str, ...], block: int, seed_block: int) -> tuple[DataFrame, DataFrame]:
    """sets with `bound`, that k reads are within, and `guess`, that somewhat more than k should be within, and those that can be neighbours."""
    sets = _written(sets, "position-sets")
    bounds = _written(_seeded(sets, words, k, jaccard, by, seed_block).select(*by, "read_id", "bound", F.col("bound").alias("guess")), "bounds")
    alike = F.row_number().over(Window.partitionBy(*by, *[f"m{w}" for w in range(words)]).orderBy("read_id"))
    listed = _written(sets.withColumn("alike", alike).where(F.col("alike") <= k + 1).drop("alike"), "listed-sets")
    count, places = sets.count(), [k]  # the place in a sample of one of GROW, GROW ** 2 ... reads that makes the guess
    while count > GROW ** len(places) * max(seed_block, 4 * k):
        part = places[-1] / GROW
        places.append(min(k, ceil(part + SPREAD * sqrt(part)) + 2))
    for i in range(len(places) - 1, 0, -1):
        sample = listed.where(F.pmod(F.xxhash64("read_id"), F.lit(GROW**i)) == 0)
        pairs = _near_pairs(sets.join(_guessed(bounds), [*by, "read_id"]), words, jaccard, by, block, sample)
        counts = pairs.groupBy(*by, "a", "value").agg(F.count("*").alias("c"))
        order = Window.partitionBy(*by, "a").orderBy(F.desc("value") if jaccard else "value").rowsBetween(Window.unboundedPreceding, 0)
        reached = counts.withColumn("s", F.sum("c").over(order)).where(F.col("s") >= places[i])
        found = reached.groupBy(*by, F.col("a").alias("read_id")).agg((F.max("value") if jaccard else F.min("value")).alias("new"))
        best = (F.greatest if jaccard else F.least)("bound", "new")  # nulls are left out
        bounds = _written(bounds.join(found, [*by, "read_id"], "left").select(*by, "read_id", "bound", best.alias("guess")), "bounds")
    return sets.join(bounds, [*by, "read_id"]), listed


def _guessed(sets: DataFrame) -> DataFrame:
    return sets.withColumn("bound", F.col("guess")).drop("guess")


def _enough(sets: DataFrame, k: int, by: tuple[str, ...], look_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(by, a, b, value) by the guesses of sets, and by the bounds for reads that have fewer than k then."""
    pairs = _written(look_up(_guessed(sets)), "near-pairs")
    full = pairs.groupBy(*by, F.col("a").alias("read_id")).agg(F.count("*").alias("c")).where(F.col("c") >= k)
    short = sets.where(~F.col("guess").eqNullSafe(F.col("bound"))).join(full, [*by, "read_id"], "left_anti")
    short = _written(short.drop("guess"), "short-of-pairs")
    if short.isEmpty():
        return pairs
    return pairs.join(short.select(*by, F.col("read_id").alias("a")), [*by, "a"], "left_anti").unionByName(look_up(short))


def _level(listed: DataFrame, by: tuple[str, ...]) -> tuple[int, list[int]]:
    """How many positions are looked up at once, and the sizes of the listed reads, of which there are no more than positions of a gene."""
    sizes = listed.groupBy("n").agg(F.count("*").alias("reads")).where("n > 0").collect()
    here = listed.select(*by, F.explode("l.r").alias("r")).groupBy(*by, "r").agg(F.count("*").alias("c"))
    genes = F.countDistinct(*(by or [F.lit(1)]))
    mean, genes = here.agg(F.sum(F.col("c").cast("double") * F.col("c")) / F.nullif(F.sum("c"), F.lit(0)), genes).first()
    level, share = 1, min(1, (mean or 0) * (genes or 1) / max(1, sum(s.reads for s in sizes)))
    while level < LEVELS and mean and mean * share ** (level - 1) > LISTED:
        level += 1
    return level, sorted(s.n for s in sizes)


def _asks(sizes: list[int], top: int, jaccard: bool, limit: int) -> Callable[[int, float], list[tuple[int, int, int, int]]]:
    """From the size and bound of a read (level, size, least, prefix): subsets of so many of the first `prefix` of its positions find all reads
    of this size that are within the bound; size 0: of all sizes from `least` on that are listed with `top` positions, which no other
    row looks up. A read has at most `limit` subsets of a level > 1."""

    def asks(n: int, bound: float) -> list[tuple[int, int, int, int]]:
        found, least, prefix = [], None, 0
        for size in sizes:
            both = n + size
            share = 1 if np.isnan(bound) else max(1, int(np.ceil((both * bound / (1 + bound) if jaccard else (both - bound) / 2) - 1e-9)))
            if share > min(n, size):
                continue
            level = max(i for i in range(1, min(share, top) + 1) if i == 1 or max(comb(size, i), comb(n - share + i, i)) <= limit)
            if level < top:
                found.append((level, size, 0, n - share + level))
            elif least is None:  # share grows with size, so these sizes follow each other, and the first needs the longest prefix
                least, prefix = size, n - share + top
        return found + ([(top, 0, least, prefix)] if prefix else [])

    return asks


def _near_pairs(sets: DataFrame, words: int, jaccard: bool, by: tuple[str, ...], block: int, listed: DataFrame) -> DataFrame:
    """(by, a, b, value): for each read those of `listed` that share a position and are within its bound. sets has bounds."""
    top, sizes = _level(listed, by)
    limit, batch = SUBSETS, BATCH
    asks_of = _asks(sizes, top, jaccard, limit)
    masks, subset, upto = ([f"{c}{w}" for w in range(words)] for c in "msp")

    def of_size(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        n = b.column("n").to_numpy()
        for size in np.unique(n):
            yield int(size), np.flatnonzero(n == size)

    def plans(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, int, int]]]]:
        bound = b.column("bound").to_numpy(zero_copy_only=False).astype(float)
        for n, rows in of_size(b):
            values, which = np.unique(bound[rows], return_inverse=True)
            for i, value in enumerate(values):
                yield n, rows[which == i], asks_of(n, value)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for b in batches:
            for _, _, asks in plans(b):
                found |= {(level, s) for level, size, _, _ in asks for s in ([size] if size else sizes) if level == 1 or level <= s and comb(s, level) <= limit}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sorted(found)], pa.int64()) for i in (0, 1)], ["level", "n"])

    levels: dict[int, list[int]] = {}
    for level, n in sets.select("n", "bound").mapInArrow(needed, "level long, n long").distinct().collect():  # at most LEVELS for each size
        levels.setdefault(n, []).append(level)

    def subsets(b: pa.RecordBatch, rows: np.ndarray, level: int, prefix: int, held: dict[str, np.ndarray], keep: list[str], asked: bool) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum(b.column("n").to_numpy())])
        ranks, blocks = (b.column(c).flatten().to_numpy() for c in ("r", "blocks"))
        chosen = np.array(list(combinations(range(prefix), level)))
        step = max(1, batch // (len(chosen) * words))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            places = first[some][:, None] + np.arange(prefix)
            r = ranks[places]
            bits = np.zeros((*r.shape, words), np.uint64)
            np.put_along_axis(bits, (r // 64)[..., None], np.uint64(1) << (r % 64).astype(np.uint64)[..., None], 2)
            sub = np.bitwise_or.reduce(bits[:, chosen], 2).reshape(-1, words).view(np.int64)
            before = np.bitwise_or.accumulate(bits, 1)[:, chosen[:, -1]].reshape(-1, words).view(np.int64)
            of = np.repeat(np.arange(at, at + len(some)), len(chosen))
            u = np.zeros(len(of), np.int64)
            if level == 1:  # lists of single positions may be long
                times = blocks[places].ravel().astype(np.int64)
                if asked:
                    again = np.repeat(np.arange(len(of)), times)
                    u = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    of, sub, before = of[again], sub[again], before[again]
                else:
                    u = b.column("h").to_numpy()[rows[of]] % times
            columns = [b.column(c).take(pa.array(rows[of])) for c in keep] + [pa.array(s[of]) for s in held.values()] + [pa.array(u)] + [pa.array(sub[:, w]) for w in range(words)]
            columns += [pa.array(before[:, w]) for w in range(words)] if asked else []
            yield pa.RecordBatch.from_arrays(columns, [*keep, *held, "u", *subset, *(upto if asked else [])])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo: dict[tuple[int, int], list[tuple[np.ndarray, int, int]]] = {}
            for _, rows, asks in plans(b):
                for level, size, least, prefix in asks:
                    todo.setdefault((level, prefix), []).append((rows, size, least))
            for (level, prefix), parts in todo.items():
                held = {name: np.concatenate([np.full(len(x[0]), x[i]) for x in parts]) for i, name in ((1, "size"), (2, "least"))}
                yield from subsets(b, np.concatenate([x[0] for x in parts]), level, prefix, held, [*by, "a", "bound", *masks], True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, rows in of_size(b):
                for level in levels.get(n, []):
                    yield from subsets(b, rows, level, n, {"size": np.full(len(rows), 0 if level == top else n)}, [*by, "b", *[f"o{m}" for m in masks]], False)

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    groups, longs = [f"{c} {kinds[c]}" for c in by], lambda *names: [f"{c} long" for c in names]
    met = [*by, "size", "u", *subset]
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by the bytes, which are few, Spark would make few tasks
    lists = [F.col("l.r").alias("r"), F.transform("l", lambda x: ((x["c"] - 1) / block).cast("int") + 1).alias("blocks")]
    asked = sets.repartition(parts, "read_id").select(*by, F.col("read_id").alias("a"), "n", "bound", *masks, *lists)
    asked = asked.mapInArrow(ask, ", ".join([*groups, f"a {kinds['read_id']}", "bound double", *longs(*masks, "size", "least", "u", *subset, *upto)])).repartition(parts, *met)
    others = [F.col(m).alias(f"o{m}") for m in masks]
    hashed = F.pmod(F.xxhash64("read_id"), F.lit(1 << 40)).alias("h")
    lookup = listed.repartition(parts, "read_id").select(*by, F.col("read_id").alias("b"), "n", *others, hashed, *lists)
    lookup = lookup.mapInArrow(put, ", ".join([*groups, f"b {kinds['read_id']}", *longs(*[f"o{m}" for m in masks], "size", "u", *subset)])).repartition(parts, *met)
    count = lambda f: sum((F.bit_count(f(w)).cast("long") for w in range(words)), F.lit(0).cast("long"))
    first = count(lambda w: asked[f"p{w}"].bitwiseAND(F.col(f"om{w}"))) == count(lambda w: asked[f"s{w}"])
    na, nb = count(lambda w: F.col(f"m{w}")), count(lambda w: F.col(f"om{w}"))
    value, within = _value(count(lambda w: F.col(f"m{w}").bitwiseAND(F.col(f"om{w}"))), jaccard, na + nb)
    condition = (F.col("a") != F.col("b")) & (nb >= F.col("least")) & first & within
    for c in met:
        condition = condition & (asked[c] == lookup[c])
    return asked.join(lookup, condition).select(*[asked[c] for c in by], "a", "b", value.alias("value"))


def _value(score: Column, jaccard: bool, both: Column) -> tuple[Column, Column]:
    value = score / (both - score) if jaccard else (both - 2 * score).cast("double")
    return value, F.col("bound").isNull() | (value >= F.col("bound") if jaccard else value <= F.col("bound"))


def _ranked(pairs: DataFrame, k: int, jaccard: bool, by: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*by, "a").orderBy(F.desc("value") if jaccard else "value", "b")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def near_pairs_by_jaccard(reads: DataFrame, mods: DataFrame, k: int = 90, by: tuple[str, ...] = (), block: int = BLOCK, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(by, a, b, value): the pairs that nearest_by_jaccard ranks."""
    sets, words = position_sets(reads, mods, by)
    sets, listed = _bounded(sets.where("n > 0"), words, k, True, by, block, seed_block)
    return _enough(sets, k, by, lambda some: _near_pairs(some, words, True, by, block, listed))


def nearest_by_jaccard(reads: DataFrame, mods: DataFrame, k: int = 90, by: tuple[str, ...] = (), block: int = BLOCK, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(by, a, rank, b, jaccard): for each read its k nearest reads among those of its group that share a position, nearest first,
    ties by id."""
    return _ranked(near_pairs_by_jaccard(reads, mods, k, by, block, seed_block), k, True, by).select(*by, "a", "rank", "b", F.col("value").alias("jaccard"))


def near_pairs_by_l1(reads: DataFrame, mods: DataFrame, k: int = 90, by: tuple[str, ...] = (), block: int = BLOCK, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(by, a, b, value): the pairs that nearest_by_l1 ranks.

    Of reads that share nothing with a read, whose distance is the sum of both sizes, only the first 2 k + 1 by size and id can be near:
    either k of them share nothing, or k share something and are nearer than all that come later.
    """
    sets, words = position_sets(reads, mods, by)
    sets, listed = _bounded(sets, words, k, False, by, block, seed_block)
    masks = [f"m{w}" for w in range(words)]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("n", "read_id"))
    few = sets.select(*by, F.col("read_id").alias("b"), F.col("n").alias("nb"), *[F.col(m).alias(f"o{m}") for m in masks], first.alias("k")).where(F.col("k") <= 2 * k + 1)
    lists = few.groupBy(*by).agg(F.collect_list(F.struct("b", "nb", *[f"o{m}" for m in masks])).alias("few"))
    nothing = F.lit(True)
    for m in masks:
        nothing = nothing & (F.col(m).bitwiseAND(F.col(f"o{m}")) == 0)
    value, within = _value(F.lit(0), False, F.col("na") + F.col("nb"))

    def look_up(some: DataFrame) -> DataFrame:
        open_reads = some.where(F.col("bound").isNull() | (F.col("bound") >= F.col("n"))).select(*by, F.col("read_id").alias("a"), F.col("n").alias("na"), "bound", *masks)
        far = (open_reads.join(lists, [*by]) if by else open_reads.join(F.broadcast(lists))).select(*by, "a", "na", "bound", *masks, F.inline("few"))
        far = far.where((F.col("a") != F.col("b")) & nothing & within).select(*by, "a", "b", value.alias("value"))
        return _near_pairs(some, words, False, by, block, listed).unionByName(far)

    return _enough(sets, k, by, look_up)


def nearest_by_l1(reads: DataFrame, mods: DataFrame, k: int = 90, by: tuple[str, ...] = (), block: int = BLOCK, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(by, a, rank, b, distance): for each read its k nearest other reads of its group by L1 distance, ties by id; all of them if
    there are fewer."""
    return _ranked(near_pairs_by_l1(reads, mods, k, by, block, seed_block), k, False, by).select(*by, "a", "rank", "b", F.col("value").cast("long").alias("distance"))
