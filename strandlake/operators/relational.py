"""Semi-joins, co-occurrence, neighbours and abundance over (read_id, pos)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(original: DataFrame, candidates: DataFrame, on: str = "read_id") -> DataFrame:
    """Rows of the unfiltered matrix whose reads are candidates."""
    return original.join(candidates.select(on).distinct(), on, "left_semi")


def unassigned(reads: DataFrame, assignments: DataFrame) -> DataFrame:
    """Reads without an assignment."""
    return reads.join(assignments.select("read_id").distinct(), "read_id", "left_anti")


#: Reads of one position that meet in one task; longer posting lists are dealt out in pairs of blocks of so many.
BLOCK = 4096


def shared_edges(mods: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(a, b, score): pairs of reads a < b that share at least `least` modified positions, 1 or more."""
    return sized_edges(mods, least, block).select("a", "b", "score")


def sized_edges(mods: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(a, b, score, na, nb): shared_edges() with the numbers of positions of both reads.

    A prefix filter: with positions in order of rarity, reads that share `least` of them share one of the first n - least + 1 of
    both. Each pair is made once, where it first meets, and counted there from both reads' sets, which are bits of a few numbers,
    so pairs aren't shuffled. A position that many reads have is dealt out in pairs of blocks, so no task holds more than two blocks
    of it.
    """
    counts = mods.groupBy("pos").agg(F.countDistinct("read_id").alias("n"))  # one row for each position of a gene
    ranked = counts.select("pos", "n", (F.row_number().over(Window.orderBy("n", "pos")) - 1).alias("r"))
    words = range(max(1, -(-counts.count() // 64)))
    bit = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), (r % 64).cast("int"))
    lower = lambda r: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), (r % 64).cast("int")))
    of = lambda w: F.col("r").cast("int").between(64 * w, 64 * w + 63)
    masks = [F.coalesce(F.bit_or(F.when(of(w), bit(F.col("r")))), F.lit(0).cast("long")).alias(f"m{w}") for w in words]
    lists = mods.join(F.broadcast(ranked), "pos").groupBy("read_id").agg(F.sort_array(F.collect_set(F.struct("r", "n"))).alias("l"), *masks)
    prefix = lists.where(F.size("l") >= least).select("read_id", *[f"m{w}" for w in words], F.inline(F.slice("l", 1, F.size("l") - least + 1)))
    blocks = F.expr(f"cast((n - 1) div {block} as int)")  # the last one
    place = F.pmod(F.xxhash64("read_id"), blocks + 1).cast("int")
    # of a read's positions those before this one
    before = [F.when(F.col("r") > 64 * w + 63, F.col(f"m{w}")).when(of(w), F.col(f"m{w}").bitwiseAND(lower(F.col("r")))).otherwise(F.lit(0).cast("long")).alias(f"b{w}") for w in words]
    dealt = prefix.withColumn("u", place).select("*", *before, F.inline(F.transform(F.sequence(F.lit(0), blocks), lambda o: F.struct(F.least("u", o).alias("i"), F.greatest("u", o).alias("j")))))
    x, y = dealt.alias("x"), dealt.drop(*[f"b{w}" for w in words]).alias("y")
    met = (F.col("x.r") == F.col("y.r")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.read_id") < F.col("y.read_id"))
    own = (F.least("x.u", "y.u") == F.col("x.i")) & (F.greatest("x.u", "y.u") == F.col("x.j"))
    earlier, score, na, nb = F.lit(0).cast("long"), F.lit(0), F.lit(0), F.lit(0)
    for w in words:
        na, nb = na + F.bit_count(F.col(f"x.m{w}")), nb + F.bit_count(F.col(f"y.m{w}"))
        earlier = earlier.bitwiseOR(F.col(f"x.b{w}").bitwiseAND(F.col(f"y.m{w}")))
        score = score + F.bit_count(F.col(f"x.m{w}").bitwiseAND(F.col(f"y.m{w}")))
    return x.join(y, met & own & (earlier == 0) & (score >= least)).select(F.col("x.read_id").alias("a"), F.col("y.read_id").alias("b"), *[c.cast("long").alias(name) for c, name in ((score, "score"), (na, "na"), (nb, "nb"))])


def cooccurrence(mods: DataFrame, window: int | None = None) -> DataFrame:
    """(i, j, n11): reads with both positions i <= j, from each read's own list of positions; j - i < window if given."""
    lists = mods.groupBy("read_id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    first = lists.select("p", F.posexplode("p").alias("k", "i"))
    pairs = first.select("i", F.explode(F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))).alias("j"))
    if window is not None:
        pairs = pairs.where(F.col("j") - F.col("i") < window)
    return pairs.groupBy("i", "j").agg(F.count("*").alias("n11"))


def chi_square_pairs(reads: DataFrame, mods: DataFrame, length: int) -> DataFrame:
    """(i, j, n11, n10, n01, n00, chi2, log2_oe) for positions i < j; chi2 with Yates's correction, null where an expected
    count is 0; log2_oe: log2((n11 + 1e-100) / (expected n11 + 1e-100))."""
    n = reads.agg(F.count("*").alias("n"))
    single = reads.sparkSession.range(length).withColumnRenamed("id", "pos").join(mods.groupBy("pos").agg(F.count("*").alias("c")), "pos", "left")
    single = single.select("pos", F.coalesce("c", F.lit(0)).alias("c"))
    x, y = single.select(F.col("pos").alias("i"), F.col("c").alias("ci")), single.select(F.col("pos").alias("j"), F.col("c").alias("cj"))
    # positions of one gene against one another: length ** 2 / 2 rows
    grid = x.join(F.broadcast(y), F.col("i") < F.col("j")).join(F.broadcast(n))
    both = cooccurrence(mods).where("i < j")
    t = grid.join(both, ["i", "j"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)).cast("long"))
    t = t.withColumn("n10", F.col("ci") - F.col("n11")).withColumn("n01", F.col("cj") - F.col("n11")).withColumn("n00", F.col("n") - F.col("ci") - F.col("cj") + F.col("n11"))
    terms: Column = F.lit(0.0)
    for cell, r, c in (("n11", "ci", "cj"), ("n10", "ci", "n - cj"), ("n01", "n - ci", "cj"), ("n00", "n - ci", "n - cj")):
        expected = F.expr(f"cast(({r}) as double) * ({c}) / n")
        off = F.abs(F.col(cell) - expected)
        terms = terms + F.pow(off - F.least(F.lit(0.5), off), 2) / F.nullif(expected, F.lit(0.0))
    expected11 = F.expr("cast(ci as double) * cj / n")
    return t.select("i", "j", "n11", "n10", "n01", "n00", terms.alias("chi2"), F.log2((F.col("n11") + 1e-100) / (expected11 + 1e-100)).alias("log2_oe"))


def pair_similarity(reads: DataFrame, mods: DataFrame, length: int) -> DataFrame:
    """(a, b, shared, l1, similarity, jaccard) for reads a < b that share a modified position.

    l1 = n_a + n_b - 2 shared; similarity = 1 - l1 / length. Pairs that share nothing have jaccard 0 and l1 = n_a + n_b.
    The sizes come with the pairs, which are joined with nothing: they grow with the square of the reads.
    """
    t = sized_edges(mods, 1)
    l1 = F.col("na") + F.col("nb") - 2 * F.col("score")
    return t.select("a", "b", F.col("score").alias("shared"), l1.alias("l1"), (1 - l1 / F.lit(float(length))).alias("similarity"), (F.col("score") / (F.col("na") + F.col("nb") - F.col("score"))).alias("jaccard"))


def similarity_summary(pairs: DataFrame, column: str = "similarity") -> DataFrame:
    """Least, mean, median and largest similarity over pairs that aren't equal, from how many pairs have each value."""
    s = F.col(column)
    counts = pairs.where(s != 1.0).groupBy(s.alias("s")).agg(F.count("*").alias("n"))
    s, n = F.col("s"), F.col("n")
    return counts.agg(F.min(s).alias("least"), (F.sum(s * n) / F.sum(n)).alias("mean"), F.percentile(s, F.lit(0.5), n).alias("median"), F.max(s).alias("largest"))


def abundance(reads: DataFrame, mods: DataFrame) -> DataFrame:
    """(positions, n_reads, first_read): distinct sets of modified positions (as text), how many reads have each."""
    lists = mods.groupBy("read_id").agg(F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("positions"))
    sets = reads.select("read_id").join(lists, "read_id", "left").withColumn("positions", F.coalesce("positions", F.lit("")))
    return sets.groupBy("positions").agg(F.count("*").alias("n_reads"), F.min("read_id").alias("first_read"))


def predicted_by_bits(library: DataFrame, predictions: DataFrame, least: float = 0.5) -> DataFrame:
    """library (bits) with the cluster that predictions (line, bits, cluster, post) give to its text: of several lines the
    last one; those with a posterior under `least`, and texts without a prediction, are left out."""
    last = predictions.groupBy("bits").agg(F.max_by(F.struct("cluster", "post"), "line").alias("p"))
    return library.join(last, "bits").where(F.col("p.post") >= least).select(*library.columns, F.col("p.cluster").alias("cluster"))


def group_counts(assignments: DataFrame, mods: DataFrame) -> DataFrame:
    """(cluster, pos, n): modifications of each position in each cluster."""
    return mods.join(assignments, "read_id").groupBy("cluster", "pos").agg(F.count("*").alias("n"))


def counted_sets(sets: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Clusters in order, their sizes, and clusters x positions counts, of reads (cluster, p); only these numbers come to the driver."""
    had = sets.where("cluster IS NOT NULL")
    size = had.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").toArrow()
    each = had.select("cluster", F.explode("p").alias("pos")).groupBy("cluster", "pos").agg(F.count("*").alias("n")).toArrow()
    clusters, pos = size.column("cluster").combine_chunks(), each.column("pos").to_numpy()
    counts = np.zeros((len(clusters), int(pos.max(initial=-1)) + 1), np.int64)
    counts[pc.index_in(each.column("cluster"), value_set=clusters).to_numpy(), pos] = each.column("n").to_numpy()
    return clusters, size.column("n").to_numpy(), counts


def flat_positions(p: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of each position in a column of arrays."""
    return np.repeat(np.arange(len(p)), pc.fill_null(pc.list_value_length(p), 0).to_numpy()), p.flatten().to_numpy().astype(np.int64)


def medoids(assignments: DataFrame, mods: DataFrame) -> DataFrame:
    """(cluster, read_id, distance): the member with the least sum of L1 distances to its cluster, ties by id."""
    lists = mods.groupBy("read_id").agg(F.collect_list("pos").alias("p"))
    # what an explode makes looks small to the planner, which would broadcast it
    sets = assignments.select("read_id", "cluster").join(lists.hint("merge"), "read_id", "left")
    return medoids_of_sets(sets).select("cluster", "read_id", "distance")


def medoids_of_sets(sets: DataFrame) -> DataFrame:
    """(cluster, read_id, distance, p): medoids() of reads (cluster, read_id, p), p being the positions (null: none).

    A member's sum is, over positions, the members that differ there: sum over all positions of n1, plus over its own ones
    of (size - 2 n1). Counts by cluster and position are made first; then each batch of reads gives its best ones, so no read is
    shuffled.
    """
    clusters, size, counts = counted_sets(sets)
    total, weight = counts.sum(1), size[:, None] - 2 * counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = pc.index_in(b.column("cluster"), value_set=clusters).to_numpy()
            row, pos = flat_positions(b.column("p"))
            distance = total[code]
            np.add.at(distance, row, weight[code[row], pos])
            least = np.full(len(clusters), np.iinfo(np.int64).max)
            np.minimum.at(least, code, distance)
            best = pa.array(np.flatnonzero(distance == least[code]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(best) for c in ("cluster", "read_id", "p")), pa.array(distance).take(best)], ["cluster", "read_id", "p", "distance"])

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    near = sets.where("cluster IS NOT NULL").select("cluster", "read_id", "p").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("cluster", "read_id", "p")) + ", distance long")
    best = near.groupBy("cluster").agg(F.min_by(F.struct("distance", "read_id", "p"), F.struct("distance", "read_id")).alias("m"))
    return best.select("cluster", "m.read_id", "m.distance", "m.p")
