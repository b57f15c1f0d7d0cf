"""Filters, profiles and samples of a sparse read x position matrix.

reads: read_id and any read columns; mods: one row (read_id, pos) for each modified position. A read without a modified
position is in reads alone, so counts always start from reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.ordered import hash_bucket, quantile_bucket, rank


def read_counts(reads: DataFrame, mods: DataFrame) -> DataFrame:
    """reads with n_mods (long), 0 where there is none."""
    counts = mods.groupBy("read_id").agg(F.count("*").alias("n_mods"))
    return reads.join(counts, "read_id", "left").withColumn("n_mods", F.coalesce("n_mods", F.lit(0)).cast("long"))


def filter_reads_by_rate(reads: DataFrame, mods: DataFrame, length: int, low: float = 0.0075, high: float = 0.025) -> DataFrame:
    """Reads whose share of modified positions is strictly between low and high, with n_mods and rate."""
    rate = F.col("n_mods") / F.lit(float(length))
    return read_counts(reads, mods).withColumn("rate", rate).where((F.col("rate") > low) & (F.col("rate") < high))


def filter_reads_by_length(reads: DataFrame, size: int, share: float = 0.8) -> DataFrame:
    """Reads that cover at least the given share of a gene."""
    return reads.where(F.col("length") >= F.lit(share * size))


def with_minimum(reads: DataFrame, mods: DataFrame, least: int = 1) -> DataFrame:
    """Reads with at least so many modified positions."""
    return read_counts(reads, mods).where(F.col("n_mods") >= least)


def positions(spark, length: int) -> DataFrame:
    return spark.range(length).withColumnRenamed("id", "pos")


def position_rates(reads: DataFrame, mods: DataFrame, length: int) -> DataFrame:
    """(pos, n_mods, rate) of every position below length; the rate is over all reads, null if there is none."""
    n = reads.agg(F.count("*").alias("n_reads"))
    counts = mods.join(reads.select("read_id"), "read_id", "left_semi").groupBy("pos").agg(F.count("*").alias("n_mods"))
    spine = positions(reads.sparkSession, length).join(counts, "pos", "left").withColumn("n_mods", F.coalesce("n_mods", F.lit(0)).cast("long"))
    return spine.join(F.broadcast(n)).select("pos", "n_mods", F.try_divide(F.col("n_mods").cast("double"), F.col("n_reads")).alias("rate"))


def kept_positions(rates: DataFrame, low: float, high: float) -> DataFrame:
    """Positions with a rate strictly between low and high; the others count as unmodified everywhere."""
    return rates.withColumn("kept", (F.col("rate") > low) & (F.col("rate") < high))


def zero_positions(mods: DataFrame, rates: DataFrame, low: float, high: float) -> DataFrame:
    """mods without the positions that fail the rate filter. The positions of one gene are few, so they are broadcast."""
    kept = kept_positions(rates, low, high).where("kept").select("pos")
    return mods.join(F.broadcast(kept), "pos", "left_semi")


def retained_positions(mods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pos, new_pos): positions with a modification anywhere, renumbered in each group of `by`, such as the gene; without it
    all positions are one gene's, which one task numbers."""
    used = mods.select(*by, "pos").distinct()
    return used.withColumn("new_pos", (F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).cast("long"))


def profile(reads: DataFrame, mods: DataFrame, length: int, by: str = "cond") -> DataFrame:
    """(by, pos, rate): modification rate of every position in each group of reads."""
    sizes = reads.groupBy(by).agg(F.count("*").alias("n_reads"))
    counts = mods.join(reads.select("read_id", by), "read_id").groupBy(by, "pos").agg(F.count("*").alias("n"))
    spine = positions(reads.sparkSession, length).join(F.broadcast(sizes))
    return spine.join(counts, [by, "pos"], "left").select(by, "pos", (F.coalesce("n", F.lit(0)) / F.col("n_reads")).alias("rate"))


def global_rate(reads: DataFrame, mods: DataFrame, length: int, by: str = "cond") -> DataFrame:
    """(by, n_reads, percent): modified cells in percent of all cells of a group."""
    counted = read_counts(reads, mods).groupBy(by).agg(F.count("*").alias("n_reads"), F.sum("n_mods").alias("n"))
    return counted.select(by, "n_reads", (F.col("n") * 100.0 / (F.col("n_reads") * length)).alias("percent"))


def mods_histogram(reads: DataFrame, mods: DataFrame) -> DataFrame:
    """(n_mods, n_reads) for every count from 0 to the largest."""
    counts = read_counts(reads, mods).groupBy("n_mods").agg(F.count("*").alias("n_reads"))
    spine = counts.agg(F.max("n_mods").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("n_mods"))
    return spine.join(counts, "n_mods", "left").select("n_mods", F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"))


def filter_reads_by_distance(reads: DataFrame, mods: DataFrame, least: int = 4) -> DataFrame:
    """Reads without two modifications closer than `least`; the first one is measured from position 0."""
    gap = F.col("pos") - F.lag("pos", 1, 0).over(Window.partitionBy("read_id").orderBy("pos"))
    close = mods.withColumn("gap", gap).where(F.col("gap") < least).select("read_id").distinct()
    return reads.join(close, "read_id", "left_anti")


def thinned_positions(ordered: Column, least: int) -> Column:
    """Of an ordered array of positions, those at least `least` behind the last one kept, from a virtual one at 0 on."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        far = p - acc["last"] >= least
        return F.struct(F.when(far, p).otherwise(acc["last"]).alias("last"), F.when(far, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def thin_by_distance(mods: DataFrame, least: int = 4) -> DataFrame:
    """mods without those too close behind a kept one; a fold over each read's positions."""
    lists = mods.groupBy("read_id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    return lists.select("read_id", F.explode(thinned_positions(F.col("p"), least)).alias("pos"))


def collapse_positions(mods: DataFrame, length: int, width: int = 5, drop_tail: bool = True) -> DataFrame:
    """Bins of `width` positions, labelled by their first one; with drop_tail the last `width` bins stay empty."""
    bins = F.floor(F.col("pos") / width)
    last = length // width - (width if drop_tail else 0)
    return mods.where(bins < last).select("read_id", (bins * width).cast("long").alias("pos")).distinct()


def first_reads(reads: DataFrame, depth: int | None, by: str = "cond", order: str = "read_id") -> DataFrame:
    """The first `depth` reads of each group by a numeric column; None: all; -1: as many as the smallest group has."""
    if depth is None:
        return reads
    if depth == -1:
        depth = reads.groupBy(by).count().agg(F.min("count")).first()[0] or 0
    return rank(reads, quantile_bucket(reads, order), [order], (by,), "_n").where(F.col("_n") <= depth).drop("_n")


def sample_key(seed: int = 386) -> Column:
    """A hash of the read id that any engine can compute: reads in its order are a repeatable random sample."""
    return F.md5(F.concat(F.col("read_id").cast("string"), F.lit(f"|{seed}")))


def downsample(reads: DataFrame, quota: dict[int, int], by: str = "cond", seed: int = 386) -> DataFrame:
    """So many reads of each group as its quota says, the first ones by sample_key."""
    exact = F.lit(0)
    for key, n in quota.items():
        exact = F.when(F.col(by) == key, F.lit(n)).otherwise(exact)
    keyed = reads.withColumn("_key", sample_key(seed))
    return rank(keyed, hash_bucket(F.col("_key")), ["_key", "read_id"], (by,), "_n").where(F.col("_n") <= exact).drop("_n", "_key")


def equal_quota(reads: DataFrame, by: str = "cond", least: int = -1, share: float | None = None) -> dict[int, int]:
    """Quotas for downsample: equal sizes of the smallest group (or `least`), or `share` of twice that for the first group."""
    sizes = {r[by]: r["count"] for r in reads.groupBy(by).count().collect()}
    if not sizes:
        return {}
    n = min(sizes.values()) if least < 0 else min(least, *sizes.values())
    if share is None:
        return dict.fromkeys(sizes, n)
    first, *rest = sorted(sizes)
    top = min(int(2 * n * share), sizes[first])
    return {first: top} | {k: min(2 * n - int(2 * n * share), sizes[k]) for k in rest}
