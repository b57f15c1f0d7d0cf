"""Differential regions between two conditions, regions of transcripts, chimeric reads, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(rows: DataFrame, length: int) -> DataFrame:
    """(pos, coverage): sums over conditions at every position below length, 0 where there is none."""
    spine = rows.sparkSession.range(length).withColumnRenamed("id", "pos")
    return spine.join(rows.groupBy("pos").agg(F.sum("coverage").alias("coverage")), "pos", "left").select("pos", F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def paired_profiles(profiles: DataFrame, first: int = 0, second: int = 1) -> DataFrame:
    """(pos, x, y, cx, cy): the two conditions side by side at positions that both have; NaN counts as masked (null)."""
    a = profiles.where(F.col("cond") == first).select("pos", F.nanvl("value", F.lit(None).cast("double")).alias("x"), F.col("coverage").alias("cx"))
    b = profiles.where(F.col("cond") == second).select("pos", F.nanvl("value", F.lit(None).cast("double")).alias("y"), F.col("coverage").alias("cy"))
    return a.join(b, "pos")


def differential_sites(pairs: DataFrame, length: int, step: int = 50, most_r: float = 0.93, least_diff: float = 0.25, least_coverage: int = 500) -> DataFrame:
    """(pos, r, diff): centres of windows of `step` positions, all valid in both conditions, whose profiles correlate less
    than most_r and differ by more than least_diff in sum, where both coverages are at least least_coverage.

    The window is by position, so gaps show as missing counts. One ordered pass over the positions of one transcript.
    """
    h = step // 2
    w = Window.orderBy("pos").rangeBetween(-h, h - 1)
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    t = pairs.withColumn("n", F.count(F.when(ok, 1)).over(w)).withColumn("r", F.corr("x", "y").over(w)).withColumn("diff", F.sum(F.abs(F.col("x") - F.col("y"))).over(w))
    hit = (F.col("n") == step) & (F.col("pos") >= h) & (F.col("pos") < length - h) & (F.col("r") < most_r) & (F.col("diff") > least_diff)
    return t.where(hit & (F.col("cx") >= least_coverage) & (F.col("cy") >= least_coverage)).select("pos", "r", "diff")


def transcript_regions(annotations: DataFrame) -> DataFrame:
    """(chrom, start, end, code): 5' UTR 0, coding part 1, 3' UTR 2, half-open; empty ones are left out.
    annotations: chrom, tx_start, utr5, utr3, tx_end."""
    parts = F.array(*[F.struct(F.col(a).cast("long").alias("start"), F.col(b).cast("long").alias("end"), F.lit(k).cast("long").alias("code")) for k, (a, b) in enumerate((("tx_start", "utr5"), ("utr5", "utr3"), ("utr3", "tx_end")))])
    return annotations.select("chrom", F.inline(parts)).where("start < end")


def counted_by_region(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """(code, n): sites (chrom, pos) by the region that holds them, the smallest code if several do; null: none. Regions are
    joined by chromosome and range; a chromosome has few of them."""
    inside = (F.col("s.chrom") == F.col("r.chrom")) & (F.col("s.pos") >= F.col("r.start")) & (F.col("s.pos") < F.col("r.end"))
    held = sites.alias("s").join(regions.alias("r"), inside, "left").groupBy("s.chrom", "s.pos").agg(F.min("r.code").alias("code"))
    return held.groupBy("code").agg(F.count("*").alias("n"))


def chimeric_intervals(pairs: DataFrame, start: int, end: int, most: int = 300, arm: int = 5) -> DataFrame:
    """(iid, first, last, counts): intervals of `arm` positions to either side of both midpoints of chimeric reads (iid, s1,
    e1, s2, e2, counts) whose midpoints are closer than `most`, the first one at start or behind, the second one at end or before."""
    mids = pairs.select("iid", "counts", F.expr("(s1 + e1) div 2").alias("m1"), F.expr("(s2 + e2) div 2").alias("m2"))
    near = mids.where((F.abs(F.col("m1") - F.col("m2")) < most) & (F.col("m1") >= start) & (F.col("m2") <= end))
    return near.select("iid", "counts", F.explode(F.array("m1", "m2")).alias("m")).select("iid", (F.col("m") - arm).alias("first"), (F.col("m") + arm).alias("last"), "counts")


def interval_entropy(intervals: DataFrame, windows: DataFrame, bin_size: int = 64) -> DataFrame:
    """(start, end, entropy): of the counts of intervals [first, last) that overlap each window, 0 if there is none.

    Both sides are dealt to bins of bin_size positions and joined by bin, and a pair counts in the first bin that it shares.
    """
    a = intervals.withColumn("_id", F.monotonically_increasing_id()).withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / bin_size), F.floor((F.col("last") - 1) / bin_size))))
    b = windows.select("start", "end").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    met = a.join(b, "bin").where((F.col("first") < F.col("end")) & (F.col("start") < F.col("last")) & (F.col("bin") == F.floor(F.greatest("first", "start") / bin_size)))
    sums = met.groupBy("start", "end").agg(F.sum("counts").alias("s"), F.sum(F.col("counts") * F.log(F.col("counts").cast("double"))).alias("l"))
    entropy = F.log(F.col("s").cast("double")) - F.col("l") / F.col("s")
    return windows.select("start", "end").join(sums, ["start", "end"], "left").select("start", "end", F.coalesce(entropy, F.lit(0.0)).alias("entropy"))


def z_scores(signals: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """signals with z: the value less its series' mean, over the series' population standard deviation; 0 without spread."""
    stats = signals.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return signals.join(stats, key).withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")
