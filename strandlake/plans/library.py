"""Libraries of several samples: a window of positions, a depth, and a least number of modifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import filters


def load(samples: dict[str, tuple[DataFrame, DataFrame]], start: int | None = None, end: int | None = None, depth: int | None = -1, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """reads and mods of all samples with a column sample.

    Each sample gives its first `depth` reads by row_idx (-1: as many as the smallest sample has, None: all) and its
    modifications in [start, end); reads with fewer than `least` of those are left out.
    """

    def tagged(k: int, name: str) -> list[DataFrame]:
        return [s[k].withColumn("sample", F.lit(n)) for n, s in samples.items() if n == name]

    reads = reduce(DataFrame.unionByName, [d for n in samples for d in tagged(0, n)])
    mods = reduce(DataFrame.unionByName, [d for n in samples for d in tagged(1, n)])
    if start is not None:
        mods = mods.where(F.col("pos") >= start)
    if end is not None:
        mods = mods.where(F.col("pos") < end)
    reads = filters.first_reads(reads, depth, "sample", "row_idx")
    key = ["sample", "read_id"]
    counts = mods.groupBy(*key).agg(F.count("*").alias("n_mods"))
    reads = reads.join(counts, key, "left").withColumn("n_mods", F.coalesce("n_mods", F.lit(0)).cast("long")).where(F.col("n_mods") >= least)
    return reads, mods.join(reads.select(*key), key, "left_semi")
