"""Windows in which positions depend on one another more, or less, than in null libraries of the same margins."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import filters, nulls, windows
from strandlake.sources.scratch import kept


@dataclass(frozen=True)
class Settings:
    length: int
    window: int = 100
    step: int = 10
    components: int = 30
    seeds: tuple[int, ...] = tuple(range(20))
    rounds: int = 4
    threshold: float = 0.05
    normal: bool = True


def rejected_library(reads: DataFrame, mods: DataFrame, length: int, limit: int = 1_000_000, seed: int = 386) -> dict[str, DataFrame]:
    """The null library by rejection: reads drawn from the positions' rates, kept up to the number of reads of each count of
    modifications; with quotas (asked for and filled) and R2 of both margins."""
    rates, histogram = filters.position_rates(reads, mods, length), filters.mods_histogram(reads, mods)
    made = nulls.independent_reads(rates, histogram, length, limit, seed)
    per_pos = lambda m: m.groupBy("pos").agg(F.count("*").alias("n"))
    filled = nulls.quotas(histogram, made)
    return {
        "library": made,
        "quotas": filled,
        "position_fit": nulls.margin_fit(per_pos(mods), per_pos(made), "pos"),
        "read_fit": nulls.margin_fit(filled.select("n_mods", F.col("quota").alias("n")), filled.select("n_mods", "n"), "n_mods"),
    }


def analyse(mods: DataFrame, s: Settings, path: str | None = None) -> dict[str, DataFrame]:
    """observed and simulated entropies, tests of every window, and intervals of significant ones (by window number).

    With a path the entropies are kept there, in a folder named by the settings, and read from it the next time; else both tables
    stay cached (spark.catalog.clearCache).
    """

    def table(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if path is None:
            return make().cache()
        mark = hashlib.md5(repr((s.length, s.window, s.step, s.components, s.seeds, s.rounds)).encode()).hexdigest()[:12]
        return kept(mods.sparkSession, f"{path}/{name}-{mark}", make)

    lists = functools.cache(lambda: nulls.position_lists(mods))
    observed = table("observed", lambda: windows.window_entropy_of_sets(lists(), s.length, s.window, s.step, s.components))
    made = lambda: nulls.shuffled_cooccurrence(lists(), list(s.seeds), s.length, s.window, s.rounds)
    simulated = table("simulated", lambda: windows.spectra(made(), s.length, s.window, s.step, s.components, ("seed",)))
    tests = (windows.normal_test if s.normal else windows.permutation_test)(observed, simulated, s.threshold)
    mean = simulated.groupBy("start").agg(F.avg("entropy").alias("null_mean"))
    tests = tests.join(mean, "start").withColumn("difference", F.col("null_mean") - F.col("entropy"))
    sites = tests.where("significant").select(F.expr(f"start div {s.step}").alias("pos"))
    return {"observed": observed, "simulated": simulated, "tests": tests, "intervals": windows.islands(sites)}
