"""Two conditions of one gene: filter, balance, cluster, and compare clusters with conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import clustering, evaluate, filters, mixtures


@dataclass(frozen=True)
class Settings:
    length: int
    start: int = 0
    end: int | None = None
    read_low: float = 0.0075
    read_high: float = 0.025
    pos_low: float = 0.01
    pos_high: float = 1.0
    clusters: int = 2
    runs: int = 1
    threshold: float = 0.5
    min_iters: int = 20
    max_iters: int = 1000
    unknown: float = 0.0
    hierarchical: bool = False  # with the Beta prior of the whole library
    impute: bool = False  # fill the unmodified cells by low rank, and call those over a percentile modified
    percentile: float = 70
    least: int = -1
    share: float | None = None
    seed: int = 386


def candidates(reads: DataFrame, mods: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, int]:
    """Reads and modifications that go to the model, positions renumbered, and the number of positions.

    Reads are filtered by their rate over the window, positions by their rate over all reads; both look at the unfiltered
    matrix. Conditions are then drawn to equal sizes.
    """
    end = s.length if s.end is None else s.end
    window = mods.where((F.col("pos") >= s.start) & (F.col("pos") < end))
    kept = filters.filter_reads_by_rate(reads, window, end - s.start, s.read_low, s.read_high)
    rates = filters.position_rates(reads, window, s.length)
    used = filters.retained_positions(filters.zero_positions(window, rates, s.pos_low, s.pos_high))
    chosen = filters.downsample(kept, filters.equal_quota(kept, least=s.least, share=s.share), seed=s.seed)
    matrix = window.join(chosen.select("read_id"), "read_id", "left_semi").join(F.broadcast(used), "pos").select("read_id", F.col("new_pos").alias("pos"))
    return chosen.select(*reads.columns), matrix, used.count()


#: Cells of a matrix that imputation holds on the driver; larger ones are an error.
IMPUTED_CELLS = 50_000_000


def imputed(reads: DataFrame, matrix: DataFrame, width: int, percentile: float = 70) -> DataFrame:
    """(read_id, pos) after the cells without a modification, taken as missing, are filled by shrunk singular values and those over
    the percentile of all cells are called modified. Each cell depends on the whole matrix, so it is held on the driver."""
    ids = [r["read_id"] for r in reads.select("read_id").orderBy("read_id").limit(IMPUTED_CELLS // max(width, 1) + 1).collect()]
    if len(ids) * width > IMPUTED_CELLS:
        raise ValueError(f"imputation holds {IMPUTED_CELLS} cells at most: sample the reads first")
    at = {r: i for i, r in enumerate(ids)}
    x = np.zeros((len(ids), width))
    for r in matrix.collect():
        x[at[r["read_id"]], r["pos"]] = 1
    i, j = np.nonzero(clustering.binarise(clustering.soft_impute(x), percentile))
    frame = pd.DataFrame({"read_id": [ids[k] for k in i], "pos": j.astype(np.int64)})
    return matrix.sparkSession.createDataFrame(frame, matrix.select("read_id", "pos").schema)


def assignments(reads: DataFrame, matrix: DataFrame, model: mixtures.Mixture) -> DataFrame:
    """reads with cluster and post."""
    lists = matrix.groupBy("read_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("p"))
    rows = reads.join(lists, "read_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<int>")))
    return mixtures.predicted(rows, model.weights).select(*reads.columns, "cluster", "post")


def analyse(reads: DataFrame, mods: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Tables of an analysis: assignments, purity, proportions, profiles, reactivities. The chosen reads and their matrix stay cached
    for them (spark.catalog.clearCache)."""
    chosen, matrix, width = candidates(reads, mods, s)
    chosen, matrix = chosen.cache(), (imputed(chosen, matrix, width, s.percentile) if s.impute else matrix).cache()
    model = mixtures.fit(mixtures.position_sets(chosen, matrix), s.clusters, max(width, 1), s.runs, s.threshold, s.min_iters, s.max_iters, s.seed, s.hierarchical)
    found = assignments(chosen, matrix, model)
    original = mods.join(found.select("read_id"), "read_id", "left_semi")
    profiles = filters.profile(found, original, s.length, "cluster")
    return {
        "assignments": found,
        "purity": evaluate.cluster_purity(found, s.unknown),
        "proportions": evaluate.inferred_proportions(found),
        "profiles": profiles,
        "reactivities": evaluate.reactivities(profiles, s.pos_low),
    }
