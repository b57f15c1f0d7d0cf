"""How well clusterings find the clusters of simulated libraries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import clustering, evaluate, filters, mixtures, simulate
from strandlake.plans.two_sample import assignments


def _paired(reads: DataFrame, mods: DataFrame, length: int, k: int, method: str) -> DataFrame:
    """Ward linkage, medoids and spectral clusters need the distances of all pairs of reads: for the simulated libraries of a
    benchmark, whose depth the caller sets; the driver holds depth x depth numbers."""
    ids = [r["read_id"] for r in reads.select("read_id").orderBy("read_id").collect()]
    at = {r: i for i, r in enumerate(ids)}
    x = np.zeros((len(ids), length))
    for r in mods.collect():
        x[at[r["read_id"]], r["pos"]] = 1
    d = clustering.squared_distances(x)
    if method == "ward":
        labels = clustering.hierarchical(d, k)
    elif method == "kmedoids":
        labels = clustering.k_medoids(np.sqrt(d), k)[0]
    else:  # spectral: k-medoids of the leading eigenvectors of the normalised affinity
        a = np.exp(-d / max(np.median(d), 1e-9))
        s = 1 / np.sqrt(a.sum(1))
        _, axes = np.linalg.eigh(s[:, None] * a * s[None, :])
        y = axes[:, -k:]
        labels = clustering.k_medoids(np.sqrt(clustering.squared_distances(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))), k)[0]
    return reads.sparkSession.createDataFrame([(r, int(c)) for r, c in zip(ids, labels)], "read_id long, cluster long")


def cluster(reads: DataFrame, mods: DataFrame, length: int, k: int, method: str = "bmm", seed: int = 386) -> DataFrame:
    """(read_id, cluster) by kmeans, ward, kmedoids, spectral, bmm, hbbmm, bmm_vi or spaced."""
    if method == "kmeans":
        return clustering.k_means(clustering.vectors(reads, mods, length), k, seed).select("read_id", "cluster")
    if method in ("ward", "kmedoids", "spectral"):
        return _paired(reads, mods, length, k, method)
    sets = mixtures.position_sets(reads, mods)
    if method == "bmm_vi":
        model = mixtures.fit_variational(sets, k, length, seed=seed)
    elif method == "spaced":
        kept = filters.filter_reads_by_distance(reads, mods)
        sets = mixtures.position_sets(kept, mods.join(kept.select("read_id"), "read_id", "left_semi"))
        model = mixtures.fit_spaced(sets, k, length, seed=seed)[-1]
    elif method in ("bmm", "hbbmm"):
        model = mixtures.fit(sets, k, length, seed=seed, hierarchical=method == "hbbmm")
    else:
        raise ValueError(f"no method {method}")
    return assignments(reads, mods, model).select("read_id", "cluster")


def run(spark: SparkSession, s: simulate.Simulation, method: str = "bmm") -> DataFrame:
    """One row: the simulation's parameters, and accuracy (two clusters), rand, ari, fms and ami of the method."""
    truth = simulate.truths(spark, s).cache()
    mods = simulate.library(spark, s).select("read_id", "pos").cache()
    found = cluster(truth.select("read_id"), mods, s.length, len(s.shares), method).join(truth, "read_id").cache()
    table = evaluate.contingency(found)
    scores = evaluate.agreement(table).join(F.broadcast(evaluate.mutual_information(table))).join(F.broadcast(evaluate.accuracy(found)))
    k = len(s.shares)
    return scores.select(
        F.lit(method).alias("method"), F.lit(k).alias("clusters"), F.lit(s.depth).alias("depth"), F.lit(s.length).alias("length"), F.lit(s.similarity).alias("similarity"),
        F.lit(s.rate).alias("rate"), "n", F.when(F.lit(k == 2), F.col("accuracy")).alias("accuracy"), "rand", "ari", "fms", "ami",
    )
