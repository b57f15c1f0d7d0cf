"""Synthetic libraries with known clusters: structures, sequences, truths, reads and errors, all from hashes of their ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.nulls import hash_uniform

# Shares of the clusters by the code of a mixture.
MIXTURES: dict[str, tuple[float, ...]] = {
    "A1": (1.0,),
    "A2": (0.5, 0.5),
    "B2": (0.6, 0.4),
    "C2": (0.75, 0.25),
    "D2": (0.80, 0.20),
    "E2": (0.90, 0.10),
    "F2": (0.95, 0.05),
    "G2": (0.99, 0.01),
    "A3": (0.5, 0.25, 0.25),
    "A4": (0.5, 0.25, 0.125, 0.125),
    "A5": (0.5, 0.25, 0.125, 0.075, 0.05),
    "A6": (0.5, 0.25, 0.125, 0.075, 0.025, 0.025),
    "A7": (0.5, 0.25, 0.125, 0.075, 0.025, 0.015, 0.01),
    "A8": (0.5, 0.25, 0.125, 0.075, 0.025, 0.010, 0.01, 0.005),
    "U3": (0.34, 0.33, 0.33),
    "U4": (0.25, 0.25, 0.25, 0.25),
    "U5": (0.2, 0.2, 0.2, 0.2, 0.2),
    "U6": (0.167, 0.167, 0.167, 0.167, 0.167, 0.165),
    "U7": (0.148, 0.142, 0.142, 0.142, 0.142, 0.142, 0.142),
    "U8": (0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125, 0.125),
}
# A, b, location and scale of the Beta distribution of a read's modification rate by probe.
PROBES: dict[str, tuple[float, float, float, float]] = {
    "NAI": (2.743941781321144, 18.316278199484522, -0.001104242858945835, 0.054028979717955),
    "1AI": (2.6334556377049547, 12.2767347158523, 0.0020349613579214616, 0.049000229105008154),
}


@dataclass(frozen=True)
class Simulation:
    depth: int = 100
    length: int = 100
    shares: tuple[float, ...] = (0.5, 0.5)
    similarity: float = 0.5
    rate: float = 0.02
    false_positives: float = 0.0
    on_top: bool = False  # false positives come on top of the rate, instead of out of it
    seed: int = 386


def structures(spark: SparkSession, s: Simulation) -> DataFrame:
    """(cluster, pos, unpaired): a random structure, and alternatives whose bases differ with probability 1 - similarity."""
    grid = spark.range(len(s.shares)).withColumnRenamed("id", "cluster").join(F.broadcast(spark.range(s.length).withColumnRenamed("id", "pos")))
    base = hash_uniform("base", F.col("pos"), str(s.seed)) < 0.5
    flip = (F.col("cluster") > 0) & (hash_uniform("flip", F.col("cluster"), F.col("pos"), str(s.seed)) < 1 - s.similarity)
    return grid.select("cluster", "pos", (base != flip).alias("unpaired"))


def sequence(spark: SparkSession, s: Simulation) -> DataFrame:
    """(seq): a random sequence of bases."""
    base = F.substring(F.lit("ATGC"), (F.floor(hash_uniform("seq", F.col("id"), str(s.seed)) * 4) + 1).cast("int"), F.lit(1))
    rows = spark.range(s.length).select(F.struct("id", base.alias("b")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(F.array_join(F.transform("x", lambda x: x["b"]), "").alias("seq"))


def _category(u: Column, shares: tuple[float, ...]) -> Column:
    out, run = F.lit(len(shares) - 1), sum(shares)
    for k in range(len(shares) - 1, 0, -1):
        run -= shares[k]
        out = F.when(u < run, k - 1).otherwise(out)
    return out.cast("long")


def truths(spark: SparkSession, s: Simulation) -> DataFrame:
    """(read_id, truth): clusters drawn by their shares."""
    return spark.range(s.depth).select(F.col("id").alias("read_id"), _category(hash_uniform("truth", F.col("id"), str(s.seed)), s.shares).alias("truth"))


def library(spark: SparkSession, s: Simulation) -> DataFrame:
    """(read_id, truth, pos): each read is modified at unpaired positions of its cluster's structure, and anywhere with the
    probability of a false positive. The rate is that of all modifications, and the real ones have what the false ones leave of
    it, unless these come on top."""
    st = structures(spark, s)
    share = st.groupBy("cluster").agg(F.avg(F.when(F.col("unpaired"), 1.0).otherwise(0.0)).alias("open"))
    grid = truths(spark, s).join(F.broadcast(st.join(share, "cluster").withColumnRenamed("cluster", "truth")), "truth")
    chance = F.when(F.col("unpaired"), F.least(F.lit(1.0), F.lit(s.rate if s.on_top else max(s.rate - s.false_positives, 0.0)) / F.nullif(F.col("open"), F.lit(0.0)))).otherwise(F.lit(0.0))
    hit = hash_uniform("mod", F.col("read_id"), F.col("pos"), str(s.seed)) < chance
    wrong = hash_uniform("err", F.col("read_id"), F.col("pos"), str(s.seed)) < s.false_positives
    return grid.where(hit | wrong).select("read_id", "truth", "pos")


def probed_library(spark: SparkSession, s: Simulation, probe: str = "NAI") -> DataFrame:
    """(read_id, truth, pos): like library(), but a read's number of modifications is drawn first (from the Beta distribution
    of NAI or 1AI, for "poisson" from a Poisson distribution with mean rate x length, for "fixed" that mean itself) and then
    as many unpaired positions, with replacement. Reads are drawn where they are, each with a seed of its own."""
    open_at: dict[int, list[int]] = {k: [] for k in range(len(s.shares))}
    for r in structures(spark, s).where("unpaired").orderBy("cluster", "pos").collect():  # clusters x length rows at most
        open_at[r["cluster"]].append(r["pos"])
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in open_at.items()})

    def amount(rng: np.random.Generator) -> int:
        if probe in PROBES:
            a, b, low, scale = PROBES[probe]
            return max(0, int((low + scale * rng.beta(a, b)) * s.length))
        return int(rng.poisson(s.rate * s.length)) if probe == "poisson" else int(s.rate * s.length)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for read, truth in zip(f["read_id"], f["truth"]):
                rng = np.random.default_rng([s.seed, int(read)])
                places = shared.value[truth]
                hit = np.unique(rng.choice(places, amount(rng))) if len(places) else places
                wrong = np.flatnonzero(rng.random(s.length) < s.false_positives)
                rows += [(read, truth, int(p)) for p in np.union1d(hit, wrong)]
            yield pd.DataFrame(rows, columns=["read_id", "truth", "pos"])

    return truths(spark, s).mapInPandas(draw, "read_id long, truth long, pos long")


def chimeric_reads(reads: DataFrame, pairs: DataFrame, length: int, arm: int = 30, seed: int = 386) -> DataFrame:
    """(read_id, first1, last1, first2, last2): for each read one of the base pairs (i, j), by hash, with arms around it."""
    numbered = pairs.withColumn("k", F.row_number().over(Window.orderBy("i", "j")) - 1)
    n = pairs.agg(F.count("*").alias("n"))
    picked = reads.join(F.broadcast(n)).withColumn("k", F.floor(hash_uniform("pair", F.col("read_id"), str(seed)) * F.col("n")).cast("int")).join(F.broadcast(numbered), "k")

    def arm_of(p: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0), p - arm // 2), F.least(F.lit(length), p + arm // 2)

    (a, b), (c, d) = arm_of(F.col("i")), arm_of(F.col("j"))
    return picked.select("read_id", a.alias("first1"), b.alias("last1"), c.alias("first2"), d.alias("last2"))
