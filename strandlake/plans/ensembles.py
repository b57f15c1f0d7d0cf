"""Ensembles of structures: encoded as reads of unpaired positions, clustered, with centres, similarity and concordance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import clustering, evaluate, mixtures, relational, structure
from strandlake.plans import folding
from strandlake.sources.scratch import scratch_path


@dataclass(frozen=True)
class Settings:
    clusters: int = 2
    method: str = "kmeans"
    least_share: float = 0.05
    seed: int = 386
    #: of the mixture
    threshold: float = 0.05
    min_iters: int = 100


def generated(sequences: DataFrame, folder: folding.Fold, n: int = 250, temperature: float = 37.0) -> DataFrame:
    """(id, struct_id, db): n structures of each sequence (id, seq, reactivity) by the caller's folding function."""
    return folding.fold(sequences, folder, n, temperature)


def encoded(structs: DataFrame) -> DataFrame:
    """(read_id, p): a structure is a read that is modified where a base is unpaired, p being these positions in order. They stay in
    the structure's row, so nothing is shuffled by structure."""
    bits = structs.select(F.col("struct_id").alias("read_id"), structure.structure_bits(F.col("db")).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column("bits").cast(pa.string()), "")
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy())])
            at = np.flatnonzero(np.frombuffer("".join(text.to_pylist()).encode(), np.uint8) == ord("1"))
            first = np.searchsorted(at, ends)
            pos = at - np.repeat(ends[:-1], np.diff(first))
            yield pa.RecordBatch.from_arrays([b.column("read_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(pos.astype(np.int32)))], ["read_id", "p"])

    return bits.mapInArrow(run, f"read_id {structs.schema['struct_id'].dataType.simpleString()}, p array<int>")


def clustered(sets: DataFrame, length: int, s: Settings) -> DataFrame:
    """(read_id, p, cluster) by k-means or a Bernoulli mixture of the structures."""
    if s.method == "kmeans":
        return clustering.k_means(clustering.vectors_of_sets(sets, length), s.clusters, s.seed).select("read_id", "p", "cluster")
    if s.method != "bmm":
        raise ValueError(f"no method {s.method}")
    model = mixtures.fit(sets.groupBy("p").agg(F.count("*").alias("weight")), s.clusters, length, 1, s.threshold, s.min_iters, seed=s.seed)
    return mixtures.predicted(sets, model.weights).select("read_id", "p", "cluster")


def centres(found: DataFrame, least_share: float = 0.05) -> DataFrame:
    """(cluster, n, share, read_id, distance, p): of each cluster with more than least_share of all members the one with the least
    sum of L1 distances to the others, ties by id; found: (read_id, p, cluster)."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    large = sizes.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") > least_share)
    return relational.medoids_of_sets(found).join(F.broadcast(large), "cluster").select("cluster", "n", "share", "read_id", "distance", "p")


def similarity(few: DataFrame, length: int) -> DataFrame:
    """(a, b, similarity, jaccard) of all pairs a < b of a few structures (read_id, p), such as the centres; pairs without a common
    position included: similarity is 1 less the L1 distance over the length, jaccard that of the unpaired positions (1 if both have
    none)."""
    a, b = (few.select(F.col("read_id").alias(x), F.col("p").alias(f"p{x}"), F.size("p").alias(f"n{x}")) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("shared", F.size(F.array_intersect("pa", "pb")))
    either = F.col("na") + F.col("nb") - F.col("shared")
    l1 = F.col("na") + F.col("nb") - 2 * F.col("shared")
    return pairs.select("a", "b", (1 - l1 / F.lit(float(length))).alias("similarity"), F.when(either == 0, 1.0).otherwise(F.col("shared") / either).alias("jaccard"))


def concordance(found: DataFrame) -> DataFrame:
    """(concordance): how far two clusters follow two conditions; found: (cluster, truth)."""
    return evaluate.accuracy(found).select(F.col("accuracy").alias("concordance"))


#: Structures of a task at most: they are few bytes in a file, so its splits hold many, but k-means keeps `length` numbers of each.
TASK_STRUCTURES = 200_000


def analyse(structs: DataFrame, length: int, s: Settings, truth: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """assignments (struct_id, cluster), centres (with db) and their similarity; concordance if truth gives labels of reads."""
    if (n := structs.count()) > TASK_STRUCTURES:
        structs = structs.repartition(-(-n // TASK_STRUCTURES), "struct_id")
    sets = encoded(structs)
    found, path = clustered(sets, length, s), scratch_path(structs.sparkSession, "clustered")
    found.write.parquet(path)  # several tables are made from it
    found = structs.sparkSession.read.schema(found.schema).parquet(path)
    middle = centres(found, s.least_share)
    names = F.broadcast(middle.drop("p").withColumnRenamed("read_id", "struct_id"))  # a row for each cluster
    out = {
        "assignments": found.select(F.col("read_id").alias("struct_id"), "cluster"),
        "centres": structs.select("struct_id", "db").join(names, "struct_id").select("struct_id", "cluster", "n", "share", "distance", "db"),
        "similarity": similarity(middle, length),
    }
    # neither side is small, whatever the planner takes the columns for
    return out | ({"concordance": concordance(found.join(truth(sets.select("read_id")).hint("merge"), "read_id"))} if truth else {})
