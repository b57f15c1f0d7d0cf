"""Clusters against conditions: purity, flips, contingency tables, agreement measures, profile correlation, reactivities.

assignments: (read_id, cond, cluster), cond 0 or 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.stats import adjusted_mutual_information
from strandlake.operators.ordered import hash_bucket, rank


def cluster_purity(assignments: DataFrame, unknown: float = 0.0) -> DataFrame:
    """(cluster, n0, n1, ppv0, ppv1, base0, base1, best, call) of each cluster.

    ppv: share of either condition in the cluster; base: its share among all reads; best: the condition with the larger gain
    over its base, ties to 0; call: best, or 'UN' where the best gain is under `unknown`.
    """
    base = assignments.agg((F.count_if(F.col("cond") == 0) / F.count("*")).alias("base0"), (F.count_if(F.col("cond") == 1) / F.count("*")).alias("base1"))
    t = assignments.groupBy("cluster").agg(F.count_if(F.col("cond") == 0).alias("n0"), F.count_if(F.col("cond") == 1).alias("n1"))
    n = F.col("n0") + F.col("n1")
    t = t.withColumn("ppv0", F.try_divide(F.col("n0").cast("double"), n)).withColumn("ppv1", F.try_divide(F.col("n1").cast("double"), n)).join(F.broadcast(base))
    best = F.when(F.col("ppv1") - F.col("base1") > F.col("ppv0") - F.col("base0"), 1).otherwise(0).cast("long")
    t = t.withColumn("best", best)
    gain = F.when(F.col("best") == 1, F.col("ppv1") - F.col("base1")).otherwise(F.col("ppv0") - F.col("base0"))
    call = F.when(gain < unknown, "UN").when(F.col("best") == 1, "MT").otherwise("WT")
    return t.withColumn("call", call)


def flip_order(assignments: DataFrame) -> DataFrame:
    """(cluster, best): the condition that each cluster stands for."""
    return cluster_purity(assignments).select("cluster", "best")


def called(assignments: DataFrame, unknown: float = 0.0) -> DataFrame:
    """assignments with the call of their cluster; clusters are few, so their table is broadcast."""
    return assignments.join(F.broadcast(cluster_purity(assignments, unknown).select("cluster", "call")), "cluster")


def inferred_proportions(assignments: DataFrame) -> DataFrame:
    """(cond, best, n, percent): how each condition's reads divide over the clusters, by what the clusters stand for."""
    t = assignments.join(F.broadcast(flip_order(assignments)), "cluster").groupBy("cond", "best").agg(F.count("*").alias("n"))
    return t.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("cond")))


def split_unknown(called_reads: DataFrame, seed: int = 386) -> DataFrame:
    """called reads with group: the call, and for UN reads the first condition for as many as its share of all reads says,
    in the order of a hash of their ids."""
    share = called_reads.agg((F.count_if(F.col("cond") == 0) / F.count("*")).alias("share"))
    un = called_reads.where("call = 'UN'")
    size = un.agg(F.count("*").alias("size"))
    keyed = un.withColumn("_key", F.md5(F.concat(F.col("read_id").cast("string"), F.lit(f"|{seed}"))))
    ranked = rank(keyed, hash_bucket(F.col("_key")), ["_key", "read_id"]).drop("_key").join(F.broadcast(share)).join(F.broadcast(size))
    un = ranked.withColumn("group", F.when(F.col("rank") <= F.floor(F.col("share") * F.col("size")), "WT").otherwise("MT"))
    known = called_reads.where("call <> 'UN'").withColumn("group", F.col("call"))
    return known.unionByName(un.select(*known.columns))


def contingency(labels: DataFrame, truth: str = "truth", predicted: str = "cluster") -> DataFrame:
    """(truth, cluster, n)."""
    return labels.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n.cast("double") - 1) / 2


def agreement(table: DataFrame, truth: str = "truth", predicted: str = "cluster") -> DataFrame:
    """One row: n, rand, ari, fms (Fowlkes-Mallows) from a contingency table; all from sums of pairs within its cells, rows
    and columns."""
    rows = table.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    cols = table.groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    cells = table.agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("c"))
    t = cells.join(F.broadcast(rows)).join(F.broadcast(cols)).withColumn("p", _pairs(F.col("n")))
    expected = F.col("a") * F.col("b") / F.col("p")
    ari = F.when((F.col("a") + F.col("b")) / 2 == expected, 1.0).otherwise((F.col("c") - expected) / ((F.col("a") + F.col("b")) / 2 - expected))
    return t.select("n", ((F.col("p") + 2 * F.col("c") - F.col("a") - F.col("b")) / F.col("p")).alias("rand"), ari.alias("ari"), F.try_divide(F.col("c"), F.sqrt(F.col("a") * F.col("b"))).alias("fms"))


def accuracy(labels: DataFrame, truth: str = "truth", predicted: str = "cluster") -> DataFrame:
    """Share of equal labels; for two labels 0 and 1 the better one of the labels and their inverse."""
    hit = F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0))
    return labels.agg(hit.alias("a")).select(F.greatest("a", 1 - F.col("a")).alias("accuracy"))


def mutual_information(table: DataFrame, truth: str = "truth", predicted: str = "cluster") -> DataFrame:
    """(ami) from a contingency table, which has one row for each pair of labels."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ami": [adjusted_mutual_information(rows.pivot(index=truth, columns=predicted, values="n").fillna(0).to_numpy())]})

    return table.groupBy().applyInPandas(kernel, "ami double")


def profile_correlation(profiles: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """(key, other_key, r): Pearson correlation of every profile with every other one, position by position."""
    y = other.select(F.col(other_key), "pos", F.col("rate").alias("_rate"))
    return profiles.join(y, "pos").groupBy(key, other_key).agg(F.corr("rate", "_rate").alias("r"))


def normalisation(profiles: DataFrame) -> DataFrame:
    """One row with factor: the larger of 1.5 interquartile ranges and the 90th percentile of all rates."""
    q = profiles.agg(F.percentile("rate", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias("q"))
    return q.select(F.greatest(1.5 * (F.col("q")[1] - F.col("q")[0]), F.col("q")[2]).alias("factor"))


def reactivities(profiles: DataFrame, least: float = 0.01, missing: float = -999.0) -> DataFrame:
    """profiles with reactivity: the rate over the normalisation factor, or `missing` where the rate is under `least`."""
    t = profiles.join(F.broadcast(normalisation(profiles)))
    return t.withColumn("reactivity", F.when(F.col("rate") < least, F.lit(missing)).otherwise(F.col("rate") / F.col("factor"))).drop("factor")


def capped_by_top(profiles: DataFrame, key: str, top: int) -> DataFrame:
    """profiles with norm: the rate over the median of a profile's `top` largest rates, at most 1, to 3 places."""
    ranked = profiles.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rate"), "pos")))
    middle = ranked.where(F.col("_n") <= top).groupBy(key).agg(F.median("rate").alias("middle"))
    return profiles.join(F.broadcast(middle), key).withColumn("norm", F.round(F.least(F.lit(1.0), F.col("rate") / F.col("middle")), 3)).drop("middle")


def fold_constraints(profiles: DataFrame, key: str, sequence: str, top: int, missing: float = -999.0, open_bases: str = "AC") -> DataFrame:
    """(key, pos, constraint): capped_by_top of the positions whose base can be modified, `missing` at the others. sequence
    is the reference, one base for each position."""
    base = F.substring(F.lit(sequence), (F.col("pos") + 1).cast("int"), F.lit(1))
    t = capped_by_top(profiles, key, top)
    return t.select(key, "pos", F.when(base.isin(*open_bases), F.col("norm")).otherwise(F.lit(missing)).alias("constraint"))


def cluster_scatter(profiles: DataFrame, key: str, reference: dict[int, str] | None = None) -> DataFrame:
    """(x, y, n, slope, r2) for clusters x < y: regression of y's rates on x's over positions above 0 in both (and with A or
    C in the reference, if given), each scaled by its largest."""
    p = profiles
    if reference is not None:
        p = p.where(F.col("pos").isin([k for k, base in reference.items() if base in "AC"]))
    a = p.where("rate > 0").select(F.col(key).alias("x"), "pos", F.col("rate").alias("rx"))
    b = p.where("rate > 0").select(F.col(key).alias("y"), "pos", F.col("rate").alias("ry"))
    both = a.join(b, "pos").where("x < y")
    w = Window.partitionBy("x", "y")
    both = both.withColumn("rx", F.col("rx") / F.max("rx").over(w)).withColumn("ry", F.col("ry") / F.max("ry").over(w))
    return both.groupBy("x", "y").agg(F.count("*").alias("n"), F.regr_slope("ry", "rx").alias("slope"), F.regr_r2("ry", "rx").alias("r2"))
