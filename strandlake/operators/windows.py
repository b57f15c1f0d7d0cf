"""Windows over positions: coordinates, profile correlation, sums, islands, singular-value entropy, significance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.stats import normal_cdf
from strandlake.operators.ordered import quantile_bucket, running
from strandlake.operators.relational import cooccurrence


def window_coords(spark: SparkSession, length: int, window: int = 100, step: int = 1, offset: int = 0) -> DataFrame:
    """(start, end, mid): windows from offset on; the one that ends at length is left out."""
    starts = spark.range(offset, max(offset, offset + length - window), step).withColumnRenamed("id", "start")
    return starts.select("start", (F.col("start") + window).alias("end"), F.expr(f"(2 * start + {window}) div 2").alias("mid"))


def gene_windows(sizes: DataFrame, window: int = 100, step: int = 1) -> DataFrame:
    """(gene, start, end, mid): the windows of every gene of a size table (gene, length); the one that ends at its length is left
    out, and genes shorter than a window have none."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - window - 1, F.lit(step).cast("long"))
    rows = sizes.where(F.col("length") > window).select("gene", F.explode(starts).alias("start"))
    return rows.select("gene", "start", (F.col("start") + window).alias("end"), F.expr(f"(2 * start + {window}) div 2").alias("mid"))


def window_correlation(profiles: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, mid, r): Pearson correlation of columns x and y over windows of positions that are all there, in each group of
    `by`, such as the gene; without it the positions are one gene's, in one task."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(0, window - 1)
    t = profiles.withColumn("r", F.corr("x", "y").over(w)).withColumn("n", F.count("*").over(w))
    return t.where(F.col("n") == window).select(*by, F.col("pos").alias("start"), (F.col("pos") + window // 2).alias("mid"), "r")


def moving_sum(counts: DataFrame, width: int, value: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """counts with total: the sum of value over positions from pos - width / 2 to pos + width / 2, half-open, in each group of `by`,
    such as the gene."""
    w = Window.partitionBy(*by).orderBy("pos").rangeBetween(-(width // 2), width - width // 2 - 1)
    return counts.withColumn("total", F.sum(value).over(w))


def islands(sites: DataFrame, column: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """(first, last, n): runs of consecutive integers, in each group of `by`; repeated sites count once, missing ones are a run.

    One shuffle and one sort; what follows passes over the sorted rows, so no task holds tables of its sites or runs.
    """
    order, kind = Window.partitionBy(*by).orderBy("_p"), sites.schema[column].dataType
    none = F.lit(-(1 << 63)).cast("long")
    t = sites.select(*by, F.coalesce(F.col(column).cast("long"), none).alias("_p")).withColumn("_b", F.lag("_p").over(order))
    t = t.where("_b IS NULL OR _b < _p").select(*by, "_p", "_b").withColumn("_a", F.lead("_p").over(order))  # each site once
    t = t.withColumn("_begins", F.col("_b").isNull() | (F.col("_b") + 1 < F.col("_p"))).withColumn("_ends", F.col("_a").isNull() | (F.col("_a") > F.col("_p") + 1))
    t = t.where("_begins OR _ends").withColumn("_l", F.lead("_p").over(order)).where("_begins")
    last = F.when(F.col("_ends"), F.col("_p")).otherwise(F.col("_l"))
    return t.select(*by, F.nullif("_p", none).cast(kind).alias("first"), F.nullif(last, none).cast(kind).alias("last"), (last - F.col("_p") + 1).alias("n"))


def spectrum_entropy(gram: np.ndarray, top: int = -1) -> tuple[float, np.ndarray]:
    """Entropy (natural logarithm) of the normalised singular values of the matrix whose Gram matrix is given."""
    s = np.sqrt(np.clip(np.linalg.eigvalsh(gram)[::-1], 0, None))
    s = s[:top] if top > 0 else s
    p = s[s > 0] / s.sum() if s.sum() > 0 else s[:0]
    return float(-(p * np.log(p)).sum()), s


def window_entropy(mods: DataFrame, length: int, window: int, step: int, top: int = -1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, end, entropy, sigma2, sigma4): spectrum of every window of the read x position matrix.

    Co-occurrence counts of positions closer than the window are made once; each pair of positions goes to the windows that
    hold it, at most window / step of them; a task gets the Gram matrix of one window, whatever the number of reads. sigma2
    and sigma4 are the sums of the second and fourth powers of the singular values.
    """
    if by:
        lists = mods.groupBy(*by, "read_id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
        return window_entropy_of_sets(lists, length, window, step, top, by)
    return spectra(cooccurrence(mods, window), length, window, step, top, ())


def window_entropy_of_sets(lists: DataFrame, length: int, window: int, step: int, top: int = -1, by: tuple[str, ...] = ()) -> DataFrame:
    """window_entropy() of reads (by, p), p being the positions in order; only counts of pairs of positions are shuffled."""
    first = lists.select(*by, F.col("p").cast("array<long>").alias("p")).select(*by, "p", F.posexplode("p").alias("k", "i"))
    pairs = first.select(*by, "i", F.explode(F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))).alias("j")).where(F.col("j") - F.col("i") < window)
    return spectra(pairs.groupBy(*by, "i", "j").agg(F.count("*").alias("n11")), length, window, step, top, by)


def spectra(counts: DataFrame, length: int, window: int, step: int, top: int = -1, by: tuple[str, ...] = ()) -> DataFrame:
    """window_entropy() from counts (by, i, j, n11) of reads with both positions i <= j."""
    last = (max(0, length - window) + step - 1) // step - 1  # the largest index of a window
    low = F.greatest(F.lit(0), F.expr(f"(j - {window} + {step}) div {step}"))
    high = F.least(F.lit(last), F.expr(f"i div {step}"))
    spread = counts.where(low <= high).withColumn("w", F.explode(F.sequence(low.cast("long"), high.cast("long"))))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows["w"].iloc[0]) * step
        gram = np.zeros((window, window))
        i, j, n = rows["i"].to_numpy() - start, rows["j"].to_numpy() - start, rows["n11"].to_numpy(float)
        gram[i, j] = n
        gram[j, i] = n
        entropy, s = spectrum_entropy(gram, top)
        out = {c: [rows[c].iloc[0]] for c in by}
        return pd.DataFrame(out | {"start": [start], "end": [start + window], "entropy": [entropy], "sigma2": [float((s**2).sum())], "sigma4": [float((s**4).sum())]})

    types = dict(counts.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["start long", "end long", "entropy double", "sigma2 double", "sigma4 double"])
    return spread.groupBy(*by, "w").applyInPandas(kernel, schema)


def permutation_test(observed: DataFrame, simulated: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(start, entropy, p, significant): p is one less the share of seeds whose value is larger than the observed one."""
    t = observed.select("start", "entropy").join(simulated.select("start", "seed", F.col("entropy").alias("null")), "start")
    t = t.groupBy("start", "entropy").agg((1.0 - F.count_if(F.col("entropy") < F.col("null")) / F.count("*")).alias("p"))
    return t.withColumn("significant", F.col("p") < threshold)


def normal_test(observed: DataFrame, simulated: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(start, entropy, mean, std, p, score, significant): normal tail under the simulated mean and spread, with Bonferroni's
    correction for the number of windows; score is -log10 p, 318 where p is 0."""
    null = simulated.groupBy("start").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("std"))
    t = observed.select("start", "entropy").join(null, "start").withColumn("p", normal_cdf(F.col("entropy"), F.col("mean"), F.col("std")))
    n = observed.agg(F.count("*").alias("windows"))
    return t.join(F.broadcast(n)).select("start", "entropy", "mean", "std", "p", minus_log10(F.col("p")).alias("score"), (F.col("p") < F.lit(threshold) / F.col("windows")).alias("significant"))


def minus_log10(p: Column, filled: float = 318.0) -> Column:
    return F.coalesce(-F.log10(F.nullif(p, F.lit(0.0))), F.lit(filled))


def _by_score(scores: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, p, n): positives and negatives of each distinct score."""
    return scores.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))


def roc(scores: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """(threshold, tpr, fpr): a point for each distinct score, larger scores first; counts are summed by score beforehand."""
    by = _by_score(scores, score, truth)
    run = running(by, {"tp": F.col("p"), "fp": F.col("n")}, quantile_bucket(by, "threshold"), ["threshold"], descending=True)
    every = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return run.join(F.broadcast(every)).select("threshold", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_n").alias("fpr"))


def auc(scores: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """(auc) as the share of pairs of a positive and a negative in which the positive scores higher, ties counting half."""
    by = _by_score(scores, score, truth)
    run = running(by, {"below": F.col("n")}, quantile_bucket(by, "threshold"), ["threshold"])
    won = F.col("p") * (F.col("below") - F.col("n") / 2.0)
    return run.agg(F.try_divide(F.sum(won), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def best_threshold(points: DataFrame) -> DataFrame:
    """The point of the ROC with the largest tpr (1 - fpr), the higher threshold if there are several."""
    return points.agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.round((1 - F.col("fpr")) * F.col("tpr"), 9), "threshold")).alias("b")).select("b.*")


def classification(calls: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """One row: accuracy, recall, precision, f1 of 0/1 calls."""
    p, t = F.col(predicted) == 1, F.col(truth) == 1
    c = calls.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count("*").alias("n"))
    div = F.try_divide
    d = lambda x: x.cast("double")
    return c.select(
        div(d(F.col("n") - F.col("fp") - F.col("fn")), F.col("n")).alias("accuracy"), div(d(F.col("tp")), F.col("tp") + F.col("fn")).alias("recall"),
        div(d(F.col("tp")), F.col("tp") + F.col("fp")).alias("precision"), div(2 * d(F.col("tp")), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )
