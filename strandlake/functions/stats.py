"""Special functions and tests that Spark SQL lacks: normal and chi-square tails, regression p-values, mutual information."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf, na_action="ignore").astype(float)


@pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore").astype(float)


@pandas_udf(DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma, na_action="ignore").astype(float)


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    """P(X <= x). Without spread the distribution is a step at the mean; null stays null."""
    z = (x - mean) / F.nullif(std, F.lit(0.0))
    return F.when(std == 0, F.when(x >= mean, 1.0).otherwise(0.0)).otherwise(0.5 * erfc(-z / math.sqrt(2)))


def chi2_tail_dof1(x: Column) -> Column:
    """P(X > x) of a chi-square variable with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation or regression slope."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def adjusted_mutual_information(table: np.ndarray) -> float:
    """AMI (arithmetic mean) of a contingency table of counts."""
    table = np.asarray(table, float)
    a, b, n = table.sum(1), table.sum(0), table.sum()
    if n == 0 or (len(a) <= 1 and len(b) <= 1):
        return 1.0

    def h(v: np.ndarray) -> float:
        p = v[v > 0] / n
        return float(-(p * np.log(p)).sum())

    i, j = np.nonzero(table)
    nij = table[i, j]
    mi = float((nij / n * np.log(n * nij / (a[i] * b[j]))).sum())
    lg = np.vectorize(math.lgamma)
    expected = 0.0
    for x in a:
        for y in b:
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            if len(k):
                logp = math.lgamma(x + 1) + math.lgamma(y + 1) + math.lgamma(n - x + 1) + math.lgamma(n - y + 1) - math.lgamma(n + 1)
                logp = logp - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1)
                expected += float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    mean = (h(a) + h(b)) / 2
    return 1.0 if mean == expected else (mi - expected) / (mean - expected)
