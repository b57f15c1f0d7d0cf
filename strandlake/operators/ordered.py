"""Ranks and running sums over a whole table, without gathering it in one task.

Rows are dealt to buckets that follow the order. Sums within a bucket come from a window over that bucket alone, and what
stands before a bucket from a running sum over the table of bucket totals, which has one row for each bucket and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def hash_bucket(hashed: Column) -> Column:
    """A bucket of 4096 for a hexadecimal hash; buckets follow the order of the hash."""
    return F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")


def quantile_bucket(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """A bucket for a numeric column by its approximate quantiles; buckets follow the order of the column, nulls come first."""
    bounds = df.approxQuantile(column, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))
    distinct = sorted(set(bounds))
    if not distinct:
        return F.lit(0)
    x = F.col(column).cast("double")
    # the value's place among the bounds; without a lambda, which the optimizer would carry into the other side of a join
    placed = F.sort_array(F.array_append(F.array(*[F.lit(float(b)) for b in distinct]), x))
    return F.coalesce(F.array_position(placed, x), F.lit(0)).cast("int")


def running(df: DataFrame, values: dict[str, Column], bucket: Column, order: list, by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """df with a column for each of values: its sum over the rows of the same group from the first to this one, in order.

    order: columns that bucket follows; with descending the first of them goes from high to low. Ties take the order of the
    further columns.
    """
    t = df.withColumn("_bucket", -bucket if descending else bucket)
    keys = list(order)
    if descending:
        keys[0] = F.desc(keys[0]) if isinstance(keys[0], str) else keys[0].desc()
    for k, v in values.items():
        t = t.withColumn(f"_v_{k}", v)
    totals = t.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_f_{k}") for k in values])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(F.broadcast(firsts), [*by, "_bucket"])
    for k in values:
        t = t.withColumn(k, F.col(f"_f_{k}") + F.sum(f"_v_{k}").over(inside))
    return t.select(*[c for c in df.columns if c not in values], *values)


def rank(df: DataFrame, bucket: Column, order: list, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1 on."""
    return running(df, {name: F.lit(1).cast("long")}, bucket, order, by)
