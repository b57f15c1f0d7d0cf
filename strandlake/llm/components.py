"""Connected components by alternating large-star and small-star steps, wholly as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    return (
        near.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        .where("a <> b")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that can be reached.

    edges: columns a, b (long). Loops, repeated edges and either direction are fine; null ends are dropped.
    No edges: no rows. Each round ends in a table in the shared folder; only three numbers reach the driver.
    """
    spark = edges.sparkSession
    now, path = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        after, new = materialize(_small_star(_large_star(now)), "edges")
        release(spark, path)
        now, path, before, state = after, new, state, _state(after)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
