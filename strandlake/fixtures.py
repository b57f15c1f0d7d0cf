"""Shapes of the domain made from the driver's tables, as DataFrames and as the same SQL for DuckDB.

Reads carry (read_id, cond, length); a read's modified positions are rows (read_id, pos). cond 0 is the first condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

L_ORDER = 200
L_EMBEDDING = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("read_id"), (k % 2).cast("long").alias("cond"), (F.lit(140) + k % 61).cast("long").alias("length"))


def order_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_mods() as they stand in the table, some repeated."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % L_ORDER).cast("long").alias("pos"))


def order_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_sites(spark, sf_dir).distinct()


ORDER_SQL = """
reads AS (SELECT o_orderkey AS read_id, cast(o_orderkey % 2 AS BIGINT) AS cond, cast(140 + o_orderkey % 61 AS BIGINT) AS length FROM orders),
mods AS (SELECT DISTINCT l_orderkey AS read_id, cast(l_partkey % 200 AS BIGINT) AS pos FROM lineitem)"""


def embedding_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 2).cast("long").alias("cond"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.posexplode("embedding").alias("pos", "v"))
    return cells.select("read_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


def embedding_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_cells(spark, sf_dir).where("v > cast(0.15 as double)").select("read_id", "pos")


EMBEDDING_SQL = """
reads AS (SELECT vec_id AS read_id, cast(label AS BIGINT) AS label, cast(vec_id % 2 AS BIGINT) AS cond FROM embeddings),
cells AS (SELECT vec_id AS read_id, cast(unnest(range(0, len(embedding))) AS BIGINT) AS pos, cast(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
mods AS (SELECT read_id, pos FROM cells WHERE v > cast(0.15 AS DOUBLE))"""


def bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, label, bits): the embeddings as bit vectors over 0, ?, . and the mismatched bases."""
    bit = F.expr("CASE WHEN v > cast(0.15 as double) THEN substr('ATGC', cast(pos % 4 as int) + 1, 1) WHEN v < cast(-0.30 as double) THEN '?' WHEN v < cast(-0.25 as double) THEN '.' ELSE '0' END")
    rows = embedding_cells(spark, sf_dir).select("read_id", F.struct("pos", bit.alias("b")).alias("x")).groupBy("read_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    strings = rows.select("read_id", F.array_join(F.transform("x", lambda x: x["b"]), "").alias("bits"))
    return strings.join(embedding_reads(spark, sf_dir).select("read_id", "label"), "read_id")


BITS_SQL = (
    EMBEDDING_SQL
    + """,
bitvec AS (
  SELECT c.read_id, any_value(r.label) AS label, string_agg(
    CASE WHEN v > cast(0.15 AS DOUBLE) THEN substr('ATGC', cast(pos % 4 AS INT) + 1, 1) WHEN v < cast(-0.30 AS DOUBLE) THEN '?'
      WHEN v < cast(-0.25 AS DOUBLE) THEN '.' ELSE '0' END, '' ORDER BY pos) AS bits
  FROM cells c JOIN reads r ON c.read_id = r.read_id GROUP BY c.read_id)"""
)


def dot_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(struct_id, db): the letters in the MD5 of an order's key open pairs, and the mirror image closes them."""
    left = F.translate(F.md5(F.col("o_orderkey").cast("string")), "abcdef0123456789", "((((((..........")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("struct_id"), left.alias("l")).select("struct_id", F.concat("l", F.lit("..."), F.translate(F.reverse("l"), "(", ")")).alias("db"))


DOT_SQL = """
structs AS (
  SELECT struct_id, l || '...' || replace(reverse(l), '(', ')') AS db FROM (
    SELECT o_orderkey AS struct_id, regexp_replace(regexp_replace(md5(cast(o_orderkey AS VARCHAR)), '[a-f]', '(', 'g'), '[0-9]', '.', 'g') AS l FROM orders))"""


def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cond, pos, value, coverage): hours of the events table, conditions by user."""
    ev = table(spark, sf_dir, "events")
    hour = F.expr("cast(floor((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 3600000000) as bigint)")
    ev = ev.select((F.col("user_id") % 2).cast("long").alias("cond"), hour.alias("pos"), F.col("value").cast("double").alias("value"))
    return ev.groupBy("cond", "pos").agg(F.sum("value").alias("value"), F.count("*").alias("coverage"))


EVENT_SQL = """
profiles AS (
  SELECT cast(user_id % 2 AS BIGINT) AS cond, cast(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS pos,
    sum(cast(value AS DOUBLE)) AS value, cast(count(*) AS BIGINT) AS coverage FROM events GROUP BY 1, 2)"""
