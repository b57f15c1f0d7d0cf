"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records over memory-sized buckets by a seeded hash of their content, so that no source or group of copies can
fill a bucket and a record's bucket does not depend on the layout of the input; rows that are equal in all columns are told apart
by where they stand. A partition holds several buckets if there are many. Pass 2 runs a Fisher-Yates shuffle within each bucket
and writes it to the shared folder. The buckets in turn are the shuffled order; prefix sums of the partitions' sizes place each
record in it, and record g goes to shard g mod n, slot g div n: the shards' row counts differ by one at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

SHARDS = 24
SEED = 20240229
BUCKET_BYTES = 32 << 20
#: Partitions of the shuffle at most, so also of the totals that reach the driver; each sorts its buckets, on disk if need be.
MOST_PARTS = 20_000


def _fisher_yates(tables: list[pa.RecordBatch], seed: int, first: int) -> Iterator[pa.RecordBatch]:
    """One bucket's rows, shuffled, in the places from `first` on; sorted by their hash first, since rows arrive in any order."""
    table = pa.Table.from_batches(tables)
    bucket = table.column("_bucket")[0].as_py()
    order = np.lexsort((table.column("_row").to_numpy(), table.column("_hash").to_numpy())).tolist()
    drawn = np.random.default_rng([seed, bucket]).integers(0, np.arange(len(order), 1, -1)).tolist()
    for i, j in zip(range(len(order) - 1, 0, -1), drawn):
        order[i], order[j] = order[j], order[i]
    # slices of bounded size, so that no string column of a batch passes 2 GB
    for at in range(0, len(order), 500):
        take = order[at : at + 500]
        part = table.take(pa.array(take)).combine_chunks().drop_columns(["_hash", "_row", "_bucket"])
        yield from part.append_column("_slot", pa.array(np.arange(first + at, first + at + len(take), dtype=np.int64))).to_batches()


def external_shuffle(df: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text", most_parts: int = MOST_PARTS) -> tuple[DataFrame, str]:
    """df's columns, and _part (int) and _slot (long: the place in the partition), from the written buckets; and their path.

    Every row is kept, repeated rows and nulls too; an empty table gives no rows. Columns _part, _slot, _bucket, _hash, _row and
    _again of df are replaced. Columns of map type take no part in the hash.
    """
    df = df.drop("_part", "_slot", "_bucket", "_hash", "_row", "_again")
    prepare(df.sparkSession)
    size = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    parts = min(n, most_parts)
    keys = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    placed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *keys)).withColumn("_row", F.monotonically_increasing_id())
    # rows that stand several times, few in most corpora; written first, so that Spark knows its size when it plans the join
    again, _ = materialize(placed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash", F.lit(True).alias("_again")), "repeated")
    placed = placed.join(again, "_hash", "left").withColumn("_hash", F.when(F.col("_again"), F.xxhash64("_hash", "_row")).otherwise(F.col("_hash")))
    placed = placed.withColumn("_bucket", F.pmod("_hash", F.lit(n))).withColumn("_part", F.pmod("_bucket", F.lit(parts)).cast("int"))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done = 0
        for batch in batches:
            marks = batch.column("_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1), len(marks)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if held and held[0].column("_bucket")[0].as_py() != marks[a]:
                    yield from _fisher_yates(held, seed, done)
                    done += sum(h.num_rows for h in held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from _fisher_yates(held, seed, done)

    schema = df.withColumn("_part", F.lit(0)).withColumn("_slot", F.lit(0).cast("long")).schema
    for field in schema:
        field.nullable = True
    dealt = placed.repartitionById(parts, F.col("_part")).sortWithinPartitions("_bucket").select(*names, "_hash", "_row", "_bucket", "_part")
    return materialize(dealt.mapInArrow(run, schema), "buckets")


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """df's columns with shard (int) and slot (long, gapless from 0 in each shard), which replace columns of these names; law
    `rows`: counts at most one apart. Column names of df are free otherwise.

    Null and empty texts, null ids and repeated rows are records like others; an empty table gives no rows. The places of rows that
    differ depend on the rows and the seed alone, however the input is cut into files or partitions; of equal rows which one has
    which place says nothing.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    df = df.drop("shard", "slot")
    # the shuffle's own columns stay apart from df's
    inner = [f"c{i}" for i in range(len(df.columns))]
    at = inner[df.columns.index(text_col)]
    written, _ = external_shuffle(df.toDF(*inner), seed, bucket_bytes, at)
    # one count for each partition, MOST_PARTS at most
    counts = sorted(written.groupBy("_part").count().collect())
    firsts = itertools.accumulate((n for _, n in counts), initial=0)
    table = df.sparkSession.createDataFrame([(b, f) for (b, _), f in zip(counts, firsts)], "_part int, _first long")
    g = F.col("_first") + F.col("_slot")  # the place in the whole order
    out = written.join(F.broadcast(table), "_part")
    return out.select(*[F.col(c).alias(n) for c, n in zip(inner, df.columns)], F.pmod(g, F.lit(shards)).cast("int").alias("shard"), F.expr(f"(_first + _slot) div {shards}").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its files in the order of slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
