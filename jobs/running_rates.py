"""Running modification rates from events that keep arriving.

    python -m jobs.running_rates --input TABLES/events.parquet --output OUT --checkpoint CHECKPOINT [--config FILE]

An event is what one read shows at one position: a gene, a position, a time and a signal level; levels above a bound are
modifications. A run takes the files that have come since the last one (a file stream that ends when all are taken; its checkpoint
holds which) and counts them once.

OUT gets
- counts: gene, pos, covered, informative, mods, partitioned by batch and day: what each batch of files added,
- rates: gene, pos, covered, informative, mods, rate, partitioned by day: the sum of all batches.

Counts are sums, so a late file changes the days it speaks of and no event is too late. Only these days are written anew. A batch
that is repeated after a failure replaces its own counts, and the days' sums are made from counts again, so a rerun gives the same.
Missing genes and times are 'none'; a missing level or position covers nothing that is informative.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs.running_rates")
KEYS = ("gene", "pos")
COUNTS = "gene string, pos long, covered long, informative long, mods long, batch long, day string"
RATES = "gene string, pos long, covered long, informative long, mods long, rate double, day string"


@dataclass(frozen=True)
class Config:
    gene: str = "event_type"
    pos: str = "user_id"
    time: str = "ts"
    level: str = "value"
    above: float = 20.0
    files_per_batch: int = 64

    @classmethod
    def load(cls, path: str) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := given.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        return cls(**given)


DEFAULT = str(Path(__file__).with_suffix(".json"))


def counted(events: DataFrame, c: Config) -> DataFrame:
    """(day, gene, pos, covered, informative, mods): partial counts go through the shuffle, so a hot gene is no hot task."""
    level = F.col(c.level).cast("double")
    rows = events.select(
        F.coalesce(F.col(c.time).cast("date").cast("string"), F.lit("none")).alias("day"),
        F.coalesce(F.nullif(F.col(c.gene).cast("string"), F.lit("")), F.lit("none")).alias("gene"),
        F.col(c.pos).cast("long").alias("pos"),
        F.when(~F.isnan(level), level).alias("level"),
    )
    known = F.col("level").isNotNull() & F.col("pos").isNotNull()
    return rows.groupBy("day", *KEYS).agg(F.count("*").alias("covered"), F.count_if(known).alias("informative"), F.count_if(known & (F.col("level") > c.above)).alias("mods"))


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that df has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, number: int, output: str, c: Config) -> None:
    """Add one batch of events. The batch is read once; all else comes from counts that are written."""
    spark = batch.sparkSession
    _replace(counted(batch, c).withColumn("batch", F.lit(number).cast("long")), f"{output}/counts", "batch", "day")
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts").where(F.col("batch") <= number)
    new = {r["day"]: r["n"] for r in counts.where(F.col("batch") == number).groupBy("day").agg(F.sum("covered").alias("n")).collect()}  # calendar days
    days = sorted(new)
    log.info("batch %d: read %d events of %d days", number, sum(new.values()), len(days))
    if not days:
        return
    sums = counts.where(F.col("day").isin(*days)).groupBy("day", *KEYS).agg(*[F.sum(n).alias(n) for n in ("covered", "informative", "mods")])
    rates = sums.withColumn("rate", F.try_divide(F.col("mods").cast("double"), F.col("informative")))
    _replace(rates.select(*[n.split()[0] for n in RATES.split(", ")]).hint("rebalance", "day"), f"{output}/rates", "day")
    log.info("batch %d: wrote the rates of %d days, %d rows, to %s", number, len(days), read_output(spark, output).where(F.col("day").isin(*days)).count(), output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config | None = None) -> int:
    """Take what is new under source and wait until it is done; returns the number of batches."""
    c = config or Config.load(DEFAULT)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c.files_per_batch).parquet(source)
    done: list[int] = []

    def batch(df: DataFrame, number: int) -> None:
        take(df, number, output, c)
        done.append(number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %d batches from %s", len(done), source)
    return len(done)


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(RATES).parquet(f"{output}/rates")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.running_rates", description="Running modification rates from arriving events.")
    p.add_argument("--input", required=True, help="folder where Parquet files of events arrive, or a pattern of paths")
    p.add_argument("--output", required=True, help="folder of the job's tables")
    p.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    p.add_argument("--config", default=DEFAULT, help="JSON file of settings")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("running-rates").getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, Config.load(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
