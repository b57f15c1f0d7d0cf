"""Mutation profiles of a text table: reads, their consensus, bit vectors against it, and rates by position.

    python -m jobs.mutation_profiles --input TABLES/documents.parquet --output OUT [--config FILE]

A row's text holds a molecule's sequence among other characters: its letters A, C, G and T, of either case, are the bases, cut into
reads of the gene's length. A row belongs to a sample and a gene by two of its columns. The consensus of a gene has the most
frequent base at each position (of equal ones the first by letter); a read's bit vector has 0 where the read has that base, its own
base elsewhere, and a point behind its end. Reads whose share of mismatches is strictly between two bounds are kept.

OUT gets
- library: read_id, piece, bits, n_mut, rate, kept, partitioned by sample and gene,
- profiles: pos, base, covered, informative, mismatches, rate over the kept reads, partitioned by sample and gene,
- histograms: n_mut, n_reads over all reads, partitioned by sample and gene,
- consensus: a FASTA text with one record for each gene.

A rerun over the same input writes the same. With samples in the config, only these are read and only their partitions replaced.
The consensus always is of all samples, so that what stands in other partitions stays comparable.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import bitvec, filters
from strandlake.sources import writers

log = logging.getLogger("jobs.mutation_profiles")
KEYS = ("sample", "gene")
LIBRARY = "read_id string, piece long, bits string, n_mut long, rate double, kept boolean, sample string, gene string"
PROFILES = "pos long, base string, covered long, informative long, mismatches long, rate double, sample string, gene string"
HISTOGRAMS = "n_mut long, n_reads long, sample string, gene string"


SCHEMAS = {"library": LIBRARY, "profiles": PROFILES, "histograms": HISTOGRAMS}


@dataclass(frozen=True)
class Config:
    id: str = "doc_id"
    text: str = "text"
    sample: str = "source"
    gene: str = "lang"
    length: int = 200
    share: float = 0.8  # of the gene that a read must cover
    low: float = 0.0
    high: float = 0.7
    samples: tuple[str, ...] | None = None

    @classmethod
    def load(cls, path: str) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := given.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        if given.get("samples") is not None:
            given["samples"] = tuple(given["samples"])
        return cls(**given)


DEFAULT = str(Path(__file__).with_suffix(".json"))


def reads_of(table: DataFrame, c: Config) -> DataFrame:
    """(read_id, sample, gene, piece, seq, length): whole texts, cut into reads. A null or empty sample or gene is 'none'; a null text
    has no read; repeated rows are reads of their own."""
    named = lambda col: F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit("none"))
    rows = table.select(F.col(c.id).cast("string").alias("read_id"), named(c.sample).alias("sample"), named(c.gene).alias("gene"), F.col(c.text).alias("all"))
    return filters.filter_reads_by_length(bitvec.cut(rows, c.length), c.length, c.share)


def consensus_of(reads: DataFrame) -> DataFrame:
    """(gene, pos, base): the most frequent base, of equal ones the first. Counts are made before the shuffle, four for a position."""
    counts = bitvec.base_counts(reads.withColumn("bits", F.col("seq")), ("gene",))
    return counts.groupBy("gene", "pos").agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("base"))


def sequences(consensus: DataFrame) -> DataFrame:
    """(gene, ref): the consensus as text. A gene has at most `length` positions, without gaps since reads start at 0."""
    rows = consensus.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    return rows.select("gene", F.array_join(F.transform("b", lambda x: x["base"]), "").alias("ref"))


def library_of(reads: DataFrame, refs: DataFrame, c: Config) -> DataFrame:
    """Bit vectors of all reads against the gene's consensus, and whether the read is kept."""
    rows = bitvec.against(reads.join(refs, "gene").select("read_id", "sample", "gene", "piece", "length", "seq", "ref"))
    rows = rows.withColumn("rate", F.col("n_mut") / F.col("length"))
    return rows.withColumn("kept", (F.col("rate") > c.low) & (F.col("rate") < c.high)).drop("length")


def run(spark: SparkSession, source: str, output: str, config: Config | None = None) -> dict[str, int]:
    """Do the job; returns how many rows it has read and how many its tables have now."""
    c = config or Config.load(DEFAULT)
    def write(df: DataFrame, name: str) -> None:
        # rebalanced by partition: few files in each, and a partition that holds a third of all rows is split
        writer = df.hint("rebalance", *KEYS).write.mode("overwrite").partitionBy(*KEYS).option("partitionOverwriteMode", "static" if c.samples is None else "dynamic")
        writer.parquet(f"{output}/{name}")

    table = spark.read.parquet(source)
    refs = sequences(consensus_of(reads_of(table, c)))
    lines = writers.fasta_lines(refs.select(F.col("gene").alias("id"), F.col("ref").alias("seq")))
    lines.coalesce(1).write.mode("overwrite").text(f"{output}/consensus")  # one record for each gene
    # the bases as written, so that a changing input can't give two versions within one run
    written = spark.read.text(f"{output}/consensus", lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r"))
    refs = written.select(F.regexp_extract("r", r"^([^\n]*)", 1).alias("gene"), F.regexp_extract("r", r"\n([ACGT]*)", 1).alias("ref"))

    reads = reads_of(table, c)
    if c.samples is not None:
        reads = reads.where(F.col("sample").isin(*c.samples))
    write(library_of(reads, refs, c), "library")

    library = spark.read.schema(LIBRARY).parquet(f"{output}/library")
    if c.samples is not None:
        library = library.where(F.col("sample").isin(*c.samples))
    rates = bitvec.population_average(library.where("kept"), by=KEYS)
    bases = refs.select("gene", F.posexplode(F.split("ref", "")).alias("pos", "base")).withColumn("pos", F.col("pos").cast("long"))
    write(rates.join(bases, ["gene", "pos"]).select("pos", "base", "covered", "informative", "mismatches", "rate", *KEYS), "profiles")
    write(library.groupBy(*KEYS, "n_mut").agg(F.count("*").alias("n_reads")).select("n_mut", "n_reads", *KEYS), "histograms")
    done = {"read": table.count(), "genes": refs.count()}  # of Parquet the files' footers have the counts
    log.info("read %d rows of %s", done["read"], source)
    log.info("wrote %d sequences to %s/consensus", done["genes"], output)
    for name in ("library", "profiles", "histograms"):
        done[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{output}/{name}").count()
        log.info("%s/%s has %d rows", output, name, done[name])
    return done


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """All that the job has written but the FASTA text, as one table: kind tells library, profile and histogram rows apart."""
    library = spark.read.schema(LIBRARY).parquet(f"{output}/library").withColumn("kind", F.lit("library"))
    profiles = spark.read.schema(PROFILES).parquet(f"{output}/profiles").withColumn("kind", F.lit("profile"))
    histograms = spark.read.schema(HISTOGRAMS).parquet(f"{output}/histograms").withColumn("kind", F.lit("histogram"))
    return library.unionByName(profiles, allowMissingColumns=True).unionByName(histograms, allowMissingColumns=True)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.mutation_profiles", description="Mutation profiles of a text table.")
    p.add_argument("--input", required=True, help="a Parquet table of texts")
    p.add_argument("--output", required=True, help="folder of the job's tables")
    p.add_argument("--config", default=DEFAULT, help="JSON file of settings")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("mutation-profiles").getOrCreate()
    try:
        run(spark, a.input, a.output, Config.load(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
