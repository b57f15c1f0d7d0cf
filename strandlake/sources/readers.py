"""Readers of the domain's text formats, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, length) from a TSV without a header."""
    return spark.read.schema("gene string, length long").csv(path, sep="\t")


def read_ids(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(row_idx, read_id, length, start): a sidecar of a matrix with the columns idx, id or idx, id, length, start."""
    return spark.read.schema("row_idx long, read_id string, length long, start long").option("mode", "PERMISSIVE").csv(path, sep=sep)


def matrix_market(spark: SparkSession, path: str, width: int | None = None, named: bool = False) -> DataFrame:
    """(row_idx, pos), 0-based, of the entries other than 0; with named, also matrix: its file, or its folder of part files.

    Several matrices may stand under one path. The first line of each that is no comment has its dimensions. A matrix wider than
    `width` is an error when it is read.
    """
    file = F.col("_metadata.file_path")
    of = F.when(file.rlike("/part-[^/]*$"), F.regexp_replace(file, "/[^/]*$", "")).otherwise(file)
    at = F.struct(file, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # large files are read first
    lines = spark.read.text(path).select("value", of.alias("matrix"), at.alias("_at")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = lines.groupBy("matrix").agg(F.min("_at").alias("_first"), F.min_by("value", "_at").alias("_dims"))
    cells = lines.join(first, "matrix")
    if width is not None:
        wide = F.split(F.trim("_dims"), "\\s+")[1].cast("long") > width
        cells = cells.where(F.when(wide, F.raise_error(F.lit("the matrix is wider than its gene"))).otherwise(F.lit(True)))
    part = F.split(F.trim("value"), "\\s+")
    cells = cells.where(F.col("_at") != F.col("_first")).select("matrix", (part[0].cast("long") - 1).alias("row_idx"), (part[1].cast("long") - 1).alias("pos"), F.coalesce(F.get(part, F.lit(2)).cast("double"), F.lit(1.0)).alias("v"))
    return cells.where("v <> 0").select(*["matrix"] * named, "row_idx", "pos")


def dense_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(bits, p) of the rows of a table of 0s and 1s: their text without separators and the positions of the 1s. A header line
    of positions or names, in each file or in the first, is no such row."""
    rows = spark.read.text(path).where(F.col("value").rlike("^[01](?:" + re.escape(sep) + "[01])*$"))
    cells = F.split("value", re.escape(sep))
    ones = F.filter(F.transform(cells, lambda x, i: F.when(x == "1", i.cast("long"))), lambda x: x.isNotNull())
    return rows.select(F.array_join(cells, "").alias("bits"), ones.alias("p"))


def read_matrix(spark: SparkSession, matrix: str, ids: str, gene: str, sizes_path: str, sep: str = ",", share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """reads (read_id, row_idx, length, start) and mods (read_id, pos) of one gene; where lengths are known, reads that cover
    less than `share` of the gene are left out."""
    length = sizes(spark, sizes_path).where(F.col("gene") == gene).first()
    if length is None:
        raise ValueError(f"{gene} has no size")
    reads = read_ids(spark, ids, sep).where(F.col("length").isNull() | (F.col("length") >= share * length["length"]))
    mods = matrix_market(spark, matrix, length["length"]).join(reads.select("row_idx", "read_id"), "row_idx").select("read_id", "pos")
    return reads, mods


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): records of FASTA files; the id is the header's first word. Files are cut at their records, so a task holds one
    record at a time, not a file."""
    record = F.regexp_replace("value", "^>", "")
    rows = spark.read.text(path, lineSep="\n>").where(F.trim(F.regexp_replace(record, "\\s", "")) != "").select(record.alias("r"))
    return rows.select(F.regexp_extract("r", r"^(\S*)", 1).alias("id"), F.upper(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def phred(spark: SparkSession, path: str) -> dict[str, int]:
    """Symbol to score, from a file of `score symbol` with a header."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("p")).where("size(p) >= 2").collect()  # at most 94 symbols
    return {r["p"][1]: int(r["p"][0]) for r in rows if r["p"][0].isdigit()}


def sam(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """Alignments: qname, flag, rname, pos (1-based), mapq, cigar, rnext, pnext, tlen, seq, qual, md. Secondary and
    supplementary ones (flags 256 and 2048) are left out unless every is set: bits of a mate come from one alignment."""
    p = F.split("value", "\t")
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    cols = [(p[i].cast("long") if n in ("flag", "pos", "mapq", "pnext", "tlen") else p[i]).alias(n) for i, n in enumerate(names)]
    md = F.regexp_extract("value", r"\tMD:Z:(\S+)", 1)
    rows = spark.read.text(path).where("value NOT RLIKE '^@(HD|SQ|RG|PG|CO)\t' AND size(split(value, '\t')) >= 11").select(*cols, md.alias("md"))
    return rows if every else rows.where(F.col("flag").bitwiseAND(256 + 2048) == 0)


def paired(alignments: DataFrame) -> DataFrame:
    """alignments with mate 1 or 2 by their flag, of the pairs whose two mates name each other's place."""
    t = alignments.withColumn("mate", F.when(F.col("flag").bitwiseAND(128) != 0, 2).otherwise(1))
    a, b = t.where("mate = 1").alias("a"), t.where("mate = 2").alias("b")
    good = a.join(b, (F.col("a.qname") == F.col("b.qname")) & (F.col("a.rname") == F.col("b.rname")) & (F.col("a.pnext") == F.col("b.pos")) & (F.col("b.pnext") == F.col("a.pos")))
    return t.join(good.select(F.col("a.qname").alias("qname")).distinct(), "qname", "left_semi")


def bit_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, bits, n_mut) from a bit-vector text file; its header lines don't match the form of a row."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("value NOT LIKE '@%' AND value NOT LIKE 'Query_name%' AND size(split(value, '\t')) >= 2")
    return rows.select(p[0].alias("read_id"), p[1].alias("bits"), F.get(p, F.lit(2)).cast("double").alias("n_mut"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, tx_start long, utr5 long, utr3 long, tx_end long").csv(path, sep="\t", header=True)


def coverage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, coverage) rows of modification-rate files."""
    return spark.read.schema("pos long, other string, coverage double").csv(paths, sep="\t").select("pos", "coverage")


def chimeric(spark: SparkSession, path: str) -> DataFrame:
    """(iid, s1, e1, s2, e2, counts) of a chimeric-pair TSV; the count stands behind the last underscore of column 12."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("size(split(value, '\t')) > 12")
    return rows.select(p[0].alias("iid"), *[p[i].cast("long").alias(n) for i, n in ((1, "s1"), (2, "e1"), (4, "s2"), (5, "e2"))], F.element_at(F.split(p[12], "_"), -1).cast("long").alias("counts"))


def connect_table(spark: SparkSession, path: str) -> DataFrame:
    """(i, j), 0-based pairs of a .ct file, whose first line is a title."""
    p = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d+\s+[A-Za-z]\s+\d+\s+\d+\s+\d+\s+\d+"))
    return rows.select((p[0].cast("long") - 1).alias("i"), (p[4].cast("long") - 1).alias("j")).where("j >= 0")


def shape_values(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a two-column file."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("size(split(trim(value), '\\\\s+')) = 2").select(p[0].cast("long").alias("pos"), p[1].cast("double").alias("value"))


def arcs_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, color) of a BED file without its track lines."""
    p = F.split("value", "\t")
    return spark.read.text(path).where("value NOT LIKE 'track%' AND size(split(value, '\t')) >= 3").select(p[0].alias("chrom"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"), F.get(p, F.lit(8)).alias("color"))


def svg_texts(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, text) of the text nodes of SVG files; attributes stand in any order, and a node may go over several lines."""
    node = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<text\b[^>]*>[^<]*)</text>"), F.lit(1))).alias("node")
    rows = spark.read.text(path, lineSep="</svg>").select(F.concat("value", F.lit("")).alias("value")).select(node)
    at = lambda name: F.regexp_extract("node", rf'\s{name}="([-0-9.]+)"', 1)
    rows = rows.where((at("x") != "") & (at("y") != ""))
    return rows.select(at("x").cast("double").alias("x"), at("y").cast("double").alias("y"), F.regexp_extract("node", r"(?s)>([^<]*)$", 1).alias("text"))


def ensembles(spark: SparkSession, path: str) -> DataFrame:
    """(id, struct_id, db) from Parquet with an array of structures for each id."""
    return spark.read.parquet(path).select("id", F.posexplode("structures").alias("struct_id", "db")).withColumn("struct_id", F.col("struct_id").cast("long"))


def signals(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(id, samples) from Parquet; with sep, ids that are names parted by it also give (run, read): what stands before its last
    place and behind it."""
    rows = spark.read.parquet(path).select("id", "samples")
    if sep is None:
        return rows
    parts = F.split("id", re.escape(sep))
    return rows.withColumn("run", F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep)).withColumn("read", F.element_at(parts, -1))
