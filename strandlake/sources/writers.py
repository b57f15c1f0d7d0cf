"""Writers of the domain's text formats. Each writes a folder of part files that Spark reads back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.mixtures import Mixture


def dense_text(reads: DataFrame, mods: DataFrame, length: int, sep: str = "") -> DataFrame:
    """(read_id, bits, n_mods): every read as text of 0s and 1s."""
    lists = mods.groupBy("read_id").agg(F.collect_set(F.col("pos").cast("int")).alias("p"))
    rows = reads.select("read_id").join(lists, "read_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<int>")))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda x: F.when(F.array_contains("p", x), "1").otherwise("0")), sep)
    return rows.select("read_id", bits.alias("bits"), F.size("p").cast("long").alias("n_mods"))


def bit_vector_lines(reads: DataFrame, mods: DataFrame, length: int, name: str = "ref", sequence: str = "") -> DataFrame:
    """Lines of a bit-vector file: three of a header, then id.1, bits and number of modifications."""
    spark = reads.sparkSession
    head = [f"@ref\t{name};{name}\t{sequence}", f"@coordinates:length\t1,{length}:{length}", "Query_name\tBit_vector\tN_Mutations"]
    rows = dense_text(reads, mods, length).select(F.lit(1).alias("o"), F.format_string("%s.1\t%s\t%d", F.col("read_id").cast("string"), "bits", "n_mods").alias("value"))
    return spark.createDataFrame([(0, h) for h in head], "o int, value string").coalesce(1).unionByName(rows).select("value")


def dense_table_lines(reads: DataFrame, mods: DataFrame, length: int) -> DataFrame:
    """Lines of a dense table: a header of positions, then tab-separated 0s and 1s."""
    head = reads.sparkSession.createDataFrame([("\t".join(map(str, range(length))),)], "value string")
    return head.unionByName(dense_text(reads, mods, length, "\t").select(F.col("bits").alias("value")))


def matrix_market_lines(entries: DataFrame, rows: int, columns: int) -> DataFrame:
    """Lines of a MatrixMarket file from 0-based (row_idx, pos), the dimensions first."""
    spark, n = entries.sparkSession, entries.count()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), (f"{rows} {columns} {n}",)], "value string").coalesce(1)
    return head.unionByName(entries.select(F.format_string("%d %d 1", F.col("row_idx") + 1, F.col("pos") + 1).alias("value")))


def write_ensembles(structs: DataFrame, path: str) -> None:
    """Parquet with an array of structures for each id, in the order of struct_id; structs: (id, struct_id, db)."""
    rows = structs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("struct_id", "db"))).alias("s"))
    rows.select("id", F.transform("s", lambda x: x["db"]).alias("structures")).write.parquet(path)


def mutation_summary(reads: DataFrame, mods: DataFrame, length: int) -> dict[str, DataFrame]:
    """histogram (n_mut, n_reads) and coverage (pos, n, share): how many reads are modified at a position, and their share."""
    n = reads.agg(F.count("*").alias("total"))
    per_read = reads.select("read_id").join(mods.groupBy("read_id").agg(F.count("*").alias("k")), "read_id", "left")
    places = reads.sparkSession.range(length).withColumnRenamed("id", "pos")
    at = places.join(mods.groupBy("pos").agg(F.count("*").alias("n")), "pos", "left").select("pos", F.coalesce("n", F.lit(0)).alias("n"))
    return {
        "histogram": per_read.groupBy(F.coalesce("k", F.lit(0)).alias("n_mut")).agg(F.count("*").alias("n_reads")),
        "coverage": at.join(F.broadcast(n)).select("pos", "n", (F.col("n") / F.col("total")).alias("share")),
    }


def run_log(spark, runs: list[Mixture], parameters: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """runs (run, clusters, ll, bic, iterations, converged, largest) and parameters (name, value) of a fit's restarts; largest
    marks the run of the largest likelihood of its number of clusters."""
    top = {len(m.pi): max(x.ll for x in runs if len(x.pi) == len(m.pi)) for m in runs}
    rows = [(i, len(m.pi), float(m.ll), float(m.bic), len(m.trace), bool(m.converged), m.ll == top[len(m.pi)]) for i, m in enumerate(runs)]
    return {
        "runs": spark.createDataFrame(rows, "run long, clusters long, ll double, bic double, iterations long, converged boolean, largest boolean"),
        "parameters": spark.createDataFrame([(k, str(v)) for k, v in (parameters or {}).items()], "name string, value string"),
    }


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """Lines of a FASTA file from (id, seq)."""
    return sequences.select(F.explode(F.array(F.concat(F.lit(">"), "id"), "seq")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def posterior_lines(posteriors: DataFrame, clusters: int) -> DataFrame:
    """Lines of id, label and posteriors to five places; posteriors: read_id, cluster, post (array)."""
    form = ",".join(["%s", "%d", *["%.5f"] * clusters])
    return posteriors.select(F.format_string(form, F.col("read_id").cast("string"), "cluster", *[F.col("post")[k] for k in range(clusters)]).alias("value"))


def mixture_tables(spark, mixture: Mixture) -> dict[str, DataFrame]:
    """model_mu (pos, one column for each cluster), model_pi (cluster, pi) and model_trace (iter, ll, delta)."""
    k = len(mixture.pi)
    mu = spark.createDataFrame([(p, *map(float, mixture.mu[:, p])) for p in range(mixture.mu.shape[1])], "pos long, " + ", ".join(f"cluster_{c} double" for c in range(k)))
    pi = spark.createDataFrame([(c, float(x)) for c, x in enumerate(mixture.pi)], "cluster long, pi double")
    trace = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in mixture.trace], "iter long, ll double, delta double")
    return {"model_mu": mu, "model_pi": pi, "model_trace": trace}


def write_mixture(spark, mixture: Mixture, path: str) -> None:
    for name, table in mixture_tables(spark, mixture).items():
        table.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"ll": mixture.ll, "bic": mixture.bic, "converged": mixture.converged}),)], "value string").write.text(f"{path}/summary")
