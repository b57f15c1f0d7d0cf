"""Queries that write the domain's files with the library's writers, or lines of their form, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.fixtures import EMBEDDING_SQL, L_EMBEDDING, embedding_mods, embedding_reads, table
from strandlake.operators import mixtures
from strandlake.plans import two_sample
from strandlake.queries.matrix import r6
from strandlake.queries.models import K, _EM0, _em, _start
from strandlake.sources import readers, writers
from strandlake.sources.scratch import scratch_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _emb(body: str) -> str:
    return f"WITH {EMBEDDING_SQL}{body}"


def _written(lines: DataFrame, name: str, whole: bool = False) -> str:
    """The path of a new folder with the lines; whole: in one file."""
    path = scratch_path(lines.sparkSession, name)
    writers.write_lines(lines.coalesce(1) if whole else lines, path)
    return path


def _lines(df: DataFrame, *parts, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).alias("value"))


# --- matrices and bit vectors -----------------------------------------------------------------------------------------


@query("file_sizes", "SELECT p_name || p_partkey AS gene, cast(p_size AS BIGINT) AS length FROM part")
def file_sizes(spark, sf):
    part = table(spark, sf, "part")
    return readers.sizes(spark, _written(_lines(part, F.concat("p_name", F.col("p_partkey").cast("string")), "p_size"), "sizes"))


@query("file_matrix", _emb(" SELECT read_id AS row_idx, pos FROM mods"))
def file_matrix(spark, sf):
    """A matrix in MatrixMarket form, written and read."""
    mods = embedding_mods(spark, sf).select(F.col("read_id").alias("row_idx"), "pos")
    rows = mods.agg(F.max("row_idx")).first()[0] or 0
    return readers.matrix_market(spark, _written(writers.matrix_market_lines(mods, rows + 1, L_EMBEDDING), "matrix"), L_EMBEDDING)


@query("file_gene", _emb(" SELECT 'r' || m.read_id AS read_id, pos FROM mods m JOIN reads r ON r.read_id = m.read_id WHERE 40 + m.read_id % 25 >= cast(0.8 * 64 AS DOUBLE)"))
def file_gene(spark, sf):
    """One gene from its matrix, the reads' names and lengths, and the sizes: reads that cover four fifths of it."""
    mods = embedding_mods(spark, sf).select(F.col("read_id").alias("row_idx"), "pos")
    rows = mods.agg(F.max("row_idx")).first()[0] or 0
    matrix = _written(writers.matrix_market_lines(mods, rows + 1, L_EMBEDDING), "matrix")
    reads = embedding_reads(spark, sf)
    ids = _written(_lines(reads, "read_id", F.concat(F.lit("r"), F.col("read_id").cast("string")), 40 + F.col("read_id") % 25, F.lit(0), sep=","), "ids")
    sizes = _written(spark.createDataFrame([("other\t9",), (f"gene\t{L_EMBEDDING}",)], "value string"), "sizes")
    return readers.read_matrix(spark, matrix, ids, "gene", sizes)[1]


@query("file_bit_vectors", _emb(", t AS (SELECT read_id, string_agg(CASE WHEN v > cast(0.15 AS DOUBLE) THEN '1' ELSE '0' END, '' ORDER BY pos) AS bits FROM cells GROUP BY read_id) SELECT read_id || '.1' AS read_id, bits, cast(length(replace(bits, '0', '')) AS DOUBLE) AS n_mut FROM t"))
def file_bit_vectors(spark, sf):
    lines = writers.bit_vector_lines(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING)
    return readers.bit_vectors(spark, _written(lines, "bitvectors"))


@query("file_dense_table", _emb(", t AS (SELECT read_id, string_agg(CASE WHEN v > cast(0.15 AS DOUBLE) THEN '1' ELSE '0' END, '' ORDER BY pos) AS bits FROM cells GROUP BY read_id) SELECT bits, cast(length(replace(bits, '0', '')) AS BIGINT) AS n_mods, cast(count(*) AS BIGINT) AS n FROM t GROUP BY bits"))
def file_dense_table(spark, sf):
    lines = writers.dense_table_lines(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING)
    rows = readers.dense_table(spark, _written(lines, "dense"))
    return rows.groupBy("bits").agg(F.max(F.size("p")).cast("long").alias("n_mods"), F.count("*").alias("n"))


@query("file_mutation_summary", _emb(", c AS (SELECT r.read_id, count(m.pos) AS k FROM reads r LEFT JOIN mods m ON m.read_id = r.read_id GROUP BY r.read_id) SELECT 'n_mut' AS what, cast(k AS BIGINT) AS at, cast(count(*) AS BIGINT) AS n, cast(NULL AS DOUBLE) AS share FROM c GROUP BY k UNION ALL SELECT 'pos', p.pos, cast(count(m.pos) AS BIGINT), round(count(m.pos) / (SELECT count(*) FROM reads), 6) FROM (SELECT cast(unnest(range(0, 64)) AS BIGINT) AS pos) p LEFT JOIN mods m ON m.pos = p.pos GROUP BY p.pos"))
def file_mutation_summary(spark, sf):
    t = writers.mutation_summary(embedding_reads(spark, sf), embedding_mods(spark, sf), L_EMBEDDING)
    path = scratch_path(spark, "summary")
    for name, rows in t.items():
        rows.write.parquet(f"{path}/{name}")
    one = spark.read.parquet(f"{path}/histogram").select(F.lit("n_mut").alias("what"), F.col("n_mut").cast("long").alias("at"), F.col("n_reads").alias("n"), F.lit(None).cast("double").alias("share"))
    return one.unionByName(spark.read.parquet(f"{path}/coverage").select(F.lit("pos").alias("what"), F.col("pos").alias("at"), "n", r6("share")))


# --- sequences and alignments -----------------------------------------------------------------------------------------

_SEQ = "translate(md5({}), '0123456789abcdef', 'ATGCATGCATGCATGC')"


@query("file_fasta", f"SELECT 'c' || c_custkey AS id, {_SEQ.format('c_name')} AS seq FROM customer")
def file_fasta(spark, sf):
    t = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.translate(F.md5("c_name"), "0123456789abcdef", "ATGCATGCATGCATGC").alias("seq"))
    return readers.fasta(spark, _written(writers.fasta_lines(t), "fasta"))


@query("file_phred", "SELECT chr(cast(33 + s AS INT)) AS symbol, s AS score FROM (SELECT cast(unnest(range(0, 42)) AS BIGINT) AS s)")
def file_phred(spark, sf):
    lines = spark.createDataFrame([("Score Symbol",), *[(f"{s} {chr(33 + s)}",) for s in range(42)]], "value string")
    return spark.createDataFrame(sorted(readers.phred(spark, _written(lines, "phred")).items()), "symbol string, score long")


_SAM = """WITH a AS (
  SELECT o_orderkey, m AS mate, 1 + o_orderkey % 50 AS p1, 11 + o_orderkey % 50 AS p2, CASE o_orderkey % 5 WHEN 4 THEN 3 ELSE 0 END AS off,
    CASE WHEN o_orderkey % 7 = 3 THEN 256 ELSE 0 END AS extra
  FROM orders, (SELECT unnest([1, 2]) AS m))"""


def _sam_lines(spark, sf) -> DataFrame:
    """Two mates of each order; every fifth pair disagrees about its places, and every seventh pair is secondary."""
    t = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("m"))
    k, first = F.col("o_orderkey"), F.col("m") == 1
    p1, p2, off = 1 + k % 50, 11 + k % 50, F.when(k % 5 == 4, 3).otherwise(0)
    flag = F.when(first, 99).otherwise(147) + F.when(k % 7 == 3, 256).otherwise(0)
    seq = F.substring(F.translate(F.md5(k.cast("string")), "0123456789abcdef", "ATGCATGCATGCATGC"), 1, 10)
    rows = _lines(
        t, F.concat(F.lit("q"), k.cast("string")), flag, F.lit("ref"), F.when(first, p1).otherwise(p2), F.lit(42), F.lit("10M"), F.lit("="),
        F.when(first, p2 + off).otherwise(p1), F.lit(20), seq, F.lit("IIIIIIIIII"), F.lit("MD:Z:10"),
    )
    return spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:ref\tLN:99",)], "value string").unionByName(rows)


@query("file_sam", _SAM + f" SELECT 'q' || o_orderkey AS qname, cast(CASE mate WHEN 1 THEN 99 ELSE 147 END + extra AS BIGINT) AS flag, 'ref' AS rname, cast(CASE mate WHEN 1 THEN p1 ELSE p2 END AS BIGINT) AS pos, cast(42 AS BIGINT) AS mapq, '10M' AS cigar, substr({_SEQ.format('cast(o_orderkey AS VARCHAR)')}, 1, 10) AS seq, '10' AS md FROM a WHERE extra = 0")
def file_sam(spark, sf):
    return readers.sam(spark, _written(_sam_lines(spark, sf), "sam")).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "md")


@query("file_paired", _SAM + " SELECT 'q' || o_orderkey AS qname, cast(mate AS BIGINT) AS mate, cast(CASE mate WHEN 1 THEN p1 ELSE p2 END AS BIGINT) AS pos FROM a WHERE extra = 0 AND off = 0")
def file_paired(spark, sf):
    """Pairs whose mates name each other's place."""
    pairs = readers.paired(readers.sam(spark, _written(_sam_lines(spark, sf), "sam")))
    return pairs.select("qname", F.col("mate").cast("long").alias("mate"), "pos")


# --- profiles, regions, drawings --------------------------------------------------------------------------------------


@query("file_annotations", "SELECT 'c' || s_nationkey AS chrom, s_suppkey * 10 AS tx_start, s_suppkey * 10 + 3 AS utr5, s_suppkey * 10 + 8 AS utr3, s_suppkey * 10 + 9 AS tx_end FROM supplier")
def file_annotations(spark, sf):
    k = F.col("s_suppkey") * 10
    t = table(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("chrom"), k.alias("tx_start"), (k + 3).alias("utr5"), (k + 8).alias("utr3"), (k + 9).alias("tx_end"))
    path = scratch_path(spark, "annotations")
    t.write.option("sep", "\t").option("header", True).csv(path)
    return readers.annotations(spark, path)


@query("file_coverage", "SELECT l_partkey AS pos, cast(l_quantity AS DOUBLE) AS coverage FROM lineitem UNION ALL SELECT l_suppkey, 1.0::DOUBLE FROM lineitem")
def file_coverage(spark, sf):
    """Two files of modification rates."""
    li = table(spark, sf, "lineitem")
    one, two = _written(_lines(li, "l_partkey", F.lit("x"), "l_quantity"), "rates"), _written(_lines(li, "l_suppkey", F.lit("x"), F.lit(1)), "rates")
    return readers.coverage(spark, [one, two])


@query("file_chimeric", "SELECT 'o' || l_orderkey AS iid, l_partkey AS s1, l_partkey + 20 AS e1, l_suppkey AS s2, l_suppkey + 20 AS e2, cast(l_linenumber AS BIGINT) AS counts FROM lineitem")
def file_chimeric(spark, sf):
    li, x = table(spark, sf, "lineitem"), F.lit("x")
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    count = F.concat(F.lit("a_b_"), F.col("l_linenumber").cast("string"))
    return readers.chimeric(spark, _written(_lines(li, F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), a, a + 20, x, b, b + 20, x, x, x, x, x, x, count), "chimeric"))


@query("file_connect_table", "SELECT p_partkey - 1 AS i, p_partkey + 4 AS j FROM part WHERE p_partkey % 3 <> 0")
def file_connect_table(spark, sf):
    k = F.col("p_partkey")
    rows = _lines(table(spark, sf, "part"), k, F.lit("A"), k - 1, k + 1, F.when(k % 3 == 0, 0).otherwise(k + 5), k, sep=" ")
    return readers.connect_table(spark, _written(spark.createDataFrame([("9 ENERGY = -1.0 x",)], "value string").unionByName(rows), "ct"))


@query("file_shape_values", "SELECT p_partkey AS pos, cast(p_size AS DOUBLE) / 4 AS value FROM part")
def file_shape_values(spark, sf):
    return readers.shape_values(spark, _written(_lines(table(spark, sf, "part"), "p_partkey", F.col("p_size") / 4.0, sep="\t"), "shape"))


@query("file_arcs_bed", "SELECT 'chr' || c_nationkey AS chrom, c_custkey AS \"start\", c_custkey + 7 AS \"end\", c_nationkey || ',0,9' AS color FROM customer")
def file_arcs_bed(spark, sf):
    k, x = F.col("c_custkey"), F.lit(".")
    rows = _lines(table(spark, sf, "customer"), F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")), k, k + 7, x, x, x, x, x, F.concat(F.col("c_nationkey").cast("string"), F.lit(",0,9")))
    return readers.arcs_bed(spark, _written(spark.createDataFrame([("track graphType=arc",)], "value string").unionByName(rows), "bed"))


@query("file_svg_texts", "SELECT cast(n_nationkey AS DOUBLE) / 2 AS x, cast(-n_regionkey AS DOUBLE) AS y, n_name AS text FROM nation")
def file_svg_texts(spark, sf):
    t = table(spark, sf, "nation")
    x, y = (F.col("n_nationkey") / 2.0).cast("string"), (-F.col("n_regionkey")).cast("string")
    one = F.concat(F.lit('<text font-size="9" x="'), x, F.lit('" y="'), y, F.lit('">'), "n_name", F.lit("</text>"))
    two = F.concat(F.lit('<text y="'), y, F.lit('" x="'), x, F.lit('"\n>'), "n_name", F.lit("</text>"))
    rows = t.select(F.when(F.col("n_nationkey") % 2 == 0, one).otherwise(two).alias("value"))
    return readers.svg_texts(spark, _written(rows, "svg", whole=True))


@query("file_signals", "SELECT 'run_' || (user_id % 3) || '_' || user_id AS id, 'run_' || (user_id % 3) AS run, cast(user_id AS VARCHAR) AS read, round(sum(cast(value AS DOUBLE)), 4) AS total, cast(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def file_signals(spark, sf):
    ev = table(spark, sf, "events")
    name = F.concat(F.lit("run_"), (F.col("user_id") % 3).cast("string"), F.lit("_"), F.col("user_id").cast("string"))
    path = scratch_path(spark, "signals")
    ev.groupBy(name.alias("id")).agg(F.collect_list(F.col("value").cast("double")).alias("samples")).write.parquet(path)
    total = F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 4)
    return readers.signals(spark, path, "_").select("id", "run", "read", total.alias("total"), F.size("samples").cast("long").alias("n"))


@query("file_ensembles", "SELECT 'n' || c_nationkey AS id, cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS struct_id, translate(substr(md5(c_name), 1, 9), '0123456789abcdef', '......((((....))') AS db FROM customer")
def file_ensembles(spark, sf):
    db = F.translate(F.substring(F.md5("c_name"), 1, 9), "0123456789abcdef", "......((((....))")
    t = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id"), F.col("c_custkey").alias("struct_id"), db.alias("db"))
    path = scratch_path(spark, "ensembles")
    writers.write_ensembles(t, path)
    return readers.ensembles(spark, path)


# --- results of a mixture ---------------------------------------------------------------------------------------------


@query("file_posteriors", _emb(_EM0 + _em(0) + f", w AS (SELECT read_id, arg_max(cluster, post) AS cluster FROM p0 GROUP BY read_id) SELECT p.read_id || ',' || w.cluster || ',' || string_agg(printf('%.5f', post), ',' ORDER BY p.cluster) AS value FROM p0 p JOIN w ON w.read_id = p.read_id GROUP BY p.read_id, w.cluster"))
def file_posteriors(spark, sf):
    found = two_sample.assignments(embedding_reads(spark, sf), embedding_mods(spark, sf), mixtures.Mixture(*_start(), 0.0, 0.0))
    return spark.read.text(_written(writers.posterior_lines(found, K), "posteriors"))


@query("file_mixture_tables", "SELECT cast(p AS BIGINT) AS pos, cast(k AS BIGINT) AS cluster, round(0.02::DOUBLE + 0.2::DOUBLE * ((p * 31 + k * 17) % 97) / 97, 9) AS mu FROM (SELECT unnest(range(0, 64)) AS p), (SELECT unnest(range(0, 2)) AS k)")
def file_mixture_tables(spark, sf):
    path = scratch_path(spark, "mixture")
    writers.write_mixture(spark, mixtures.Mixture(*_start(), -1.5, 3.0, [(1, -1.5, 0.0)]), path)
    mu = spark.read.parquet(f"{path}/model_mu")
    return mu.select("pos", F.posexplode(F.array(*[f"cluster_{k}" for k in range(K)])).alias("cluster", "mu")).select("pos", F.col("cluster").cast("long").alias("cluster"), F.round("mu", 9).alias("mu"))


@query("file_run_log", "SELECT cast(r AS BIGINT) AS run, cast(2 AS BIGINT) AS clusters, cast(-r * r + 2 * r AS DOUBLE) AS ll, cast(r AS BIGINT) AS iterations, r <> 1 AS converged, r = 1 AS largest FROM (SELECT unnest(range(0, 4)) AS r)")
def file_run_log(spark, sf):
    runs = [mixtures.Mixture(*_start(), float(-r * r + 2 * r), 0.0, [(i, 0.0, 0.0) for i in range(r)], r != 1) for r in range(4)]
    path = scratch_path(spark, "log")
    for name, rows in writers.run_log(spark, runs, {"clusters": 2}).items():
        rows.write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/runs").select("run", "clusters", "ll", "iterations", "converged", "largest")
