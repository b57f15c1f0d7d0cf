"""Positions stay in the rows of structures and reads: results against brute force, and what goes through a shuffle."""

import random

from pyspark.sql import functions as F

from strandlake.operators import bitvec, structure, windows


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def nearest(structs):
    """centroids_of() by the definition; structs: (cluster, struct_id, db)."""
    single = {".": 1, ",": 1} | dict.fromkeys("(){}[]|", 0)
    rows = [(c, s, [single[x] for x in db]) for c, s, db in structs if db and c is not None and all(x in single for x in db)]
    out = {}
    for c, s, v in rows:
        near = [w for d, _, w in rows if d == c]
        mean = [sum(w[p] for w in near if len(w) > p) / sum(len(w) > p for w in near) for p in range(len(v))]
        out.setdefault(c, []).append((round(sum((x - m) ** 2 for x, m in zip(v, mean)), 9), s))
    return {(c, *min(found)[::-1]) for c, found in out.items()}


def test_centroids(spark):
    """Copies tie and the smaller id wins; structures differ in length; empty, null and other texts have no vector; some have no cluster."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), k, "".join(rng.choice("..,(){}[]|") for _ in range(rng.choice([0, 5, 9])))) for k in range(80)]
    rows += [("a", 100, None), ("a", 101, "..X.."), ("c", 103, "(.)"), ("c", 102, "(.)"), ("d", 104, "é"), ("e", 105, "")]
    members = spark.createDataFrame(rows, "cluster string, struct_id long, db string")
    wanted = nearest([(c, s, db) for c, s, db in rows if db is not None])
    assert {tuple(r) for r in structure.centroids_of(members).collect()} == wanted
    assert {tuple(r) for r in structure.centroids(members.select("struct_id", "cluster"), members.select("struct_id", "db")).collect()} == wanted
    assert structure.centroids_of(members.where("cluster IS NULL")).count() == 0


def test_centroids_make_no_rows_of_positions(spark):
    structs = spark.range(200).select(F.col("id").alias("struct_id"), F.lit("((...))").alias("db"))
    made = structure.centroids(structs.select("struct_id", (F.col("struct_id") % 3).alias("cluster")), structs)
    assert "Generate" not in plan(made)


REF = "ACGTACGTTTGACCAGATTA"
QUALITY = {chr(33 + q): q for q in range(42)}


def alignments(spark, rows):
    full = [(name, mate, pos, cigar, seq, qual or "I" * len(seq or ""), REF) for name, mate, pos, cigar, seq, qual in rows]
    return spark.createDataFrame(full, "qname string, mate long, pos long, cigar string, seq string, qual string, ref string")


def test_bits_of_alignments(spark):
    """Clips, insertions, deletions that could and couldn't stand elsewhere, low quality, the reference's end, other operations, none."""
    t = alignments(
        spark,
        [
            ("a", 1, 3, "2S3M1I2M3S", "NNGTCTACNNN", None),  # 3 matches, one base inserted, 2 matches, a clip at the end
            ("b", 1, 1, "4M2D3M", "ACGTGTT", "II!IIII"),
            ("c", 2, 7, "2M1D2M", "GTTG", None),  # any of three Ts
            ("d", 1, 18, "5M", "TCAGG", None),
            ("e", 1, 1, "2M3N2M", "ACGT", None),
            ("f", 1, 1, "*", None, None),
            ("g", 2, 1, None, "AC", None),
            ("h", 1, None, "2M", "AC", None),
        ],
    )
    got = {r["qname"]: (r["mate"], r["at"], r["bits"]) for r in bitvec.mate_bits(t, QUALITY).collect()}
    assert got == {"a": (1, 2, "00CAC..."), "b": (1, 0, "00?0?1000"), "c": (2, 6, "00?00"), "d": (1, 17, "0C0")}
    assert {(r["qname"], r["ref_at"], r["bit"]) for r in bitvec.read_bits(t, QUALITY).collect()} == {(q, at + k, b) for q, (_, at, bits) in got.items() for k, b in enumerate(bits)}
    steps = sorted(tuple(r) for r in bitvec.cigar_steps(t).where("qname IN ('a', 'e')").select("qname", "idx", "len", "op", "read_at", "ref_at").collect())
    assert steps == [("a", 0, 2, "S", 0, 2), ("a", 1, 3, "M", 2, 2), ("a", 2, 1, "I", 5, 5), ("a", 3, 2, "M", 6, 5), ("a", 4, 3, "S", 8, 7), ("e", 0, 2, "M", 0, 0), ("e", 1, 3, "N", 2, 2), ("e", 2, 2, "M", 2, 5)]
    assert [r["ref_at"] for r in bitvec.cigar_steps(t).where("qname = 'h'").collect()] == [None]


def test_mates_as_text(spark):
    """Mates that overlap, are apart or alone; texts cut at both ends; every pair of bits by the rules."""
    marks = "01ATGC?.N"
    schema = "qname string, at long, bits string"
    first = [("near", 2, "0A1?"), ("far", 1, "0G"), ("one", 4, "T"), ("out", 12, "00"), *((x + y, 5, x) for x in marks for y in marks)]
    second = [("near", 4, "GC0"), ("far", 8, "C0"), ("two", 0, "1A"), *((x + y, 5, y) for x in marks for y in marks)]

    def rule(x, y):
        if x == y or y == "?":
            return x
        if "0" in (x, y):
            return "0"
        return y if x == "?" else "?" if x in "ATGC" and y in "ATGC" else x

    together = bitvec.paired_bits(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema))
    wanted = {"near": (2, "0A1C0"), "far": (1, "0G     C0"), "one": (4, "T"), "out": (12, "00"), "two": (0, "1A")}
    wanted |= {x + y: (5, rule(x, y) if "0" not in (x, y) else "0") for x in marks for y in marks}
    assert {r["qname"]: (r["at"], r["bits"]) for r in together.collect()} == wanted
    assert {(r["qname"], r["ref_at"]): r["bit"] for r in bitvec.combined_mates(together).collect()} == {(q, at + k): b for q, (at, bits) in wanted.items() for k, b in enumerate(bits) if b != " "}
    line = lambda at, bits: "".join(bits[p - at] if at <= p < at + len(bits) and bits[p - at] != " " else "." for p in range(1, 9))
    shown = {q: line(at, bits) for q, (at, bits) in wanted.items() if any(b != " " and 1 <= at + k < 9 for k, b in enumerate(bits))}
    got = {r["qname"]: (r["bits"], r["n_mut"]) for r in bitvec.bit_text(together, 1, 9).collect()}
    assert got == {q: (s, sum(c in "ATGC" for c in s)) for q, s in shown.items()} and "out" not in got


def test_bits_are_shuffled_as_texts(spark):
    """One shuffle of each mate's alignments, and no row of a base."""
    t = alignments(spark, [("a", 1, 1, "4M", "ACGT", None), ("a", 2, 2, "4M", "CGTA", None)])
    made = plan(bitvec.bit_text(bitvec.mates_together(t, QUALITY), 0, len(REF)))
    assert "Window" not in made and "Generate" not in made
    assert "Window" not in plan(bitvec.cigar_steps(t))


def test_islands(spark):
    """Repeated and missing sites, runs of one, negative ones, and groups that are missing; a plan without tables of sites or runs."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-30, 30)) for _ in range(120)] + [("a", None), ("a", None), ("c", None), ("d", 7)]
    wanted = set()
    for g in {g for g, _ in rows}:
        sites = {p for q, p in rows if q == g and p is not None}
        for first in (p for p in sites if p - 1 not in sites):
            last = next(p for p in range(first, 99) if p + 1 not in sites)
            wanted.add((g, first, last, last - first + 1))
    wanted |= {("a", None, None, 1), ("c", None, None, 1)}
    made = windows.islands(spark.createDataFrame(rows, "g string, pos int"), by=("g",))
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert dict(made.dtypes) == {"g": "string", "first": "int", "last": "int", "n": "bigint"}
    shown = plan(made)
    assert "Aggregate" not in shown and shown.split("Initial Plan")[-1].count("Exchange") == 1 == shown.split("Initial Plan")[-1].count("Sort ")
    alone = windows.islands(spark.createDataFrame([(3,), (1,), (2,), (2,), (9,)], "at long"), "at")
    assert sorted(tuple(r) for r in alone.collect()) == [(1, 3, 3), (9, 9, 1)]


def test_reads_of_texts(spark):
    """Letters of either case among others, pieces of a length, texts without bases; bits against references that are longer, shorter or
    missing."""
    rng = random.Random(7)
    texts = ["", None, "xyz é", "acgt", "AéC\nGt" * 5] + ["".join(rng.choice("ACGTacgtnN é-") for _ in range(rng.randrange(60))) for _ in range(30)]
    wanted = set()
    for k, t in enumerate(texts):
        bases = "".join(c for c in t or "" if c in "ACGTacgt").upper()
        wanted |= {(k, p, bases[8 * p : 8 * p + 8], len(bases[8 * p : 8 * p + 8])) for p in range(-(-len(bases) // 8))}
    made = bitvec.cut(spark.createDataFrame(list(enumerate(texts)), "id long, all string"), 8)
    assert {tuple(r) for r in made.collect()} == wanted and made.count() == len(wanted)
    rows = [(0, "ACGT", "ACCTA"), (1, "ACGTAA", "AC"), (2, "GG", None), (3, None, "ACG"), (4, "", "")]
    got = {r["id"]: (r["bits"], r["n_mut"]) for r in bitvec.against(spark.createDataFrame(rows, "id long, seq string, ref string")).collect()}
    assert {0: ("00G0.", 1), 1: ("00GTAA", 4), 3: ("...", 0)}.items() <= got.items() and got[2] == ("GG", 2) and got[4] == ("", 0)


def test_positions_are_counted_where_they_are_read(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), k % 2, "".join(rng.choice("01ATGC?.Né") for _ in range(rng.randrange(7)))) for k in range(90)] + [("x", 0, None)]
    vectors = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "g string, h long, bits string, read_id long")
    counts = {}
    for g, h, bits in rows:
        for p, c in enumerate(bits or ""):
            counts[g, h, p, c] = counts.get((g, h, p, c), 0) + 1
    made = bitvec.tallies(vectors, ("g", "h"))
    assert {tuple(r)[:4]: r["n"] for r in made.collect()} == counts and "Generate" not in plan(made)
    total = lambda which: sum(n for (*_, p, c), n in counts.items() if p == 3 and which(c))
    averages = bitvec.population_average(vectors)
    row = averages.where("pos = 3").first()
    assert tuple(row) == (3, total(lambda c: c != "."), informative := total(lambda c: c not in ".?N"), mismatches := total(lambda c: c in "ATGC"), mismatches / informative)
    assert "Generate" not in plan(averages) and "Generate" not in plan(bitvec.base_counts(vectors))
