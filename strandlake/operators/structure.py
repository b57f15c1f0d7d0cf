"""Structures in dot-bracket notation: vectors, pairs, arcs and contact maps; and text parsers that go with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import bitvec


def structure_bits(db: Column, single: bool = True) -> Column:
    """0/1 text: with single, 1 where a base is unpaired ('.' or ','), else the inverse; null if another character occurs."""
    out = F.translate(db, ".,(){}[]|", "110000000" if single else "001111111")
    return F.when(F.translate(db, ".,(){}[]|", "") == "", out)


def matched(db: str | None) -> list[tuple[int, int]]:
    """The pairs of ( and ) of one structure, by their first place; none if it is unbalanced."""
    stack: list[int] = []
    pairs: list[tuple[int, int]] = []
    for at, c in enumerate(db or ""):
        if c == "(":
            stack.append(at)
        elif c == ")":
            if not stack:
                return []
            pairs.append((stack.pop(), at))
    return [] if stack else sorted(pairs)


def base_pairs(structs: DataFrame, keep: tuple[str, ...] = ("struct_id",)) -> DataFrame:
    """(struct_id, i, j): the pairs of ( and ), 0-based, i < j, with the columns to keep; unbalanced structures have none. Each
    structure is read where it is, with a stack: nothing is shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in structs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matched(db) for db in batch.column("db").to_pylist()]
            owner = [k for k, pairs in enumerate(found) for _ in pairs]
            i, j = ([p[x] for pairs in found for p in pairs] for x in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner, pa.int64())) for c in keep), pa.array(i, pa.int64()), pa.array(j, pa.int64())], [*keep, "i", "j"])

    return structs.select(*keep, "db").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "i long", "j long"]))


def pair_probabilities(structs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, p): the share of an ensemble's structures that have a pair; unbalanced structures count and have none.
    A structure's pairs keep the columns `by`, so they are counted where they are read."""
    sizes = structs.groupBy(*by).agg(F.count("*").alias("_n"))
    pairs = base_pairs(structs, by).groupBy(*by, "i", "j").agg(F.count("*").alias("_k"))
    both = pairs.join(F.broadcast(sizes), list(by)) if by else pairs.join(F.broadcast(sizes))
    return both.select(*by, "i", "j", (F.col("_k") / F.col("_n")).alias("p"))


def ensemble_centroids(structs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, db): the structure of the pairs that more than half of an ensemble's structures have, which never cross or share a base;
    as long as the longest of them."""
    likely = pair_probabilities(structs, by).where("p > 0.5").groupBy(*by).agg(F.collect_list("i").alias("_i"), F.collect_list("j").alias("_j"))
    length = structs.groupBy(*by).agg(F.max(F.length("db")).alias("_l"))
    both = length.join(likely, list(by), "left") if by else length.join(F.broadcast(likely), how="left")
    sign = lambda x: F.when(F.array_contains("_i", x), "(").when(F.array_contains("_j", x), ")").otherwise(".")
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_l").cast("long") - 1), sign), "")
    return both.select(*by, F.when(F.col("_l") > 0, text).otherwise("").alias("db"))


def structure_offsets(structs: DataFrame) -> DataFrame:
    """(cluster, n, first, last): where each cluster's structures stand when ensembles (cluster, struct_id) are put one after the
    other in the order of the clusters; clusters are few."""
    sizes = structs.groupBy("cluster").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("cluster").alias("_c"), F.col("n").alias("_n"))
    first = sizes.join(F.broadcast(before), F.col("_c") < F.col("cluster"), "left").groupBy("cluster", "n").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("first"))
    return first.withColumn("last", F.col("first") + F.col("n"))


def balanced(structs: DataFrame) -> DataFrame:
    """structs with is_balanced."""
    depth = F.aggregate(
        F.split("db", ""),
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda acc, c: F.struct(
            (acc["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (acc["ok"] & ~((c == ")") & (acc["d"] == 0))).alias("ok")
        ),
        lambda acc: acc["ok"] & (acc["d"] == 0),
    )
    return structs.withColumn("is_balanced", depth)


def arc_heights(pairs: DataFrame) -> DataFrame:
    """pairs with center, width and height of the arc that draws them."""
    width = F.abs(F.col("j") - F.col("i"))
    return pairs.withColumn("center", (F.col("i") + F.col("j")) / 2.0).withColumn("width", width).withColumn("height", width.cast("double"))


def contact_map(pairs: DataFrame, resolution: int, display: str = "full") -> DataFrame:
    """(bin_i, bin_j, n): pairs by bins of positions; display full (both halves), upper or lower."""
    upper = pairs.select(F.floor(F.col("i") / resolution).alias("bin_i"), F.floor(F.col("j") / resolution).alias("bin_j"))
    lower = upper.select(F.col("bin_j").alias("bin_i"), F.col("bin_i").alias("bin_j"))
    rows = {"upper": upper, "lower": lower, "full": upper.unionByName(lower)}[display]
    return rows.groupBy("bin_i", "bin_j").agg(F.count("*").alias("n"))


def unpaired_rates(structs: DataFrame) -> DataFrame:
    """(pos, n, unpaired): over all structures, the share of those in which a position is unpaired."""
    at = structs.select(F.posexplode(F.split("db", "")).alias("pos", "c")).where("c <> ''")
    return at.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("c").isin(".", ","), 1.0).otherwise(0.0)).alias("unpaired"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb, each part held within 0 and 255."""
    return F.format_string("#%02x%02x%02x", *[F.greatest(F.lit(0), F.least(F.lit(255), x.cast("int"))) for x in (r, g, b)])


def shape_color_ramp(value: Column) -> Column:
    """A reactivity's CSS colour: white without a value (under -998), grey below 0, and from light to full red at 4."""
    pale = ((F.lit(4.0) - value) / 4.0 * 90).cast("int")
    return (
        F.when(value < -998, "rgb(100%, 100%, 100%)")
        .when(value < 0, "rgb(90%, 90%, 90%)")
        .when(value > 4, "rgb(90%, 0%, 0%)")
        .otherwise(F.format_string("rgb(90%%, %d%%, %d%%)", pale, pale))
    )


def shape_color_bins(value: Column) -> Column:
    """A reactivity's CSS colour in three classes, bounded at 0.35 and 0.85; white without a value."""
    return F.when(value < -998, "rgb(100%, 100%, 100%)").when(value < 0.35, "rgb(80%, 80%, 80%)").when(value < 0.85, "rgb(90%, 49%, 13%)").otherwise("rgb(90%, 30%, 23%)")


def centroids(assignments: DataFrame, structs: DataFrame) -> DataFrame:
    """centroids_of() structures (struct_id, db) whose clusters are in a table of their own (struct_id, cluster)."""
    return centroids_of(structs.select("struct_id", "db").join(assignments.select("struct_id", "cluster"), "struct_id"))


#: By a character's code: 1 where a base is unpaired, 0 where it is paired, 2 for what structures don't have.
_KINDS = np.array([1 if chr(c) in ".," else 0 if chr(c) in "(){}[]|" else 2 for c in range(129)])


def unpaired(db: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which texts structure_bits() has a vector of that isn't empty, and of their bases the text's number, the position and whether it
    is unpaired."""
    codes, owner, at = bitvec.characters(db)
    kind = _KINDS[np.minimum(codes, 128)]
    valid = np.zeros(len(db), bool)
    valid[owner] = True
    valid[owner[kind == 2]] = False
    shown = valid[owner]
    return valid, owner[shown], at[shown], kind[shown] == 1


def centroids_of(members: DataFrame) -> DataFrame:
    """(cluster, struct_id, distance): the structure (cluster, struct_id, db) nearest to its cluster's mean vector, by squared distance,
    ties by id. Positions stay in the structure's row; clusters x positions means come to the driver."""
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in bitvec.slices(batch, "db"):
                clusters = b.column("cluster").dictionary_encode(null_encoding="encode")
                _, owner, at, one = unpaired(b.column("db"))
                width = int(at.max(initial=0)) + 1
                cell = clusters.indices.to_numpy()[owner].astype(np.int64) * width + at
                n, k = np.bincount(cell), np.bincount(cell, one).astype(np.int64)  # no more cells than a slice has characters
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([clusters.dictionary.take(pa.array(cell // width)), pa.array(cell % width), pa.array(n[cell]), pa.array(k[cell])], ["cluster", "pos", "n", "k"])

    # not filtered here: a filter would go before the making of db and have it made twice
    counts = members.select("cluster", "db").mapInArrow(count, f"cluster {kinds['cluster']}, pos long, n long, k long")
    found = counts.where("cluster IS NOT NULL").groupBy("cluster", "pos").agg((F.sum("k") / F.sum("n")).alias("mean")).toArrow()
    names = pc.unique(found["cluster"])
    mean = np.zeros((len(names), (pc.max(found["pos"]).as_py() or 0) + 1))
    mean[pc.index_in(found["cluster"], names).to_numpy(), found["pos"].to_numpy()] = found["mean"].to_numpy()
    base = np.pad(np.cumsum(mean**2, axis=1), ((0, 0), (1, 0)))  # the distance of a vector of zeros, by its length

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("cluster")))
            for b in bitvec.slices(batch, "db"):
                valid, owner, at, one = unpaired(b.column("db"))
                rows = np.flatnonzero(valid)
                cluster = pc.fill_null(pc.index_in(b.column("cluster"), names), 0).to_numpy()
                length = np.bincount(owner, minlength=b.num_rows)
                far = np.bincount(owner[one], 1 - 2 * mean[cluster[owner[one]], at[one]], b.num_rows)[rows] + base[cluster[rows], length[rows]]
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column("cluster"), kept.column("struct_id"), pa.array(far)], ["cluster", "struct_id", "distance"])

    far = members.select("cluster", "struct_id", "db").mapInArrow(measure, f"cluster {kinds['cluster']}, struct_id {kinds['struct_id']}, distance double")
    far = far.groupBy("cluster", "struct_id").agg(F.round(F.sum("distance"), 9).alias("distance"))
    return far.groupBy("cluster").agg(F.min(F.struct("distance", "struct_id")).alias("m")).select("cluster", "m.struct_id", "m.distance")
