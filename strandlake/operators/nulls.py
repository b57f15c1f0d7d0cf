"""Null libraries: reads that keep the margins of a library but not the dependence between positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.scratch import scratch_path


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts' text."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


def _traded(rows: DataFrame, turn: int) -> DataFrame:
    """One round: in each bucket reads are paired at random, and each pair deals the positions that only one of them has anew.

    Each read of an odd rank looks at the one after it and gives both reads' rows, so a round reads its input once. Rows stay in their
    buckets, so only the sort is made anew.
    """
    order = F.md5(F.concat_ws("|", F.col("seed"), F.col("read_id"), F.lit(turn)))
    w = Window.partitionBy("_g", "seed", "_b").orderBy(order, "read_id")
    pair = rows.select("_g", "seed", "_b", "read_id", "p", (F.row_number().over(w) % 2).alias("_odd"), F.lead("read_id").over(w).alias("rb"), F.lead("p").over(w).alias("pb")).where("_odd = 1")
    pb = F.coalesce("pb", F.array().cast(rows.schema["p"].dataType))
    both = F.array_intersect("p", pb)
    free = F.concat(F.array_except("p", pb), F.array_except(pb, "p"))
    keyed = F.transform(free, lambda x: F.struct(F.md5(F.concat_ws("|", F.col("seed"), F.col("read_id"), F.lit(turn), x.cast("string"))).alias("k"), x.alias("x")))
    mixed = F.transform(F.array_sort(keyed), lambda s: s["x"])
    pair = pair.withColumn("both", both).withColumn("mixed", mixed).withColumn("na", F.size("p") - F.size("both"))
    first = F.struct(F.col("read_id"), F.concat("both", F.slice("mixed", 1, F.col("na"))).alias("p"))
    second = F.struct(F.col("rb").alias("read_id"), F.concat("both", F.slice("mixed", F.col("na") + 1, F.size("mixed") - F.col("na"))).alias("p"))
    return pair.select("_g", "seed", "_b", F.inline(F.array(first, second))).where("read_id is not null")


#: Rounds of MD5: constants, bits to turn, and the word of the message.
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Texts that are hashed at a time, so that they stay in a core's cache.
HASHED = 8192


def _md5(words: np.ndarray) -> np.ndarray:
    """The first 16 hexadecimal digits of the MD5 of messages of one block, as numbers; words: 16 x messages."""
    start = [np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f += a
        f += words[_WORDS[i]]
        f += _SINES[i]
        turn = _TURNS[i // 16, i % 4]
        a, b, c, d = d, b + ((f << turn) | (f >> (np.uint32(32) - turn))), b, c
    return ((a + start[0]).byteswap().astype(np.uint64) << np.uint64(32)) | (b + start[1]).byteswap()


def _keys(seed: int, names: np.ndarray, tails: list[bytes], which: np.ndarray) -> np.ndarray:
    """The first 16 hexadecimal digits of the MD5 of "seed|name" and the tail of number `which`, as numbers; names: bytes."""
    head, tail, wide = f"{seed}|".encode(), np.array([t + b"\x80" for t in tails]), names.dtype.itemsize
    at, size = len(head), np.char.str_len(names)
    if at + wide + tail.dtype.itemsize > 56:
        return np.array([int.from_bytes(hashlib.md5(head + n + tails[k]).digest()[:8]) for n, k in zip(names.tolist(), which.tolist())], np.uint64)
    length, name, tail = at + size + np.char.str_len(tail)[which] - 1, names.view(np.uint8).reshape(-1, wide), tail.view(np.uint8).reshape(len(tail), -1)
    out = np.empty(len(names), np.uint64)
    for first in range(0, len(names), HASHED):
        some = slice(first, first + HASHED)
        block = np.zeros((len(names[some]), 64), np.uint8)
        block[:, :at], block[:, at : at + wide] = np.frombuffer(head, np.uint8), name[some]
        for n in np.unique(size[some]).tolist():
            rows = np.flatnonzero(size[some] == n)
            block[rows, at + n : at + n + tail.shape[1]] = tail[which[some][rows]]
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = 8 * length[some]
        out[some] = _md5(words)
    return out


def _sorted(group: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The order by group, key and tie, from one number for group and the key's first bits where these tell all rows apart."""
    bits = np.uint64(max(1, int(group.max(initial=0)).bit_length()))
    code = (group.astype(np.uint64) << (np.uint64(64) - bits)) | (key >> bits)
    order = np.argsort(code)
    return np.lexsort((tie, key, group)) if (code[order][1:] == code[order][:-1]).any() else order


def _trades(seed: int, ids: np.ndarray, names: np.ndarray, bucket: np.ndarray, row: np.ndarray, pos: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """row and pos of the modifications of whole buckets of reads after the rounds of _traded(); names: the ids as bytes."""
    bits = int(pos.max(initial=0)).bit_length() + 1
    for turn in range(rounds):
        key = _keys(seed, names, [f"|{turn}".encode()], np.zeros(len(names), np.intp))
        order = _sorted(bucket, key, ids)
        begins = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        odd = (np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))) % 2
        number = np.cumsum(odd == 0) - 1
        pair, side, reads = np.empty_like(order), np.empty_like(order), np.zeros((number[-1] + 1, 2), np.intp)
        pair[order], side[order], reads[number, odd] = number, odd, order
        code = np.sort((pair[row] << bits) | (pos << 1) | side[row])
        both = np.concatenate([code[1:] >> 1 == code[:-1] >> 1, [False]])
        both[1:] |= both[:-1]
        free, code = code[~both], code[both]
        own, at, mine = free >> bits, (free & ((1 << bits) - 1)) >> 1, free & 1
        tails = [f"|{turn}|{x}".encode() for x in range(int(at.max(initial=0)) + 1)]
        mixed = _sorted(own, _keys(seed, names[reads[own, 0]], tails, at), at)
        # own is in order already, so its places are those of the mixed ones
        rank = np.arange(len(own)) - (np.cumsum(n := np.bincount(own, minlength=len(reads))) - n)[own]
        to = (rank >= np.bincount(own, mine == 0, len(reads))[own]).astype(np.intp)
        row = np.concatenate([reads[own, to], reads[code >> bits, code & 1]])
        pos = np.concatenate([at[mixed], (code & ((1 << bits) - 1)) >> 1])
    return row, pos


def _together(row: np.ndarray, pos: np.ndarray, length: int, window: int) -> np.ndarray:
    """length x length counts of reads with positions i <= j, j - i < window."""
    code = np.sort(row * length + pos)
    row, pos = code // length, code % length
    counts, k = np.bincount(pos * (length + 1), minlength=length * length), 1
    while (near := np.flatnonzero(row[k:] == row[:-k])).size:
        i, j = pos[near], pos[near + k]
        near = j - i < window
        counts += np.bincount(i[near] * length + j[near], minlength=length * length)
        k += 1
    return counts.reshape(length, length)


#: Rows of a task's share of a null library, one for each read and seed.
LIBRARY_ROWS = 100_000


def shuffled_reads(mods: DataFrame, seeds: list[int], rounds: int = 4, bucket_rows: int = 5000, share_rows: int = LIBRARY_ROWS) -> DataFrame:
    """(seed, read_id, p): shuffled_library() with a row for each read that has a modification, p being its positions.

    For each seed reads are dealt at random into buckets of about bucket_rows, and in every round they are paired anew within their
    bucket, so the library is shuffled once, whatever the number of rounds. A share of about share_rows holds buckets of one seed;
    there are as many partitions as shares, so a task's share doesn't grow with the library.
    """
    lists = mods.groupBy("read_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("p"))
    n_reads = lists.count()
    buckets, groups = max(1, n_reads // bucket_rows), max(1, n_reads // share_rows)
    rows = lists.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    order = F.md5(F.concat_ws("|", F.col("seed"), F.col("read_id"), F.lit(0)))
    rows = rows.withColumn("_b", F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("_g", F.concat_ws("|", F.col("seed"), F.col("_b") % groups)) if rounds else rows
    if groups > 1:
        rows = rows.repartition(groups * len(seeds), "_g")
    for turn in range(rounds):
        rows = _traded(rows, turn)
    return rows.select("seed", "read_id", "p")


def position_lists(mods: DataFrame) -> DataFrame:
    """(read_id, p): the positions of each read in order, written once."""
    lists = mods.groupBy("read_id").agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("p"))
    path = scratch_path(mods.sparkSession, "lists")
    lists.write.parquet(path)
    return mods.sparkSession.read.schema(lists.schema).parquet(path)


def shuffled_cooccurrence(lists: DataFrame, seeds: list[int], length: int, window: int, rounds: int = 4, bucket_rows: int = 5000, share_rows: int = LIBRARY_ROWS) -> DataFrame:
    """(seed, i, j, n11): reads with both positions i <= j, j - i < window, in the null libraries that shuffled_reads() makes of
    position_lists().

    The reads trade in the same buckets by the same hashes, but all rounds of a share are made where its reads have come by the one
    shuffle, in arrays, and only counts leave it.
    """
    n_reads = lists.count()
    buckets, groups = max(1, n_reads // bucket_rows), max(1, n_reads // share_rows)
    rows = lists.select("read_id", "p", F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("_s", "seed"))
    order = F.md5(F.concat_ws("|", F.col("seed"), F.col("read_id"), F.lit(0)))
    bucket = F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    rows = rows.select("read_id", "p", "_s", bucket.alias("_b")).select((F.col("_s") * groups + F.col("_b") % groups).cast("int").alias("_g"), "_b", "read_id", "p")

    def run(share: pa.Table) -> pa.Table:
        seed, ids = seeds[share.column("_g")[0].as_py() // groups], share.column("read_id")
        names = np.array([x.encode() for x in ids.cast(pa.string()).to_pylist()])
        p = share.column("p").combine_chunks()
        row = np.repeat(np.arange(len(p)), np.asarray(p.value_lengths()))
        ids = ids.to_numpy() if pa.types.is_integer(ids.type) else names
        row, pos = _trades(seed, ids, names, share.column("_b").to_numpy(), row, np.asarray(p.flatten()).astype(np.intp), rounds)
        counts = _together(row, pos, length, window)
        i, j = np.nonzero(counts)
        return pa.table({"seed": pa.array(np.full(len(i), seed, np.int32)), "i": i, "j": j, "n11": counts[i, j]})

    made = rows.repartition(groups * len(seeds), "_g").groupBy("_g").applyInArrow(run, "seed int, i long, j long, n11 long")
    return made.groupBy("seed", "i", "j").agg(F.sum("n11").alias("n11"))


def shuffled_library(mods: DataFrame, seeds: list[int], rounds: int = 4, bucket_rows: int = 5000) -> DataFrame:
    """(seed, read_id, pos): for each seed a library with the same number of modifications in every read and at every position.

    Pairs of reads trade positions that only one of them has, which keeps both margins; all pairs of a round, and all seeds,
    trade at the same time, so no task holds a library.
    """
    return shuffled_reads(mods, seeds, rounds, bucket_rows).select("seed", "read_id", F.explode(F.col("p").cast("array<long>")).alias("pos"))


def _reads_of_counts(histogram: DataFrame, p: np.ndarray, seed: int) -> DataFrame:
    """independent_reads() without a limit."""
    spark, length = histogram.sparkSession, len(p)
    quotas = sorted((r["n_mods"], r["n_reads"]) for r in histogram.where("n_mods > 0 and n_reads > 0").collect())
    top = max((k for k, _ in quotas), default=0)
    with np.errstate(divide="ignore"):
        on, off = np.log(p), np.log1p(-p)
    # tail[i, m]: log-probability of m modifications from position i on
    tail = np.full((length + 1, top + 1), -np.inf)
    tail[length, 0] = 0.0
    for i in range(length - 1, -1, -1):
        tail[i] = off[i] + tail[i + 1]
        tail[i, 1:] = np.logaddexp(tail[i, 1:], on[i] + tail[i + 1, :-1])
    if barred := [k for k, _ in quotas if np.isneginf(tail[0, k])]:
        raise ValueError(f"the rates allow no read with {barred} modifications")
    counts, ends = np.array([k for k, _ in quotas], int), np.cumsum([n for _, n in quotas], dtype=np.int64)
    total = int(ends[-1]) if quotas else 0
    shared = spark.sparkContext.broadcast((on, tail, counts, ends))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on, tail, counts, ends = shared.value
        for f in frames:
            for block in f["id"]:
                ids = np.arange(int(block) * 1000, min(int(block) * 1000 + 1000, total))
                left = counts[np.searchsorted(ends, ids, "right")]
                u = np.random.default_rng([seed, int(block)]).random((length, len(ids)))
                hit = np.zeros((length, len(ids)), bool)
                for i in range(length):
                    some = left > 0
                    hit[i, some] = u[i, some] < np.exp(on[i] + tail[i + 1, left[some] - 1] - tail[i, left[some]])
                    left = left - hit[i]
                at, pos = np.nonzero(hit.T)
                yield pd.DataFrame({"read_id": ids[at], "pos": pos.astype(np.int64)})

    return spark.range(-(-total // 1000)).mapInPandas(draw, "read_id long, pos long")


def independent_reads(rates: DataFrame, histogram: DataFrame, length: int, limit: int | None = None, seed: int = 386) -> DataFrame:
    """(read_id, pos): reads drawn position by position from the rates, of each number of modifications as many as the quota
    in the histogram (n_mods, n_reads). Empty reads have no rows.

    Each read is drawn given its number of modifications, so every quota is filled; one that the rates rule out is an error.
    With a limit (rejection), so many reads are drawn whatever their number, and the first ones up to the quotas stay; quotas()
    tells which ones were not filled.
    rates: (pos, rate), one row for each position; they are broadcast, as is a table of positions x numbers of modifications.
    """
    spark = rates.sparkSession
    p = np.zeros(length)
    for r in rates.collect():
        p[r["pos"]] = r["rate"] or 0.0
    if limit is None:
        return _reads_of_counts(histogram, p, seed)
    shared = spark.sparkContext.broadcast(p)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in f["id"]:
                hit = np.random.default_rng([seed, int(block)]).random((1000, length)) < shared.value
                ids = int(block) * 1000 + np.arange(1000)
                yield pd.DataFrame({"read_id": ids, "n_mods": hit.sum(1).astype(np.int64), "p": [np.flatnonzero(h).astype(np.int64) for h in hit]})

    drawn = spark.range(-(-limit // 1000)).mapInPandas(draw, "read_id long, n_mods long, p array<long>").where(F.col("read_id") < limit)
    ranked = drawn.join(F.broadcast(histogram), "n_mods").withColumn("_n", F.row_number().over(Window.partitionBy("n_mods").orderBy("read_id")))
    return ranked.where(F.col("_n") <= F.col("n_reads")).select("read_id", F.explode("p").alias("pos"))


def quotas(histogram: DataFrame, made: DataFrame) -> DataFrame:
    """(n_mods, quota, n): of each number of modifications the reads asked for and the reads in made (read_id, pos)."""
    counts = made.groupBy("read_id").agg(F.count("*").alias("n_mods")).groupBy("n_mods").agg(F.count("*").alias("n"))
    asked = histogram.where("n_mods > 0").select("n_mods", F.col("n_reads").alias("quota"))
    return asked.join(counts, "n_mods", "left").select("n_mods", "quota", F.coalesce("n", F.lit(0)).alias("n"))


def margin_fit(real: DataFrame, simulated: DataFrame, key: str) -> DataFrame:
    """(r2): how well a margin (key, n) of the simulated library follows the real one."""
    t = real.select(key, F.col("n").alias("y")).join(simulated.select(key, F.col("n").alias("x")), key, "left").withColumn("x", F.coalesce("x", F.lit(0)))
    mean = t.agg(F.avg("y").alias("m"))
    return t.join(F.broadcast(mean)).agg((1 - F.sum(F.pow(F.col("y") - F.col("x"), 2)) / F.sum(F.pow(F.col("y") - F.col("m"), 2))).alias("r2"))
