"""SimHash near-dedup over an inverted index of positional bytes, with count filtering.

Two 64-bit fingerprints with at most 3 differing bits differ in at most 3 of their 8 bytes, so they share at least 5 positional
bytes, the guaranteed minimum. Posting lists of single bytes would each hold 1/256 of all fingerprints, and their pairs would
grow with the square of the corpus. The index therefore keys on sets of four positional bytes: the 14 four-sets of positions that
XOR to zero are a Steiner system S(3,4,8), so whichever three bytes differ, one of the 14 sets avoids them. A posting list then
needs 32 equal bits. Of each pair that meets in a list the shared positional bytes are tallied, pairs that reach the minimum are
retained, and those are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Likeness, bucket_links
from .common import map_arrow, materialize, texts
from .components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
_ALL = (1 << 64) - 1
#: Sets of byte positions that XOR to zero.
BYTE_SETS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(sum(255 << (8 * p) for p in s)) for s in BYTE_SETS]


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Unsigned SimHash of a text's k-word shingles; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[starts[i] : ends[min(i + k, len(words)) - 1] - 1], seed) for i in range(n)), ">u8", n)
    ones = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, seed: int = HASH_SEED, tid: bool = False) -> DataFrame:
    """(doc_id, fp): one row for each row of df; fp is the fingerprint's 64 bits as a signed long; with tid, also the text's
    xxhash64 under that name, which tells apart rows of one doc_id."""

    more = ["tid"] if tid else []

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, k, seed) for t in texts(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *map(batch.column, more)], ["doc_id", "fp", *more])

        return step

    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.xxhash64(text_col).alias("tid")] * tid)
    return map_arrow(read, make, "doc_id long, fp long" + ", tid long" * tid)


def shared_bytes(diff: int) -> int:
    """How many of the eight positional bytes are equal in fingerprints with these differing bits."""
    return diff.to_bytes(8).count(0)


def postings(fps: DataFrame) -> DataFrame:
    """The inverted index, (k: posting list, fp, n: rows with it): each distinct fingerprint stands in 14 lists. Lists whose hashes
    coincide become one, which costs comparisons and no links."""
    counted = fps.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"))
    keyed = counted.select("fp", "n", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in MASKS])).alias("k", "octets"))
    return keyed.select(F.xxhash64("k", "octets").alias("k"), "fp", "n")


def candidates(fps: DataFrame) -> DataFrame:
    """(a, b, shared): pairs a < b of distinct fingerprints that meet in a posting list, each once, with the tally of the positional
    bytes they share. All pairs: for looking at the index; near_duplicates() makes spanning links instead."""
    x, y = postings(fps).alias("x"), postings(fps).alias("y")
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.fp") < F.col("y.fp"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    diff = F.col("a").bitwiseXOR(F.col("b"))
    return pairs.withColumn("shared", sum(F.when(diff.bitwiseAND(F.lit(_signed(255 << (8 * p)))) == 0, 1).otherwise(0) for p in range(8)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): all pairs of distinct values of column fp, a < b, that differ in 1 to max_bits (3 at most) bits, each once."""
    _checked(max_bits)
    kept = candidates(fps).where(F.col("shared") >= 8 - max_bits)
    return kept.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def _checked(max_bits: int) -> None:
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the byte sets are complete for 3 bits at most")


def likeness(max_bits: int) -> Likeness:
    """Fingerprints that pass the count of shared positional bytes and then the Hamming distance."""

    def within(bits: int, least: int) -> Callable[[int, int], bool]:
        return lambda x, y: shared_bytes(diff := (x ^ y) & _ALL) >= least and diff.bit_count() <= bits

    return Likeness(lambda fp: fp, within(max_bits, 8 - max_bits), within(2 * max_bits, 8 - 2 * max_bits))


def spanning(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links of at most max_bits bits that connect all that any such links connect, without all pairs of a posting list."""
    _checked(max_bits)
    lists = postings(fps)
    sizes = lists.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    met, _ = materialize(lists.join(sizes, "k").select("k", "size", "n", F.col("fp").alias("h"), F.col("fp").alias("body")), "postings")
    return bucket_links(met, likeness(max_bits)).distinct()


def near_duplicates(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Add component_id to (doc_id, fp): the smallest doc_id reachable over links of at most max_bits bits.

    Rows of one fingerprint stand as one node, their smallest doc_id, so a group of copies costs one row in the index.
    Null doc_ids are never the smallest; a fingerprint that only null ids carry gets component_id null. Repeated rows are
    kept, each with the same component. Empty input: no rows. fps is read several times: pass a written table.
    """
    heads = fps.groupBy("fp").agg(F.min("doc_id").alias("head"))
    known = heads.where("head is not null")
    pairs = spanning(fps.where("doc_id is not null"), max_bits)
    a, b = known.select(F.col("fp").alias("a"), F.col("head").alias("ha")), known.select(F.col("fp").alias("b"), F.col("head").alias("hb"))
    edges = pairs.join(a, "a").join(b, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    found = components(edges)
    labels = heads.join(found, heads["head"] == found["node"], "left").select("fp", F.coalesce("component", "head").alias("component_id"))
    return fps.join(labels, "fp")
