"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts become sequences of lower-case words, and each word of the items a character of its own, so that an item, or a document, is
a short string. Windows of 13 item words count, and each of them holds an anchor: six item words, chosen so that every eight
places in a row of an item have one, the one that fewest items share. The automaton holds the anchors (and whole items of fewer
than 13 words), and with each the words that stand within a window's reach of it, seven before and seven behind, once for all
places that have the same; where a document has an anchor, its words there are compared with these, and an equal run of 13 words
or more is a hit. What a document has around an anchor is looked at once for all its places alike, so repeats cost nothing. A
document is scanned once, and word positions map back to character spans of the original text.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts

WINDOW_WORDS = 13
ANCHOR_WORDS = 6
#: Bytes of item texts in one automaton, about ten times as many in a worker's memory; more items go to further passes.
ITEM_BYTES = 16 << 20
_words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_fold = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters a-z and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_fold).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character bounds, in the original text, of the words of words_of."""
    return [m.span() for m in _words.finditer(text)]


@dataclass
class Index:
    """codes: a character for each word of the items, or two where these are too many; items: of each distinct item the ids that have
    it; patterns: of each anchor what stands before and behind it, with the items that have this, and the item that it is the whole
    of, or -1."""

    codes: dict[bytes, str]
    items: list[list[str]]
    patterns: dict[str, tuple[dict[tuple[str, str], list[int]], int]]
    size: int
    unit: int


#: Words that characters other than 0 and surrogates can stand for.
MOST_CODES = 0x110000 - 0x801
_LOW = 30_000


def _coded(ids: np.ndarray, unit: int) -> str:
    """Words as characters. First and second ones of two are different characters, so pairs are never found out of step."""
    if unit == 1:
        return np.where(ids < 0xD7FF, ids + 1, ids + 0x801).astype("<u4").tobytes().decode("utf-32-le")
    return np.stack([ids // _LOW + 1, ids % _LOW + 0x4001], -1).astype("<u4").tobytes().decode("utf-32-le")


def anchors(lengths: list[int], rarity: np.ndarray, size: int, width: int) -> list[list[int]]:
    """Places of each item's anchors: each `size` words in a row hold one. rarity: how often the `width` words from a place on stand
    in all items, for all places of all items."""
    out, base = [], 0
    for n in lengths:
        own, at = [], -1
        while at < n - size:
            low, high = at + 1, min(at + 1 + size - width, n - width)
            near = rarity[base + low : base + high + 1]
            at = low + len(near) - 1 - int(near[::-1].argmin())  # the rarest, of equals the farthest
            own.append(at)
        out.append(own)
        base += n
    return out


def build(items: list[tuple[str, str | None]], size: int = WINDOW_WORDS, most_codes: int = MOST_CODES) -> Index:
    """The index of items (id, text); ids of equal texts are kept together, null and wordless texts left out."""
    width = min(ANCHOR_WORDS, size)
    numbers: dict[bytes, int] = {}
    by_text: dict[bytes, dict[str, None]] = {}
    for item, text in items:
        line = np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], "<u4").tobytes()
        if line:
            by_text.setdefault(line, {})[item] = None
    unit = 1 if len(numbers) <= most_codes else 2
    found = [(np.frombuffer(line, "<u4").astype(np.int64), list(own)) for line, own in sorted(by_text.items())]
    patterns: dict[str, tuple[dict[tuple[str, str], list[int]], int]] = {}
    long = [(i, ids) for i, (ids, _) in enumerate(found) if len(ids) >= size]
    for i, (ids, _) in enumerate(found):
        if len(ids) < size:
            patterns.setdefault(_coded(ids, unit), ({}, i))
    if long:
        flat = np.concatenate([ids for _, ids in long]).astype(np.uint64) + np.uint64(1)
        grams = np.zeros(len(flat), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                grams[: len(flat) - width + 1] = grams[: len(flat) - width + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - width + 1 + k]
        _, kind, count = np.unique(grams, return_inverse=True, return_counts=True)
        reach = unit * (size - width)
        for (i, ids), places in zip(long, anchors([len(x) for _, x in long], count[kind], size, width)):
            line = _coded(ids, unit)
            for at in places:
                first, last = unit * at, unit * (at + width)
                where, whole = patterns.get(key := line[first:last], ({}, -1))
                own = where.setdefault((line[max(0, first - reach) : first], line[last : last + reach]), [])
                if not own or own[-1] != i:
                    own.append(i)
                patterns[key] = (where, whole)
    codes = dict(zip(numbers, map("".join, zip(*[iter(_coded(np.arange(len(numbers)), unit))] * unit)))) if numbers else {}
    return Index(codes, [own for _, own in found], patterns, size, unit)


def _alike(x: str, y: str) -> int:
    """How many characters two strings begin with alike."""
    n = min(len(x), len(y))
    return next((k for k in range(n) if x[k] != y[k]), n)


class Scanner:
    def __init__(self, index: Index):
        self.index, self.made = index, ahocorasick.Automaton()
        for p, (where, whole) in index.patterns.items():
            # what stands before an anchor is read backwards
            self.made.add_word(p, (p, [(left[::-1], right, own) for (left, right), own in where.items()], whole))
        if index.patterns:
            self.made.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of a text that stand in windows of items, and these items' ids."""
        index, spans, owners = self.index, [], set()
        if not index.patterns or not words:
            return spans, owners
        unit = index.unit
        line = "".join(map(index.codes.get, words, repeat("\0" * unit)))
        reach = unit * (index.size - min(ANCHOR_WORDS, index.size))
        seen: dict[tuple[str, str, str], tuple[int, int] | None] = {}
        for end, (pattern, where, whole) in self.made.iter(line):
            last = end + 1
            first = last - len(pattern)
            if whole >= 0:
                spans.append((first // unit, last // unit))
                if whole not in seen:
                    seen[whole] = None
                    owners.update(index.items[whole])
            if where:
                around = (line[max(0, first - reach) : first], pattern, line[last : last + reach])
                if around not in seen:
                    seen[around] = self._around(around, where, owners)
                if (span := seen[around]) is not None:
                    spans.append((first // unit - span[0], last // unit + span[1]))
        return spans, owners

    def _around(self, around: tuple[str, str, str], where: list[tuple[str, str, list[int]]], owners: set[str]) -> tuple[int, int] | None:
        """How many words before and behind an anchor stand in windows of items, by what the text has there."""
        before, pattern, behind = around[0][::-1], around[1], around[2]
        unit, size, a, b = self.index.unit, self.index.size, -1, -1
        for left, right, own in where:
            x, y = _alike(before, left) // unit, _alike(behind, right) // unit
            if x + len(pattern) // unit + y >= size:
                a, b = max(a, x), max(b, y)
                for i in own:
                    owners.update(self.index.items[i])
        return None if a < 0 else (a, b)


_scanners: dict[str, Scanner] = {}


def _scanner(key: str, index: Index) -> Scanner:
    """The scanner of a broadcast index; a worker holds one at a time."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(index)
    return _scanners[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_PAIR = "array<struct<a:int,b:int>>"
_ADDED = {"n_words": "long", "hits": _PAIR, "hit_items": "array<string>", "spans": _PAIR}


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """docs with the columns n_words, hits (array of [a, b) word positions), hit_items (ids as strings, sorted) and spans
    (array of [a, b) character positions in the original text), which replace columns of these names.

    Null and empty texts have no words, so no hits; null or wordless items have no windows; an item without an id is "null".
    No items: no hits. Repeated documents and items are all kept (an item id is listed once). The items' texts are counted first: up
    to item_bytes they make one automaton, and documents are scanned in one pass. More items are dealt out by their hashes; each
    part is a pass over the documents that keeps only what it hits, by the texts' hashes, and texts are never written.
    """
    spark = docs.sparkSession
    rows = docs.drop(*_ADDED)
    schema = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _ADDED.items()]).schema
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    index = lambda some: spark.sparkContext.broadcast(build([tuple(r) for r in some.collect()], size))  # noqa: E731  item_bytes or so
    if parts == 1:
        return map_arrow(rows, _adding(index(chosen), uuid.uuid4().hex, text_col), schema)
    one, two = F.xxhash64(text_col).alias("_h1"), F.xxhash64(F.lit(7), text_col).alias("_h2")
    found = None
    for part in range(parts):
        shared = index(chosen.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part))
        hit = map_arrow(rows.select(one, two, F.col(text_col).alias("text")), _finding(shared, uuid.uuid4().hex), f"h1 long, h2 long, found {_PAIR}, who array<string>")
        hit, _ = materialize(hit.groupBy("h1", "h2").agg(F.any_value("found").alias("found"), F.any_value("who").alias("who")), "hits")
        found = hit if found is None else found.unionByName(hit)
    every = found.groupBy("h1", "h2").agg(F.flatten(F.collect_list("found")).alias("_found"), F.flatten(F.collect_list("who")).alias("_who"))
    joined = rows.join(every, (one == F.col("h1")) & (two == F.col("h2")), "left").drop("h1", "h2")
    return map_arrow(joined, _merging(text_col), schema)


def judged(scanned: DataFrame) -> DataFrame:
    """Add n_hit (words inside any occurrence of a window) and contaminated (one word in 20 or more is hit)."""
    n_hit = F.expr("cast(aggregate(hits, 0, (n, x) -> n + x.b - x.a) as long)")
    return scanned.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _completed(batch: pa.RecordBatch, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """The columns `names` of the batch, and n_words, hits, hit_items and spans from rows of text, words, word spans, ids."""
    count, hits, found, chars = [], [], [], []
    for text, words, spans, owners in rows:
        spans = _merged(spans)
        at = word_spans(text) if spans else ()
        count.append(len(words))
        hits.append([{"a": a, "b": b} for a, b in spans])
        found.append(sorted(owners))
        chars.append([{"a": at[a][0], "b": at[b - 1][1]} for a, b in spans])
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    new = [pa.array(count, pa.int64()), pa.array(hits, pair), pa.array(found, pa.list_(pa.string())), pa.array(chars, pair)]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], [*names, *_ADDED])


def _adding(shared, key: str, text_col: str):
    def make():
        scanner = _scanner(key, shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [words_of(t) for t in texts(batch, text_col)]
            return _completed(batch, batch.schema.names, [(t, w, *scanner.hits(w)) for t, w in zip(texts(batch, text_col), words)])

        return step

    return make


def _finding(shared, key: str):
    def make():
        scanner = _scanner(key, shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hits = [scanner.hits(words_of(t)) for t in texts(batch)]
            spans = pa.array([[{"a": a, "b": b} for a, b in s] for s, _ in hits], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            who = pa.array([sorted(x) for _, x in hits], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([batch.column("_h1"), batch.column("_h2"), spans, who], ["h1", "h2", "found", "who"]).filter(pa.array([bool(s) for s, _ in hits]))

        return step

    return make


def _merging(text_col: str):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(texts(batch, text_col), batch.column("_found").to_pylist(), batch.column("_who").to_pylist())
            names = [c for c in batch.schema.names if c not in ("_found", "_who")]
            return _completed(batch, names, [(t, words_of(t), [(x["a"], x["b"]) for x in f or ()], set(who or ())) for t, f, who in rows])

        return step

    return make
