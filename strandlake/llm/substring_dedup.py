"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are the lines of a text; each is also cut into pieces at places chosen by the hashes of nearby words alone, so that a
passage falls into the same pieces wherever it stands, whatever its case, sentences or line. Words are runs without white space,
in lower case.

Equal pieces: each piece that stands in several documents belongs to the one with the smallest doc_id. Where a run of pieces
belongs to another document, the words around it are compared with those around the owner's run, over changed words too, as long
as the whole stretch keeps a Jaccard similarity of 0.8 with the owner's.

Near paragraphs: distinct lines are banded by MinHash, lines that collide in a band are verified by the exact Jaccard similarity
of their 5-word shingles, linked lines make components, and a component belongs to its document with the smallest doc_id.

What belongs to other documents goes where it makes a passage of RUN_WORDS words or more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Likeness, bucket_links
from .common import fresh, likely_in, map_arrow, materialize, release, split_likely, texts
from .components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 5, 2  # 1 - (1 - 0.8 ** 2) ** 5 = 0.994 of the pairs at the threshold collide
#: Of lines with fewer shingles than this no two distinct ones reach SIMILARITY: n of n + 1 shingles is the closest they get.
NEAR_SHINGLES = math.ceil(SIMILARITY / (1 - SIMILARITY) - 1e-9)
NEAR_WORDS = NEAR_SHINGLES + SHINGLE_WORDS - 1
#: A line of fewer words doesn't begin a piece after another such line.
PIECE_WORDS = 5
#: A cut has the least hash of two words among so many places on either side.
CUT_RADIUS = 5
#: Words of a passage that goes. Passages of over 50 words are meant; a change near an end may take a fifth of their words off.
RUN_WORDS = 40
#: A word that stands over and over gives no least hashes; it is cut every so many times.
SAME_WORDS = 16
#: Runs of fewer words aren't compared further; of others, so many words on either side are.
ANCHOR_WORDS = 6
CONTEXT_WORDS = 48
#: Longest insertion or deletion that a stretch goes over.
MOST_SKIPPED = 8
#: Bytes of text that are hashed at once.
SLICE = 1 << 18

_solid = re.compile(r"\S+")
_odd_gap = re.compile(r"[^\S \t\n\v\f\r]")
_gap = re.compile(rb"[ \t\n\v\f\r]")
_U = np.uint64
_is_space = np.zeros(256, bool)
_is_space[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240501)
_octet = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_mix = _rng.integers(1, 2**63, (BANDS * ROWS + SHINGLE_WORDS + 8, 2), dtype=np.uint64) | _U(1)
_places = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _place(n: int, which: int = 0) -> np.ndarray:
    """Factors of n places; `which`: one of two independent sets."""
    if len(_places[which]) < n:
        _places[which] = _scramble(np.arange(max(n, 1024), dtype=np.uint64) * _mix[-1 - which, 0] + _mix[-1 - which, 1]) | _U(1)
    return _places[which][:n]


def _summed(values: np.ndarray, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each stretch of values that begins at starts and ends at the next one."""
    sizes = np.diff(starts, append=len(values))
    at = np.arange(len(values)) - np.repeat(starts, sizes)
    return _scramble(np.add.reduceat(values * _place(int(sizes.max()), which)[at], starts) + sizes.astype(np.uint64))


def _word_table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds and hashes of all words."""
    parts, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE and (m := _gap.search(raw, at + SLICE)):
            end = m.end()
        octets = np.frombuffer(raw, np.uint8, end - at, at)
        space = _is_space[octets]
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        if len(edges):
            starts, ends = edges[::2], edges[1::2]
            sizes = ends - starts
            parts.append((starts + at, ends + at, _summed(_octet[octets[~space]], np.cumsum(sizes) - sizes)))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values, done = np.minimum(values[:-step], values[step:]), done + step
    return values


class Units:
    """The words, lines and pieces of some texts. Positions count the words of all texts.

    hashes: of words; docs: first words of the texts, ended by the number of words; lines: first words of the lines with a word;
    pieces: first words of the pieces.
    """

    def __init__(self, rows: list[str | None]):
        raws = [_odd_gap.sub(" ", t or "").lower().encode("utf-8", "surrogatepass") for t in rows]
        self.raw = b"\n".join(raws)
        with np.errstate(over="ignore"):
            self.starts, self.ends, self.hashes = _word_table(self.raw)
            n = len(self.hashes)
            offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
            self.docs = np.searchsorted(self.starts, offsets)
            breaks = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)
            at = np.unique(np.concatenate([[0], np.searchsorted(self.starts, breaks)]))
            self.lines = at[at < n]

    @cached_property
    def pieces(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._cuts(len(self.hashes)) if len(self.hashes) else self.lines

    def _cuts(self, n: int) -> np.ndarray:
        sizes = np.diff(self.lines, append=n)
        long = sizes >= PIECE_WORDS
        heads = self.lines[long | np.r_[True, long[:-1]] | np.isin(self.lines, self.docs)]
        r = CUT_RADIUS
        if n < 2 * r + 2:
            return heads
        pair = _scramble(self.hashes[:-1] * _mix[0, 0] + self.hashes[1:] * _mix[1, 0])
        near = _least(pair, r)
        at = np.arange(r, len(pair) - r)
        chosen = at[(pair[at] < near[at - r]) & (pair[at] < near[at + 1])]
        line = np.searchsorted(self.lines, chosen, "right") - 1
        inside = (chosen - r >= self.lines[line]) & (chosen + r + 1 < self.lines[line] + sizes[line])
        cuts = np.union1d(heads, chosen[inside])
        same = np.concatenate([[False], self.hashes[1:] == self.hashes[:-1]])
        same[self.lines] = False
        at = np.arange(n)
        times = at - np.maximum.accumulate(np.where(same, 0, at))
        if times.max() < SAME_WORDS:
            return cuts
        # a run of one word begins a piece, and another one every SAME_WORDS times
        far = times >= SAME_WORDS
        return np.union1d(cuts, np.concatenate([at[far] - times[far], at[far & (times % SAME_WORDS == 0)]]))

    def ids(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of each stretch between starts: a long and an int."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        with np.errstate(over="ignore"):
            first, second = _summed(self.hashes, starts), _summed(self.hashes, starts, 1)
        return first.view(np.int64), (second >> _U(32)).astype(np.uint32).view(np.int32)

    def text(self, first: int, last: int) -> str:
        """The words from first to last, parted by one space."""
        return b" ".join(self.raw[self.starts[first] : self.ends[last - 1]].split()).decode("utf-8", "surrogatepass") if last > first else ""


def paragraphs(text: str) -> tuple[list[str], list[int]]:
    """A text's words, and the word positions where pieces begin, ended by the number of words."""
    u = Units([text])
    n = len(u.hashes)
    return u.text(0, n).split(" ") if n else [], [*u.pieces.tolist(), n] if n else []


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def band_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each paragraph [start, end) of word hashes, BANDS keys; each has SHINGLE_WORDS words at least."""
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(hashes) - SHINGLE_WORDS + 1, np.uint64)
        for j in range(SHINGLE_WORDS):
            mixed += (hashes[j : len(mixed) + j] ^ (hashes[j : len(mixed) + j] >> _U(29))) * _mix[j, 0]
        mixed ^= mixed >> _U(32)
        n = ends - starts - SHINGLE_WORDS + 1
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        own = mixed[np.arange(int(n.sum())) - np.repeat(at, n) + np.repeat(starts, n)]
        least = []
        for k in range(BANDS * ROWS):
            a, b = _mix[SHINGLE_WORDS + k]
            v = own * a + b
            v ^= v >> _U(31)
            least.append(np.minimum.reduceat(v, at))
        keys = []
        for k in range(BANDS):
            key = np.full(len(starts), k, np.uint64)
            for v in least[k * ROWS : (k + 1) * ROWS]:
                key = (key ^ v) * _U(0x9E3779B97F4A7C15)
                key ^= key >> _U(29)
            keys.append(key.view(np.int64))
    return np.stack(keys, axis=1)


def _groups(rows: list[str | None]) -> Iterator[slice]:
    """Slices of rows with about SLICE characters each."""
    at = size = 0
    for i, t in enumerate(rows):
        size += len(t or "")
        if size >= SLICE:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(rows):
        yield slice(at, len(rows))


def _rows(docs: DataFrame, make_rows, more: list[str]) -> DataFrame:
    """(doc_id, tid, at, h, g) and long columns `more`: one row for each of the stretches that make_rows(units) gives as first and
    last words, and further columns. at: first and last word in the text, as one long (words_of_place); h and g: 96 bits of hash."""
    names = ["doc_id", "tid", "at", "h", "g", *more]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, parts = texts(batch), []
            for s in _groups(rows):
                u = Units(rows[s])
                first, last, h, g, *others = make_rows(u)
                doc = np.searchsorted(u.docs, first, "right") - 1
                at = (first - u.docs[doc]) << 32 | (last - u.docs[doc])
                who = pa.array(doc + s.start)
                parts.append([batch.column("doc_id").take(who), batch.column("tid").take(who), *map(pa.array, (at, h, g, *others))])
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts)], names)

        return step

    kinds = ["int" if n == "g" else "long" for n in names]
    return map_arrow(docs.select("doc_id", "tid", "text"), make, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def pieces_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, at, h, g): the pieces of each text. Hashing is cheap enough to be done for each pass, so nothing is written."""
    return _rows(docs, lambda u: (u.pieces, np.append(u.pieces, len(u.hashes))[1:], *u.ids(u.pieces)), [])


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, at, h, g, k0, k1, ...): the lines of NEAR_WORDS words or more, and their band keys."""

    def made(u: Units) -> tuple:
        ends = np.append(u.lines, len(u.hashes))[1:]
        long = ends - u.lines >= NEAR_WORDS
        keys = band_keys(u.hashes, u.lines[long], ends[long]) if long.any() else np.zeros((0, BANDS), np.int64)
        h, g = u.ids(u.lines)
        return u.lines[long], ends[long], h[long], g[long], *keys.T

    return _rows(docs, made, [f"k{k}" for k in range(BANDS)])


def words_of_place(df: DataFrame) -> DataFrame:
    """df with first and last (int) for at."""
    return df.withColumn("first", F.shiftright("at", 32).cast("int")).withColumn("last", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).drop("at")


def _alike(a: set, b: set, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large - 1e-9:
        return False
    both = len(a & b)
    return both >= least * (small + large - both) - 1e-9


#: The Jaccard distance is a metric: within 1 - SIMILARITY of a third line, two are within twice that of one another.
LIKENESS = Likeness(lambda body: shingles(body.split(" ")), lambda x, y: _alike(x, y, SIMILARITY), lambda x, y: _alike(x, y, 2 * SIMILARITY - 1))


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, body): the text of each wanted line; wanted: (h, doc_id), a document that has it."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_set("h").alias("hs"))  # lines of one document

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[int, str] = {}
            rows, asked = texts(batch), batch.column("hs").to_pylist()
            for s in _groups(rows):
                u = Units(rows[s])
                h, ends = u.ids(u.lines)[0].tolist(), np.append(u.lines, len(u.hashes))[1:].tolist()
                want = set().union(*asked[s])
                found |= {x: u.text(a, b) for x, a, b in zip(h, u.lines.tolist(), ends) if x in want}
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.string())], ["h", "body"])

        return step

    some = likely_in(docs.select("doc_id", "text"), wanted, "doc_id")
    return map_arrow(some.hint("merge").join(by_doc, "doc_id"), make, "h long, body string").dropDuplicates(["h"])


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, g, owner): lines that are similar to others, with the smallest doc_id of their component; lines: lines_of(docs)."""
    spark, keys = docs.sparkSession, [f"k{k}" for k in range(BANDS)]
    distinct, path = materialize(
        lines.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in keys]), "lines"
    )
    banded = distinct.select("h", "g", "n", "owner", F.explode(F.array(*keys)).alias("k"))
    sizes, counted = materialize(banded.groupBy("k").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met, at = materialize(banded.join(sizes, "k"), "met")
    bodies, told = materialize(_bodies(docs, met.select("h", F.col("owner").alias("doc_id")).distinct()), "bodies")
    links, held = materialize(bucket_links(met.join(bodies, "h").select("k", "size", "n", "h", "body"), LIKENESS).distinct(), "links")
    release(spark, counted, told)
    groups = components(links).withColumnRenamed("node", "h")
    ids = met.select("h", "g").distinct()
    near, kept = materialize(groups.join(ids, "h").join(distinct.select("h", "g", "owner", "other"), ["h", "g"]), "groups")
    spans = near.groupBy("component").agg(F.min("owner").alias("owner"), F.max("other").alias("other")).where("owner < other")
    out, _ = materialize(near.select("h", "g", "component").join(spans, "component").select("h", "g", "owner"), "near")
    release(spark, path, at, held, kept)
    return out


def _follow(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Ends of the equal runs of a and b, from their beginnings, over changes of at most MOST_SKIPPED words on either side."""
    ends: list[tuple[int, int]] = []
    i = j = 0
    while True:
        n = next((k for k, (x, y) in enumerate(zip(a[i:], b[j:])) if x != y), min(len(a) - i, len(b) - j))
        i, j = i + n, j + n
        if n:
            ends.append((i, j))
        grams: dict[tuple, int] = {}
        for k in range(min(MOST_SKIPPED, len(b) - j - SHINGLE_WORDS), -1, -1):
            grams[tuple(b[j + k : j + k + SHINGLE_WORDS])] = k
        skips = [(k + m, k, m) for k in range(min(MOST_SKIPPED, len(a) - i - SHINGLE_WORDS) + 1) if (m := grams.get(tuple(a[i + k : i + k + SHINGLE_WORDS]))) is not None]
        if not skips:
            return ends
        _, k, m = min(skips)
        i, j = i + k, j + m


def reach(a: list[str], b: list[str], anchor: list[str], both: int, either: int) -> tuple[int, int, int]:
    """How many words of a the stretch goes on for while it stays similar to that over b, and its shared and all shingles.

    anchor: the equal words before a and b, SHINGLE_WORDS - 1 at most; both, either: shingles counted so far.
    """
    for i, j in reversed(_follow(a, b)):
        x = [*anchor, *a[:i]]
        if i == j and a[:i] == b[:j]:
            n = max(len(x) - SHINGLE_WORDS + 1, 0)
            return i, both + n, either + n
        x, y = shingles(x), shingles([*anchor, *b[:j]])
        same = len(x & y)
        now = both + same, either + len(x) + len(y) - same
        if now[0] >= SIMILARITY * now[1] - 1e-9:
            return i, *now
    return 0, both, either


def stretches(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, tid, first, last, owner): runs of pieces that an owner keeps, with the words around them that are alike there.

    gone: (doc_id, tid, first, last, owner, h), pieces that others keep. A run is compared where its owner first has it in the same
    length. Of both texts only the words around the runs are shuffled.
    """
    per_doc = gone.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set(F.struct("first", "last", "owner", "h"))).alias("p"))  # of one text
    names = ["first", "last", "owner", "ha", "hb"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    tail = SHINGLE_WORDS - 1

    def chains(p: list[dict]) -> Iterator[tuple]:
        run: list = []
        for x in [*p, None]:
            if run and (x is None or x["first"] != run[1] or x["owner"] != run[2]):
                if run[1] - run[0] >= ANCHOR_WORDS:
                    yield tuple(run)
                run = []
            if x is not None:
                run = [run[0], x["last"], run[2], run[3], x["h"]] if run else [x["first"], x["last"], x["owner"], x["h"], x["h"]]

    def find():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(d, t, *c) for d, t, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tid", "p"))) for c in chains(p)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), pa.int64(), *kinds])], ["doc_id", "tid", *names])

        return step

    runs, _ = materialize(map_arrow(per_doc, find, "doc_id long, tid long, first int, last int, owner long, ha long, hb long"), "runs")
    theirs = runs.select(F.col("owner").alias("doc_id"), F.lit(None).cast("long").alias("tid"), F.lit(0).alias("first"), F.expr("last - first").alias("last"), "owner", "ha", "hb").distinct()
    asked = runs.unionByName(theirs).groupBy("doc_id").agg(F.collect_list(F.struct("tid", *names)).alias("asked"))

    def around(u: Units, doc: int, first: int, last: int) -> tuple[str, str]:
        """The words before and after [first, last), each with the first or last words of the run."""
        least, most = u.docs[doc], u.docs[doc + 1]
        return u.text(max(least, first - CONTEXT_WORDS), min(first + tail, last)), u.text(max(first, last - tail), min(most, last + CONTEXT_WORDS))

    def look():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            rows, ids, tids, wanted = texts(batch), *(batch.column(c).to_pylist() for c in ("doc_id", "tid", "asked"))
            for s in _groups(rows):
                u = Units(rows[s])
                h = u.ids(u.pieces)[0].tolist()
                ends = np.append(u.pieces, len(u.hashes))[1:].tolist()
                cuts = u.pieces.tolist()
                bounds = np.searchsorted(u.pieces, u.docs).tolist()
                for doc, at in enumerate(range(s.start, s.stop)):
                    base = int(u.docs[doc])
                    heads: dict[int, list[int]] = {}
                    tails: dict[int, set[int]] = {}
                    for p in range(bounds[doc], bounds[doc + 1]):
                        heads.setdefault(h[p], []).append(cuts[p])
                        tails.setdefault(h[p], set()).add(ends[p])
                    for g in wanted[at]:
                        if g["tid"] is None:
                            n, stop = g["last"], tails.get(g["hb"], ())
                            if (a := next((a for a in heads.get(g["ha"], ()) if a + n in stop), None)) is not None:
                                out.append((None, None, 0, n, g["owner"], g["ha"], g["hb"], *around(u, doc, a, a + n)))
                        elif g["tid"] == tids[at]:
                            out.append((ids[at], g["tid"], *(g[c] for c in names), *around(u, doc, base + g["first"], base + g["last"])))
            types = [pa.int64(), pa.int64(), *kinds, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], ["doc_id", "tid", *names, "before", "after"])

        return step

    schema = "doc_id long, tid long, first int, last int, owner long, ha long, hb long, before string, after string"
    seen, _ = materialize(map_arrow(likely_in(docs, asked, "doc_id").hint("merge").join(asked, "doc_id"), look, schema), "contexts")
    mine = seen.where("tid is not null").withColumn("n", F.expr("last - first"))
    kept = seen.where("tid is null").select("owner", "ha", "hb", F.col("last").alias("n"), F.col("before").alias("before2"), F.col("after").alias("after2"))

    def compare():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            firsts, lasts = [], []
            for first, last, *around in zip(*(batch.column(c).to_pylist() for c in ("first", "last", "before", "after", "before2", "after2"))):
                b, a, b2, a2 = (x.split(" ") if x else [] for x in around)
                k = min(tail, last - first)
                n = max(last - first - tail, 0)
                after, both, either = reach(a[k:], a2[k:], a[:k], n, n)
                b.reverse()
                b2.reverse()
                before, _, _ = reach(b[k:], b2[k:], b[:k], both, either)
                firsts.append(first - before)
                lasts.append(last + after)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), batch.column("owner")], ["doc_id", "tid", "first", "last", "owner"])

        return step

    return map_arrow(mine.join(kept, ["owner", "ha", "hb", "n"]), compare, "doc_id long, tid long, first int, last int, owner long")


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, tid, spans): one row for each text that loses passages; tid: its xxhash64; spans: array of (first, last: word positions, n_words,
    kept_in: the documents that keep the passage).

    A passage goes if it is made of pieces, lines or similar stretches that documents of smaller doc_id keep, one after the other
    without a gap, and has run_words words or more. Rows with equal doc_id are one document, what they share stays; null doc_ids
    and null, empty or wordless texts lose nothing; an empty table gives no rows. All documents take part, whole.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text")).where("doc_id is not null")
    spark = df.sparkSession
    shared = pieces_of(docs).groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).where("owner < other").drop("other")
    gone, _ = materialize(words_of_place(pieces_of(docs).join(shared, ["h", "g"]).where("doc_id <> owner")).select("doc_id", "tid", "first", "last", "owner", "h"), "gone")
    lines, path = materialize(lines_of(docs), "places")
    near = words_of_place(lines.select("doc_id", "tid", "at", "h", "g").join(near_lines(docs, lines), ["h", "g"]).where("doc_id <> owner"))
    near, _ = materialize(near.select("doc_id", "tid", "first", "last", "owner"), "near")
    release(spark, path)
    more, _ = materialize(stretches(docs, gone), "stretches")
    every = gone.drop("h").unionByName(near).unionByName(more)
    per_doc = every.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set(F.struct("first", "last", "owner"))).alias("p"))  # of one text
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("n_words", pa.int64()), ("kept_in", pa.list_(pa.int64()))])

    def runs(found: list[dict]) -> Iterator[dict]:
        first, last, owners = 0, -1, set()
        for p in [*sorted(found, key=lambda x: (x["first"], -x["last"], x["owner"])), None]:
            if p is None or p["first"] > last:
                if last - first >= run_words:
                    yield {"first": first, "last": last, "n_words": last - first, "kept_in": sorted(owners)}
                if p is not None:
                    first, last, owners = p["first"], p["last"], {p["owner"]}
            elif p["last"] > last:  # not inside of those before it
                last = p["last"]
                owners.add(p["owner"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [list(runs(p)) for p in batch.column("p").to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(found, pa.list_(span))], ["doc_id", "tid", "spans"])
            return out.filter(pa.array([bool(x) for x in found], pa.bool_()))

        return step

    return map_arrow(per_doc, make, "doc_id long, tid long, spans array<struct<first:int,last:int,n_words:long,kept_in:array<long>>>")


def cut(text: str | None, spans: list[dict] | None) -> str | None:
    """A text without the words of spans and the white space after them."""
    if not text or not spans:
        return text
    at = [m.start() for m in _solid.finditer(text)] + [len(text)]
    out, done = [], 0
    for s in spans:
        out.append(text[done : at[s["first"]]])
        done = at[s["last"]]
    return "".join([*out, text[done:]])


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """df with the passages of removals() cut out of its texts; a document of which nothing is left goes."""
    gone_id, gone_tid, gone = fresh(df, "gone_id", "gone_tid", "gone")
    found, _ = materialize(removals(df, id_col, text_col, run_words).toDF(gone_id, gone_tid, gone), "removals")
    same = (F.col(id_col).cast("long") == F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_tid))
    # only texts that may lose something are shuffled
    (key,) = fresh(df, "id")
    ids = found.select(F.col(gone_id).alias(key))
    some, others = (x.drop(key) for x in split_likely(df.withColumn(key, F.col(id_col).cast("long")), ids, key))
    rows = some.hint("merge").join(found, same, "left").drop(gone_id, gone_tid)
    schema, names = df.schema, df.columns

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = batch.column(gone).to_pylist()
            new = [cut(t, s) for t, s in zip(texts(batch, text_col), spans)]
            left = pa.array([not s or bool(t.strip()) for t, s in zip(new, spans)], pa.bool_())
            text = pa.array(new, batch.schema.field(text_col).type)
            return pa.RecordBatch.from_arrays([text if c == text_col else batch.column(c) for c in names], names).filter(left)

        return step

    return map_arrow(rows, make, schema).unionByName(others)
