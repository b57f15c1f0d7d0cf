"""Toxicity from a weighted lexicon, matched by Aho-Corasick.

Texts are folded first (case, accents, homoglyphs, digits and signs that stand for letters), so that spellings meant to evade the
list meet it. Entries are whole words or beginnings of words. Matches inside an exception phrase don't count. The weights of the
matches, as they are and for the text's length, give a score through a logistic curve.

A few entries are fixed; the others, all weights and the curve are learned from labelled rows.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, bounded_sample, crc_of_id, map_arrow, materialize, release, texts

#: At most so many labelled rows of each class are used for learning: those with the smallest hashes of their ids.
SAMPLE_ROWS = 3000
LIFT = 5
PREFIX_LENGTHS = range(4, 9)

# English insults, and phrases in which some of them are harmless.
BASE_LEXICON = ["asshole", "bastard", "clown", "cretin", "disgusting", "dumbass", "idiot", "idiotic", "imbecile", "loser", "moron", "moronic", "pathetic", "retard", "scum", "scumbag", "stupid", "trash", "vermin", "worthless"]
EXCEPTIONS = ["circus clown", "class clown", "clown fish", "clown anemone", "trash can", "trash cans", "trash bag", "trash bags", "trash collection", "trash bin", "pond scum", "soap scum", "worthless check", "sore loser"]

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "ѵ": "v", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ӏ": "l", "ⅼ": "l", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

_table = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
_table |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()}  # full-width letters
_table |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])  # characters without width
_inside = re.compile(r"(?<=\w)[!|](?=\w)")
_before = re.compile(r"[@$](?=\w)")
_word = re.compile(r"\w+")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "!" in text or "|" in text:
        text = _inside.sub("i", text)
    if "@" in text or "$" in text:
        text = _before.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return _word.findall(text.translate(_table))


@dataclass
class Model:
    """weights: by entry (" word " is a whole word, " word" a beginning); curve: bias and two factors."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))


class Matcher:
    def __init__(self, model: Model):
        self.model, self.made = model, ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.made.add_word(entry, (len(entry.strip()), weight))
        for phrase in model.exceptions:
            self.made.add_word(f" {' '.join(fold(phrase))} ", (len(" ".join(fold(phrase))), None))
        self.ready = len(self.made) > 0
        self.made.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int]:
        """The weights of all matches outside exception phrases, one for each word, and the number of words."""
        words = fold(text) if text else []
        if not words or not self.ready:
            return 0.0, len(words)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        line = f" {' '.join(words)} "
        for end, (n, weight) in self.made.iter(line):
            start = end - n if line[end] == " " else end - n + 1
            if weight is None:
                spared.append((start, start + n))
            else:
                best[start] = max(weight, best.get(start, weight))
        spared.sort()
        total, reach, k = 0.0, 0, 0
        for at in sorted(best):
            while k < len(spared) and spared[k][0] <= at:
                reach, k = max(reach, spared[k][1]), k + 1
            if at >= reach:
                total += best[at]
        return total, len(words)

    def score(self, text: str | None) -> float:
        weight, n = self.weigh(text)
        x = np.dot(self.model.curve, (1.0, math.log1p(weight), math.log1p(1000 * weight / max(n, 1))))
        return float(1 / (1 + math.exp(-min(max(x, -500), 500))))


def _entries(words: list[str]) -> set[str]:
    kinds = set(words)
    return {f" {w} " for w in kinds if len(w) > 2} | {f" {w[:k]}" for w in kinds for k in PREFIX_LENGTHS if len(w) > k}


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(crc_of_id("doc_id") % 5 != 0)
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, y): labelled documents to learn from, at most `rows` different texts of each class, and most_bytes of them; rows with
    crc32(id) mod 5 = 0 are left out."""
    known = _labelled(labels, id_col, label_col).withColumn("o", F.xxhash64("doc_id"))
    chosen = known.where("y = 1").orderBy("o", "doc_id").limit(rows).unionByName(known.where("y = 0").orderBy("o", "doc_id").limit(rows)).drop("o")
    # at most twice `rows` ids
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return bounded_sample(found, rows, most_bytes).select("text", "y")


def _counted(rows: DataFrame) -> DataFrame:
    """(entry, bad, good): in how many sample documents of either class an entry stands."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen = [Counter(), Counter()]
            for text, y in zip(texts(batch), batch.column("y").to_pylist()):
                seen[y].update(_entries(fold(text)))
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([seen[1][e] for e in names], pa.int64()), pa.array([seen[0][e] for e in names], pa.int64())], ["entry", "bad", "good"])

        return step

    return map_arrow(rows, make, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _having(rows: DataFrame, entries: list[str]) -> list[tuple[int, list[str]]]:
    """Of each sample document: its class and those of the entries that it has."""
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(entries))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(_entries(fold(t)) & wanted.value) for t in texts(batch)]
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.string()))], ["y", "e"])

        return step

    return [(r["y"], r["e"]) for r in map_arrow(rows, make, "y int, e array<string>").collect()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **columns: str) -> Model:
    """Learn entries, weights and curve.

    Candidates stand in three toxic sample documents or more, and in a share of them that is LIFT times the share of the
    others. Entries are then taken one by one, each time the one that covers most toxic documents not yet covered three
    times, less those others, so that words which only belong to copies of one toxic document stay out. The curve is set for
    the classes as they are among all labelled rows outside the held-out fifth. No labelled rows: the fixed entries, weight 1.
    """
    rows_df, path = materialize(sample(docs, labels, rows=rows, **columns), "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in rows_df.groupBy("y").count().collect()}
    base = [f" {w} " for w in BASE_LEXICON]
    if len(sizes) < 2:
        release(docs.sparkSession, path)
        return Model(dict.fromkeys(base, 1.0), (-2.0, 3.0, 0.5))
    n_bad, n_good = sizes[1], sizes[0]
    counts = _counted(rows_df)
    likely = counts.where(f"bad >= 3 and bad * {n_good} >= {LIFT} * good * {n_bad}")
    stats = {r["entry"]: (r["bad"], r["good"]) for r in likely.collect()}
    have = _having(rows_df, [*stats, *base])
    toxic = [e for y, e in have if y == 1]
    good = Counter(e for y, es in have if y == 0 for e in es)
    owners: dict[str, list[int]] = defaultdict(list)
    for i, es in enumerate(toxic):
        for e in es:
            owners[e].append(i)
    covered, least = np.zeros(n_bad, int), max(3, round(0.002 * n_bad))
    chosen: list[str] = []
    live = {e: np.array(o) for e, o in owners.items() if e in stats}
    cost = {e: 2 * n_bad * good[e] / n_good for e in live}
    # the largest gain first; of equals, whole words; gains only fall, so they are brought up to date when they come up
    order = sorted(live, key=lambda e: (e.endswith(" "), -len(e), e), reverse=True)
    heap = [(cost[e] - len(live[e]), i) for i, e in enumerate(order)]
    heapq.heapify(heap)
    while heap:
        gain, i = heap[0]
        e = order[i]
        now = int((covered[live[e]] < 3).sum()) - cost[e]
        if now < least:
            heapq.heappop(heap)
        elif now < -gain:
            heapq.heapreplace(heap, (-now, i))
        else:
            chosen.append(e)
            covered[live[e]] += 1
            heapq.heappop(heap)
    weights = {}
    for e in [*chosen, *base]:
        bad = len(owners.get(e, ()))
        weights[e] = max(0.05, math.log((bad + 0.5) / (n_bad + 1)) - math.log((good[e] + 0.5) / (n_good + 1))) if bad + good[e] else 3.0
    model = Model(weights, (0.0, 0.0, 0.0))
    bias, *rest = _curve(rows_df, model)
    all_sizes = {r["y"]: r["count"] for r in _labelled(labels, columns.get("id_col", "doc_id"), columns.get("label_col", "toxic")).groupBy("y").count().collect()}
    odds = all_sizes[1] / all_sizes[0] * n_good / n_bad
    model.curve = (bias + math.log(odds), *rest)
    release(docs.sparkSession, path)
    return model


def _curve(rows: DataFrame, model: Model, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression on the sample's weights; the classes count as they are in it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        matcher = Matcher(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            w = [matcher.weigh(t) for t in texts(batch)]
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x for x, _ in w], pa.float64()), pa.array([n for _, n in w], pa.int64())], ["y", "w", "n"])

        return step

    found = map_arrow(rows, make, "y int, w double, n long").toPandas()
    y, w, n = found["y"].to_numpy(float), found["w"].to_numpy(), found["n"].to_numpy()
    x = np.stack([np.ones(len(y)), np.log1p(w), np.log1p(1000 * w / np.maximum(n, 1))], 1)
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * theta)
        theta = theta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, theta))


def scored(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """df with the column out_col (double, 0 to 1), which replaces one of that name.

    Null, empty and wordless texts get the curve's value without a match. Texts are scored whole, in time that grows with their
    length; repeated rows and ids are kept and get equal scores; an empty table gives no rows.
    """
    df = df.drop(out_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        matcher = Matcher(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([matcher.score(t) for t in texts(batch, text_col)], pa.float64())], [*batch.schema.names, out_col])

        return step

    schema = df.withColumn(out_col, F.lit(0.0)).schema
    for f in schema:
        f.nullable = True
    return map_arrow(df, make, schema)
