"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are its own measures and those of the lines before and after; forward-backward gives
the marginal probability that it is good, and the marginals, weighted by the lines' lengths, give the document's quality,
through a logistic curve that makes it a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BYTES, bounded_sample, crc_of_id, map_arrow, texts

#: Labelled rows to learn from, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 5000
EPOCHS = 120
_upper = bytes(range(65, 91))
_lower = bytes(range(97, 123))
_digits = b"0123456789"
_marks = b"#*$%&|<>"
N_OWN = 16
N_FEATURES = 3 * N_OWN + 1


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    """Measures of one line; seen: the document's lines so far."""
    words = line.split()
    n = len(words)
    size = len(line)
    upper = size - len(line.translate(None, _upper))
    lower = size - len(line.translate(None, _lower))
    marks = size - len(line.translate(None, _marks))
    kinds = Counter(words)
    triples = list(zip(words, words[1:], words[2:]))
    stops = line.count(b".") + line.count(b"?") + line.count(b"!")
    bangs = line.count(b"!") / n
    again = line in seen
    seen.add(line)
    top = max(kinds.values()) / n
    return [
        1.0,
        min(marks / n, 1.0),
        1.0 if marks > 0.2 * n else 0.0,
        upper / max(upper + lower, 1),
        1.0 if upper > lower else 0.0,
        min(bangs, 1.0),
        1.0 if again else 0.0,
        len(kinds) / n,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        top if n > 9 else 0.0,
        min((size / n) / 20, 1.0),
        (size - len(line.translate(None, _digits))) / size,
        1.0 if line.rstrip()[-1:] in b".!?" else 0.0,
        min(n / max(stops, 1), 100) / 100,
        math.log1p(size) / 10,
        min(len(kinds) / n**0.85, 1.5),
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features (lines x N_OWN) and byte lengths of a text's lines; lines without a word don't count."""
    seen: set[bytes] = set()
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    own = np.array([line_features(x, seen) for x in lines], np.float32).reshape(-1, N_OWN)
    return own, np.array([len(x) for x in lines], float)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All features of lines of consecutive documents (counts: lines of each); zeros stand for lines outside a document."""
    full = np.zeros((len(own), N_FEATURES), np.float32)
    full[:, :N_OWN] = own
    if len(own):
        ends = np.cumsum(counts[counts > 0])
        firsts, lasts = np.concatenate([[0], ends[:-1]]), ends - 1
        full[1:, N_OWN : 2 * N_OWN] = own[:-1]
        full[firsts, N_OWN : 2 * N_OWN] = 0
        full[:-1, 2 * N_OWN : 3 * N_OWN] = own[1:]
        full[lasts, 2 * N_OWN : 3 * N_OWN] = 0
        full[firsts, -1] = 1
    return full


def forward_backward(odds: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good for each line, expected transitions (2 x 2), and the sum of log-partitions.

    odds: each line's score of good against bad; counts: lines of each document, in turn, none of them 0.
    """
    order = np.argsort(-counts, kind="stable")
    n = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # documents with more lines than t
    m = np.exp(trans - trans.max())
    fwd, bwd, scale = np.zeros((len(odds), 2)), np.ones((len(odds), 2)), np.zeros(len(odds))
    emit = np.stack([1 / (1 + np.exp(np.clip(odds, -40, 40))), 1 / (1 + np.exp(-np.clip(odds, -40, 40)))], 1)
    for t in range(steps):
        at = starts[: live[t]] + t
        a = emit[at] if t == 0 else (fwd[at - 1] @ m) * emit[at]
        scale[at] = a.sum(1)
        fwd[at] = a / scale[at, None]
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        bwd[at] = (bwd[at + 1] * emit[at + 1]) @ m.T / scale[at + 1, None]
    both = fwd * bwd
    marginal = both[:, 1] / both.sum(1)
    inner = np.ones(len(odds), bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    xi = np.einsum("ni,ij,nj->nij", fwd[at], m, bwd[at + 1] * emit[at + 1]) / scale[at + 1, None, None]
    log_z = np.log(scale).sum() + np.logaddexp(0, odds).sum() + trans.max() * len(at)
    return marginal, xi.sum(0), float(log_z)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    base: float

    def qualities(self, docs: list[str | None]) -> np.ndarray:
        """Length-weighted mean marginal of each text; NaN without a line."""
        parts = [document_features(t) for t in docs]
        return pooled(self.weights, self.trans, parts)

    def scores(self, docs: list[str | None]) -> np.ndarray:
        q = self.qualities(docs)
        return np.where(np.isnan(q), 0.0, _curve(np.nan_to_num(q, nan=0.5), *self.curve))


def _curve(q: np.ndarray, a: float, b: float) -> np.ndarray:
    p = np.clip(q, 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(a + b * np.log(p / (1 - p)))))


def pooled(weights: np.ndarray, trans: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    counts = np.array([len(own) for own, _ in parts])
    out = np.full(len(parts), np.nan)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    own = np.concatenate([parts[i][0] for i in some])
    size = np.concatenate([parts[i][1] for i in some])
    n = counts[some]
    marginal, _, _ = forward_backward((with_neighbours(own, n) @ weights).astype(float), n, trans)
    at = np.cumsum(n) - n
    out[some] = np.add.reduceat(marginal * size, at) / np.add.reduceat(size, at)
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Labels, features and lengths of at most `rows` different labelled texts, and of most_bytes of bytes and 64 a line for each
    class; none with crc32(id) mod 5 = 0."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(crc_of_id("doc_id") % 5 != 0)
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    picked = bounded_sample(found, rows, most_bytes, F.octet_length("text") + 64 * lines)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [document_features(t) for t in texts(batch)]
            own = pa.array([x.tobytes() for x, _ in parts], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), own, pa.array([s.tobytes() for _, s in parts], pa.binary())], ["h", "y", "own", "size"])

        return step

    got = map_arrow(picked, make, "h long, y int, own binary, size binary").toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).to_pylist()[:rows]
    return [(r["y"], np.frombuffer(r["own"], np.float32).reshape(-1, N_OWN), np.frombuffer(r["size"], float)) for r in got if r["own"]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Maximum likelihood with every line of a labelled document carrying its label, by Adam; then the curve.

    Without rows of both classes the model is neutral: score 0.5 for every text with a word.
    """
    got = _sample(docs, labels, id_col, text_col, label_col, rows)
    y = np.array([g[0] for g in got])
    trans = np.zeros((2, 2))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), trans, (0.0, 1.0), 0.5)
    parts = [(own, size) for _, own, size in got]
    counts = np.array([len(p[0]) for p in parts])
    x = with_neighbours(np.concatenate([p[0] for p in parts]), counts).astype(float)
    truth = np.repeat(y, counts).astype(float)
    # a document counts once, not by its lines; the classes count alike
    share = np.repeat(1 / counts, counts) * np.where(truth == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    weights, moment, second = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    each = counts - 1
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = each[y == 0].sum(), each[y == 1].sum()
    for k in range(1, epochs + 1):
        w, trans = weights[:N_FEATURES], weights[N_FEATURES:].reshape(2, 2)
        marginal, moved, _ = forward_backward(x @ w, counts, trans)
        grad = np.concatenate([x.T @ ((truth - marginal) * share) - 1e-4 * w, ((seen - moved) / max(each.sum(), 1)).ravel() - 1e-3 * trans.ravel()])
        moment, second = 0.9 * moment + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        weights = weights + 0.15 * (moment / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    w, trans = weights[:N_FEATURES], weights[N_FEATURES:].reshape(2, 2).copy()
    q = np.clip(pooled(w, trans, parts), 1e-4, 1 - 1e-4)
    z = np.stack([np.ones(len(q)), np.log(q / (1 - q))], 1)
    theta = np.array([0.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * (theta - [0, 1]))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(w.copy(), trans, (float(theta[0]), float(max(theta[1], 1e-3))), float(y.mean()))


def scored(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with the column quality (double, 0 to 1), which replaces one of that name.

    Null, empty and wordless texts get 0. Texts are scored whole, however long; repeated rows and ids are kept and get equal scores;
    an empty table gives no rows.
    """
    df = df.drop("quality")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts(batch, text_col)), pa.float64())], [*batch.schema.names, "quality"])

        return step

    schema = df.withColumn("quality", F.lit(0.0)).schema
    for f in schema:
        f.nullable = True
    return map_arrow(df, make, schema)
