"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into chunks; in each, one recurrent layer runs forward and one backward, every position gets
probabilities of all languages, and a document's probabilities are the means over its positions. The network is trained here
by backpropagation through time, with Adam. Arrays hold features first and chunks last, so that each step works on rows that
are contiguous, for thousands of chunks at once; the two directions share a step by a block-diagonal recurrent matrix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, map_arrow, texts

#: Texts to learn from, about so many in all, evenly over the languages, at least one of each; they are learned from whole.
SAMPLE_ROWS = 3200
#: Chunks of these texts that come to the driver at most, about: 29 MB. Beyond it chunks are drawn by a hash from all of the texts.
SAMPLE_CHUNKS = 300_000
HIDDEN = 8
CHUNK = 96
STEPS = 240
BATCH = 384
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")


def chunked(text: bytes, size: int = CHUNK) -> np.ndarray:
    """Rows of `size` bytes, the last one filled up with zeros."""
    n = -(-len(text) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, size)


@dataclass
class Network:
    """table: 6h x 256, what a byte adds to the gates; rows z, r, n, each forward then backward. inner: 6h x 2h,
    block-diagonal. bias: 2h x 1, of the recurrent part of n. out, out_bias: classes x 2h and x 1.

    With u = what byte and state add up to, z = s(2u), r = s(2u) for the logistic s, n = tanh(u_n + r (inner_n state + bias)),
    and the next state is n + z (state - n).
    """

    table: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    PARTS = ("table", "inner", "bias", "out", "out_bias")

    def inputs(self, across: np.ndarray, t: int) -> np.ndarray:
        h2 = self.inner.shape[1]
        h = h2 // 2
        x = np.empty((3, 2, h, across.shape[1]), np.float32)
        table = self.table.reshape(3, 2, h, 256)
        for gate in range(3):
            for side, at in ((0, t), (1, len(across) - 1 - t)):
                np.take(table[gate, side], across[at], axis=1, out=x[gate, side], mode="clip")
        return x.reshape(3 * h2, -1)

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states, steps x 2h x chunks, of rows of bytes (chunks x steps). Of the backward half, step t is position
        steps - 1 - t. keep gets what backpropagation needs."""
        across = np.ascontiguousarray(codes.T).astype(np.intp)
        h2, (steps, n) = self.inner.shape[1], across.shape
        state, out = np.zeros((h2, n), np.float32), np.empty((steps, h2, n), np.float32)
        for t in range(steps):
            x, rec = self.inputs(across, t), self.inner @ state
            gates, c, new = x[: 2 * h2], rec[2 * h2 :], x[2 * h2 :]
            gates += rec[: 2 * h2]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            c += self.bias
            new += gates[h2:] * c
            np.tanh(new, out=new)
            np.subtract(state, new, out=out[t])
            out[t] *= gates[:h2]
            out[t] += new
            if keep is not None:
                keep.append((state, gates, c, new))
            state = out[t]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of each position, steps x classes x chunks."""
        h = self.inner.shape[1] // 2
        p = np.matmul(self.out[:, :h], states[:, :h])
        p += np.matmul(self.out[:, h:], states[::-1, h:])
        p += self.out_bias
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradients(self, codes: np.ndarray, valid: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the valid first positions of each row, and its gradients through time."""
        keep: list = []
        s = self.states(codes, keep)
        steps, h2, n = s.shape
        h = h2 // 2
        p = self.probabilities(s)
        real = (np.arange(steps)[:, None] < valid[None, :]).astype(np.float32) / max(int(valid.sum()), 1)
        loss = float(-(np.log(p[:, labels, np.arange(n)] + 1e-12) * real).sum())
        d = p
        d[:, labels, np.arange(n)] -= 1
        d *= real[:, None, :]
        grad = {k: np.zeros_like(getattr(self, k)) for k in self.PARTS}
        grad["out_bias"] = d.sum((0, 2))[:, None]
        grad["out"][:, :h] = np.tensordot(d, s[:, :h], ((0, 2), (0, 2)))
        grad["out"][:, h:] = np.tensordot(d, s[::-1, h:], ((0, 2), (0, 2)))
        ds = np.empty_like(s)
        ds[:, :h] = np.matmul(self.out[:, :h].T, d)
        ds[:, h:] = np.matmul(self.out[:, h:].T, d)[::-1]
        dx, flow = np.empty((steps, 3 * h2, n), np.float32), np.zeros((h2, n), np.float32)
        for t in range(steps - 1, -1, -1):
            state, gates, c, new = keep[t]
            z, r = gates[:h2], gates[h2:]
            g = ds[t] + flow
            dn = g * (1 - z) * (1 - new * new)
            dz, dr, dc = g * (state - new) * 2 * z * (1 - z), dn * c * 2 * r * (1 - r), dn * r
            dx[t, :h2], dx[t, h2 : 2 * h2], dx[t, 2 * h2 :] = dz, dr, dn
            da = np.concatenate([dz, dr, dc])
            grad["inner"] += da @ state.T
            grad["bias"] += dc.sum(1, keepdims=True)
            flow = g * z + self.inner.T @ da
        grad["inner"] *= self.inner != 0
        flat = np.ascontiguousarray(codes.T)
        for side, seen in ((0, flat.ravel()), (1, flat[::-1].ravel())):
            for row in (k * h2 + side * h + i for k in range(3) for i in range(h)):
                grad["table"][row] = np.bincount(seen, dx[:, row].ravel(), 256)
        return loss, grad


def random_network(classes: int, hidden: int = HIDDEN, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    h2 = 2 * hidden
    inner = np.zeros((3 * h2, h2), np.float32)
    for gate in range(3):
        for side in range(2):
            at = gate * h2 + side * hidden
            inner[at : at + hidden, side * hidden : (side + 1) * hidden] = np.linalg.qr(rng.normal(size=(hidden, hidden)))[0]
    table, out = rng.normal(0, 0.3, (3 * h2, 256)).astype(np.float32), rng.normal(0, 0.3, (classes, h2)).astype(np.float32)
    return Network(table, inner, np.zeros((h2, 1), np.float32), out, np.zeros((classes, 1), np.float32))


def train(codes: np.ndarray, valid: np.ndarray, labels: np.ndarray, owner: np.ndarray, steps: int = STEPS, hidden: int = HIDDEN, batch: int = BATCH, seed: int = 1) -> Network:
    """Adam with a falling rate. Each batch draws evenly over the classes, in them over texts, and in these over their chunks.

    owner: the text of each chunk; chunks of a text stand together and have one label; each class from 0 on has a text.
    """
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(starts, append=len(owner))
    classes = int(labels.max()) + 1
    net, rng = random_network(classes, hidden, seed), np.random.default_rng(seed + 1)
    own = [np.flatnonzero(labels[starts] == k) for k in range(classes)]
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in net.PARTS} for _ in range(2))
    for i in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(x, -(-batch // classes)) for x in own])
        pick = starts[drawn] + (rng.random(len(drawn)) * sizes[drawn]).astype(int)
        _, grad = net.gradients(codes[pick], valid[pick], labels[pick])
        size = float(np.sqrt(sum((g.astype(float) ** 2).sum() for g in grad.values())))
        rate = 0.02 * (1 - 0.95 * i / steps)
        for k in net.PARTS:
            g = grad[k] * min(1.0, 1.0 / (size + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            step = rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
            setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


@dataclass
class Model:
    languages: list[str]
    network: Network | None

    def predict(self, rows: list[str | None], at_once: int = 4096) -> tuple[list[str], list[float]]:
        """Language and probability of each text; UNKNOWN and 0 for a text that is null or has no letter."""
        langs, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
        known = [i for i, t in enumerate(rows) if t and _letter.search(t)] if self.network else []
        if not known:
            return langs, scores
        raw = [rows[i].encode("utf-8", "surrogatepass") for i in known]
        parts = [chunked(b) for b in raw]
        owner = np.repeat(np.arange(len(raw)), [len(p) for p in parts])
        valid = np.concatenate([np.r_[np.full(len(p) - 1, CHUNK), len(b) - CHUNK * (len(p) - 1)] for p, b in zip(parts, raw)])
        codes = np.concatenate(parts)
        total = np.zeros((len(raw), len(self.languages)))
        for at in range(0, len(codes), at_once):
            p = self.network.probabilities(self.network.states(codes[at : at + at_once]))
            if (v := valid[at : at + at_once]).min() < CHUNK:
                p *= np.arange(CHUNK)[:, None, None] < v[None, None, :]
            np.add.at(total, owner[at : at + at_once], p.sum(0).T)
        total /= total.sum(1, keepdims=True)
        for i, k, s in zip(known, total.argmax(1), total.max(1)):
            langs[i], scores[i] = self.languages[k], float(s)
        return langs, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, steps: int = STEPS, hidden: int = HIDDEN, most_chunks: int = SAMPLE_CHUNKS) -> Model:
    """Learn every non-null language from documents with crc32(id) mod 4 other than 2.

    Texts are drawn by a threshold on their hashes, about `rows` / languages different ones of each language (all if there are
    fewer), at least the one with the least hash; so copies and repeated rows count once and no id matters. A text that stands
    under several languages counts for each. Null and empty texts teach nothing; without any other, or with an empty table, every
    text is UNKNOWN. Long texts are learned from whole, unless the texts have more than most_chunks chunks in all: then from a part of
    all chunks, drawn in the tasks by a hash.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.coalesce(F.length(text_col), F.lit(0)) > 0)).where(crc_of_id(id_col) % 4 != 2)
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, F.lit(7)).alias("h"))
    # one row for each language
    seen = sorted(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect())
    if not seen:
        return Model([], None)
    share = rows / len(seen)
    limits = [(r["lang"], y, max(r["least"], min((1 << 63) - 1, -(1 << 63) + int(min(1.0, share / max(r["n"], 1)) * (1 << 64))))) for y, r in enumerate(seen)]
    table = known.sparkSession.createDataFrame(limits, "lang string, y int, most long")
    chosen = known.join(F.broadcast(table), "lang").where("h <= most").groupBy("y", "h").agg(F.min("text").alias("text"))

    total = chosen.agg(F.sum(F.ceil(F.octet_length("text") / F.lit(CHUNK)))).first()[0]
    share = min(1.0, most_chunks / total)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for y, h, text in zip(*(batch.column(c).to_pylist() for c in ("y", "h", "text"))):
                raw = text.encode("utf-8", "surrogatepass")
                parts = chunked(raw)
                valid = np.full(len(parts), CHUNK, np.int32)
                valid[-1] = len(raw) - CHUNK * (len(parts) - 1)
                if share < 1:
                    with np.errstate(over="ignore"):
                        mixed = (np.arange(len(parts), dtype=np.uint64) + np.uint64(h & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                    drawn = (mixed >> np.uint64(11)).astype(float) < share * 2.0**53
                    drawn[mixed.argmin()] = True  # of each text one at least
                    parts, valid = parts[drawn], valid[drawn]
                for column, value in zip(out, (y, h, parts.tobytes(), valid.tobytes())):
                    column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["y", "h", "parts", "valid"])

        return step

    got = map_arrow(chosen.select("y", "h", "text"), make, "y int, h long, parts binary, valid binary").toArrow().sort_by([("y", "ascending"), ("h", "ascending")])
    codes = [np.frombuffer(p, np.uint8).reshape(-1, CHUNK) for p in got.column("parts").to_pylist()]
    valid = np.concatenate([np.frombuffer(v, np.int32) for v in got.column("valid").to_pylist()]).astype(np.int64)
    n = np.array([len(c) for c in codes])
    network = train(np.concatenate(codes), valid, np.repeat(got.column("y").to_numpy(), n), np.repeat(np.arange(len(codes)), n), steps, hidden)
    return Model([r["lang"] for r in seen], network)


def predicted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and lang_score (double, 0 to 1), which replace columns of these names.

    Null texts and those without a letter, empty ones too: UNKNOWN and 0. Texts are scored whole, however long; repeated rows and ids
    are kept and get equal results; an empty table gives no rows.
    """
    df = df.drop("lang_pred", "lang_score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = [], []
            rows = texts(batch, text_col)
            for at in range(0, len(rows), 250):
                a, b = shared.value.predict(rows[at : at + 250])
                langs += a
                scores += b
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

        return step

    schema = df.withColumn("lang_pred", F.lit("")).withColumn("lang_score", F.lit(0.0)).schema
    for f in schema:
        f.nullable = True
    return map_arrow(df, make, schema)
