"""Token counts by a unigram model, with dynamic programming that a trie of pre-tokens shares.

A text is cut into pre-tokens. The distinct ones are walked in sorted order, which is the depth-first order of their trie:
what a pre-token shares with the one before it keeps its forward scores, so each node of the trie is computed once. A
terminal keeps the number of pieces on its best path, and a document's count is the sum over its pre-tokens.

Piece probabilities fall with the rank of a piece in the vocabulary file (Zipf-Mandelbrot); characters that no piece covers
count one token for each byte.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

#: Terminal counts that a worker keeps; beyond, it starts again.
KEEP = 400_000
RANK_SHIFT = 2.7
BYTE_PENALTY = 10.0
#: Above any score.
NO_ENDING = 1.0
SPACE = "▁"
_cut = re.compile(rf"{SPACE}?[^{SPACE}\s]+|{SPACE}+|\s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a sentencepiece file, by their rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(pieces))))
    return {p: -math.log(r + RANK_SHIFT) - total for r, p in enumerate(pieces)}


def pre_tokens(text: str) -> list[str]:
    return _cut.findall(text.replace(" ", SPACE))


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        # ends of pieces: with their score if they are pieces themselves, else None
        self.endings: dict[str, float | None] = {p[k:]: None for p in scores for k in range(1, len(p))} | scores
        self.single = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.counts: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Terminal counts of words, each shared prefix being scored once. Of equal scores the shorter last piece wins."""
        get, single = self.endings.get, self.single
        best, pieces = [0.0], [0]
        before = ""
        for w in sorted(words):
            keep = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                keep += 1
            del best[keep + 1 :], pieces[keep + 1 :]
            for end in range(keep + 1, len(w) + 1):
                c = w[end - 1]
                n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                top, count = best[end - 1] + n * single, pieces[end - 1] + n
                for start in range(end - 1, -1, -1):
                    s = get(w[start:end], NO_ENDING)
                    if s is None:
                        continue
                    if s > 0:  # no piece ends like this, so none ends like what is longer
                        break
                    if best[start] + s > top:
                        top, count = best[start] + s, pieces[start] + 1
                best.append(top)
                pieces.append(count)
            self.counts[w] = pieces[-1]
            before = w

    def count_all(self, batch: list[str | None]) -> tuple[list[int], list[int]]:
        """Of each text: its pre-tokens and its tokens."""
        cut = [pre_tokens(t) if t else [] for t in batch]
        new = set().union(*cut)
        if len(self.counts) + len(new) > KEEP:
            self.counts.clear()
        self.learn(new.difference(self.counts))
        get = self.counts.__getitem__
        return [len(c) for c in cut], [sum(map(get, c)) for c in cut]


_counters: dict[str, TrieCounter] = {}


def _counter(path: str) -> TrieCounter:
    """A worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = TrieCounter(piece_scores(path))
    return _counters[path]


def counted(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), one row for each row of df.

    Null and empty texts count 0; null and repeated ids are kept as they are; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def make():
        counter = _counter(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut, n = [], []
            rows = texts(batch)
            for at in range(0, len(rows), 250):
                a, b = counter.count_all(rows[at : at + 250])
                cut += a
                n += b
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(cut, np.int64)), pa.array(np.array(n, np.int64))], ["doc_id", "n_pretokens", "n_tokens"])

        return step

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, n_pretokens long, n_tokens long")
