"""Packing by concatenate and cut.

Pass 1 tokenises every partition once into a table in the shared folder, with the tokens that stand before each document in
its partition. The partitions' token totals give each partition's global offset by a prefix sum. Pass 2 cuts every document
at the multiples of the window: a document over a boundary gives one record for each window it touches, so windows that
span partitions need no exchange of neighbours.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts

WINDOW = 1024
END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class FastTokenizer:
    """The ids that `tokenizers` gives with a byte-level BPE file, found by tiktoken where the file allows it.

    tiktoken merges the pair of lowest id. That is the file's own order if each merge makes the next id, which is checked
    here, as is the file's standard pattern; else, and for texts that tiktoken gives up on, `tokenizers` does the work.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        plain = {t: i for t, i in vocab.items() if t not in added}
        made = {a + b for a, b in merges}
        rising = all(vocab[x[0] + x[1]] < vocab[y[0] + y[1]] for x, y in zip(merges, merges[1:]))
        standard = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and spec.get("normalizer") is None
        if standard and rising and all(len(t) == 1 or t in made for t in plain):
            import tiktoken

            octets = _octets()
            ranks = {bytes(octets[c] for c in t): i for t, i in plain.items()}
            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
            self.added = set(added)

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.added, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError as e:  # its pattern engine has limits, which long runs of white space reach
                if "backtracking" not in str(e):
                    raise
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Fixed value: the pattern by which byte-level BPE cuts texts.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _octets() -> dict[str, int]:
    """The characters by which byte-level BPE files write bytes: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_tokenizers: dict[str, FastTokenizer] = {}


def _tokenizer(path: str) -> FastTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = FastTokenizer(path)
    return _tokenizers[path]


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids): each row's ids and end_id, and the ids before it in its partition."""

    def make():
        tok, part, end = _tokenizer(tokenizer_path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        done = 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal done
            ids = [tok.encode(t or "") + end for t in texts(batch)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            before = done + np.cumsum(n) - n
            done += int(n.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(before), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "before", "doc_id", "doc_tokens", "ids"],
            )

        return step

    return map_arrow(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        make,
        "part int, before long, doc_id long, doc_tokens long, ids binary",
    )


def pack(df: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Cut the concatenation of all documents into windows of `window` ids.

    Returns one row for each piece of a document in a window: doc_id, start (its document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with end_id), sequence_id, offset (in the window). Every window but the
    last is full. A null or empty text is the single id end_id. Null and repeated doc_ids are kept: each row is a document
    of its own. An empty table gives no rows. Columns other than id_col and text_col are not read.
    """
    spark = df.sparkSession
    rows, _ = materialize(tokenize(df, tokenizer_path or default_tokenizer(), id_col, text_col, end_id), "tokens")
    # one total for each partition of the input, 16 bytes for some 100 MB of texts; offsets need them in order
    totals = sorted(rows.groupBy("part").agg(F.sum("doc_tokens")).collect())
    offsets = itertools.accumulate((n for _, n in totals), initial=0)
    table = spark.createDataFrame([(p, o) for (p, _), o in zip(totals, offsets)], "part int, first long")
    at = rows.join(F.broadcast(table), "part").withColumn("at", F.col("first") + F.col("before"))
    cut = at.select(
        "doc_id", "doc_tokens", "ids", "at",
        F.explode(F.expr(f"sequence(at div {window}, (at + doc_tokens - 1) div {window})")).alias("sequence_id"),
    )
    cut = cut.withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * window - F.col("at"))).withColumn(
        "length", F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * window - F.col("at")) - F.col("start")
    )
    return cut.select(
        "doc_id", "start", "length",
        F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"),
        "doc_tokens", "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
    )


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, n_tokens): the whole windows, the last one padded; a window has at most `window` pieces."""
    gathered = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    pad = np.array([pad_id], "<u4").tobytes().hex()
    joined = F.expr("aggregate(p, cast('' as binary), (acc, x) -> concat(acc, x.ids))")
    padding = F.expr(f"unhex(repeat('{pad}', cast({window} - n_tokens as int)))")
    return gathered.select("sequence_id", F.concat(joined, padding).alias("ids"), "n_tokens")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
