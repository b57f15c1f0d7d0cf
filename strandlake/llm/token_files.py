"""Files of token ids: one array of all ids in the order of the documents, and Elias-Fano codes of where documents end.

A file set is a folder with two Parquet tables.

- blocks: one row for some BLOCK_IDS ids or BLOCK_DOCS documents, never less than a document: part, block (its place in the part),
  docs_before and ids_before (in the part), n_docs, n_ids, n_null (documents without an id, which come first), min_id and max_id,
  doc_ids (Elias-Fano code of the others' ids), ends (Elias-Fano code of where each document ends in the block), width (bytes of an
  id: 2 up to a vocabulary of 65,536, else 4), ids (little-endian unsigned numbers).
- parts: part, docs_before, ids_before (in all). One row for each partition that wrote blocks, in the order of the documents.

So a document's offset is ids_before of its part and block, and one select in ends; no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_arrow, prepare
from .elias_fano import EliasFano, encode
from .packing import _octets

END_ID = 1
#: A block is closed at so many ids (2 MB of them at two bytes) or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 16
#: A worker remembers the ids of between one and two times this many words (some 200 bytes each), none longer than LONG_WORD.
WORD_COUNT, LONG_WORD = 250_000, 64
#: Words that go to the model in one text; longer texts take longer a word.
CALL_WORDS = 200

BLOCKS = (
    "part int, block int, docs_before long, ids_before long, n_docs long, n_ids long, n_null long, min_id long, max_id long, "
    "doc_ids binary, ends binary, width int, ids binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters of Latin-1: all are letters to the pattern, stay as they are under NFC, and have one lower-case form each.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


class WordTokenizer:
    """The ids that `tokenizers` gives, with each different word of a batch encoded once.

    Files that cut words by a pattern, drop white space and end words by a suffix (_by_words) have a text's ids as those of its
    words in turn, so texts are cut at ASCII white space, and before marks that end a word. A word of Latin letters is one piece to
    the file's pattern: its lower-case form goes straight to the file's model, with many others in one call; other words go through
    the whole file. Files of other kinds get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.whole.to_str())
        self.by_words = _by_words(spec)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        if self.by_words:
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        shown = {b: c for c, b in _octets().items()}
        self.octets = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        out: list[bytes] = [b""] * len(words)
        latin = pc.match_substring_regex(pa.array(words, pa.string()), f"^[{LATIN}]+$").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~latin).tolist()
        for i, e in zip(rest, self.whole.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        at = np.flatnonzero(latin).tolist()
        plain = "\n".join([words[i] for i in at]).lower().translate(self.octets).split("\n") if at else []
        calls = [" ".join(plain[k : k + CALL_WORDS]) for k in range(0, len(plain), CALL_WORDS)]
        found = self.model.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), self.dtype)
        width, raw = self.dtype.itemsize, ids.tobytes()
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        for i, a, b in zip(at, [0, *ends][:-1], ends, strict=True):
            out[i] = raw[width * a : width * b]
        return out

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of words, most of which were seen before. Two generations are held; a word of the older one moves to the newer."""
        found = list(map(self.known.get, words))
        lost = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in lost:
            if (x := self.older.get(words[i])) is None:
                new.append(i)
            else:
                found[i] = x
        for i, x in zip(new, self._encode_words([words[i] for i in new])):
            found[i] = x
        for i in lost:
            if len(w := words[i]) <= LONG_WORD:
                if self.held >= WORD_COUNT:
                    self.older, self.known, self.held = self.known, {}, 0
                self.known[w] = found[i]
                self.held += 1
        return found

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; a null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            each = [self._ids(t) for t in texts.to_pylist()]
            return np.concatenate([*each, np.empty(0, self.dtype)]), np.array([len(x) for x in each], np.int64)
        # a mark between a letter and white space is a piece of its own anyway; apart from the word, both repeat more often
        texts = pc.replace_substring_regex(texts, f"([{LATIN}])([.,;:!?]+)(\\s|$)", r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        found = self._found(coded.dictionary.to_pylist())
        stock = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        n = size[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = stock[np.repeat(first[codes] - before[:-1], n) + np.arange(before[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, before[offsets[1:] - offsets[0]] - before[offsets[:-1] - offsets[0]]


def _by_words(spec: dict) -> bool:
    """Whether WordTokenizer can take a file's texts word by word: NFC, runs of white space and lower case for a normalizer, then pieces
    of letters, single numbers, other marks and some endings behind an apostrophe, then bytes, and BPE with ends of words."""
    ways, cut, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    parts = cut.get("pretokenizers") or [{}, {}]
    pattern = (parts[0].get("pattern") or {}).get("Regex", "")
    return (
        [w.get("type") for w in ways.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and ways["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and ways["normalizers"][1].get("content") == " "
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and all(x.startswith("'") for x in pattern.split("|")[:-3])
        and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
        and model["type"] == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("ignore_merges") and not model.get("dropout")
        and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or len(t["content"]) < 3 for t in spec.get("added_tokens", ()))
        and not any(re.match(f"[{LATIN}]|.*[.,;:!?]$", t["content"]) for t in spec.get("added_tokens", ()))
    )


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def write(df: DataFrame, path: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, block_docs: int = BLOCK_DOCS) -> None:
    """Encode every text, add end_id, and write the ids in ascending order of id_col to the folder path.

    Texts are dealt out by ranges of the id and sorted there, so one shuffle puts them in order; tokens are made after it and
    go straight into blocks. Rows of one id may be dealt to several ranges: they stand in the order of a hash of their texts,
    equal ones in any order. Null ids come first. A null or empty text is end_id alone. An empty table gives empty tables.
    Columns other than id_col and text_col are not read.
    """
    spark = df.sparkSession
    tokenizer_path = tokenizer_path or default_tokenizer()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.col("row")]
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        block = docs_before = ids_before = 0

        def closed(doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal block, docs_before, ids_before
            known = doc_ids.drop_null().to_numpy()
            row = (
                part, block, docs_before, ids_before, len(doc_ids), len(ids), doc_ids.null_count,
                int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None,
                encode(known), encode(np.cumsum(sizes)), tok.dtype.itemsize, ids.tobytes(),
            )
            block, docs_before, ids_before = block + 1, docs_before + len(doc_ids), ids_before + len(ids)
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[c.split()[1]]) for v, c in zip(row, BLOCKS.split(", "))], names)

        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def joined() -> pa.RecordBatch:
            out = closed(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = tok.encode_batch(batch.column("text"))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id), sizes + 1
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):  # up to the document that fills the block
                have = sum(len(h[1]) for h in held)
                start = int(ends[first - 1]) if first else 0
                last = min(int(np.searchsorted(ends, start + block_ids - have)), first + block_docs - 1 - sum(len(h[0]) for h in held), len(sizes) - 1)
                held.append((batch.column("doc_id")[first : last + 1], ids[start : ends[last]], sizes[first : last + 1]))
                if sum(len(h[1]) for h in held) >= block_ids or sum(len(h[0]) for h in held) >= block_docs:
                    yield joined()
                first = last + 1
        if held:
            yield joined()

    docs.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    # one row for each partition of the shuffle
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_docs"), F.sum("n_ids")).orderBy("part").collect()
    counts = np.array([r[1:] for r in totals], np.int64).reshape(-1, 2)
    before = np.cumsum(counts, 0) - counts
    rows = [(r[0], int(d), int(i)) for r, (d, i) in zip(totals, before)]
    spark.createDataFrame(rows, "part int, docs_before long, ids_before long").coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """blocks with first (ids before the block in all); parts has a row for each partition of the writing job, so it is broadcast."""
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("ids_before").alias("first"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(parts), "part")
    return blocks.withColumn("first", F.col("first") + F.col("ids_before"))


def _ids_of(batch: pa.RecordBatch, i: int) -> pa.Array:
    known = EliasFano(batch.column("doc_ids")[i].as_py()).all()
    return pa.concat_arrays([pa.nulls(batch.column("n_null")[i].as_py(), pa.int64()), pa.array(known)])


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document; the ids are not read."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, starts, sizes = [], [], []
            for i in range(batch.num_rows):
                ends = EliasFano(batch.column("ends")[i].as_py()).all()
                size = np.diff(ends, prepend=0)
                ids.append(_ids_of(batch, i))
                starts.append(batch.column("first")[i].as_py() + ends - size)
                sizes.append(size)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes))], ["doc_id", "start", "n_tokens"])

        return step

    return map_arrow(_blocks(spark, path).select("n_null", "doc_ids", "ends", "first"), make, "doc_id long, start long, n_tokens long")


def _rows(path: str, blocks: DataFrame, wanted: list[int] | None, whole: bool) -> DataFrame:
    """Rows of blocks' documents: all, or those of the ids wanted. With their ids, or with the ids' CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("ids")[i].as_py(), f"<u{batch.column('width')[i].as_py()}")
                code, doc_ids = EliasFano(batch.column("ends")[i].as_py()), _ids_of(batch, i)
                if wanted is None:
                    ends = code.all()
                    starts = np.concatenate([[0], ends[:-1]])
                else:
                    at = np.flatnonzero(pc.is_in(doc_ids, pa.array(wanted, pa.int64())).to_numpy(zero_copy_only=False))
                    doc_ids, ends = doc_ids.take(pa.array(at)), code.select(at)
                    starts = np.where(at > 0, code.select(np.maximum(at - 1, 0)), 0)
                if not len(doc_ids):
                    continue
                each = (raw[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist()))
                ids = pa.array(list(each), pa.binary()) if whole else pa.array([zlib.crc32(x) for x in each], pa.int64())
                first = batch.column("first")[i].as_py()
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first + starts), pa.array(ends - starts), ids], ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])

    prepare(blocks.sparkSession)
    last = "ids binary" if whole else "ids_crc32 long"
    return blocks.select("n_null", "doc_ids", "ends", "width", "ids", "first").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: start is the number of ids before it in all, ids are little-endian
    unsigned 32-bit numbers with the end id."""
    return _rows(path, _blocks(spark, path), None, True)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """read(), with the CRC-32 of the ids in their place."""
    return _rows(path, _blocks(spark, path), None, False)


def fetch(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """read() for a stated list of ids: blocks whose ids can't hold one are not decoded, and ends are found by select."""
    wanted = sorted({int(x) for x in doc_ids})
    if not wanted:
        return read(spark, path).limit(0)
    blocks = _blocks(spark, path).where((F.col("max_id") >= wanted[0]) & (F.col("min_id") <= wanted[-1]))
    (key,) = fresh(blocks, "wanted")
    held = F.exists(F.lit(wanted), lambda w: (w >= F.col("min_id")) & (w <= F.col("max_id")))
    return _rows(path, blocks.withColumn(key, held).where(key).drop(key), wanted, True)
