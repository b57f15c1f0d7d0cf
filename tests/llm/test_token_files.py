"""Elias-Fano codes and files of token ids, against plain arrays and the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm import elias_fano, op11_token_files, token_files

EDGE = 2**63 - 1
SPACES = "".join(map(chr, [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF]))
ODD = [
    None, "", " \n\t ", "word", "Ä ß é 日本 👍🏽 ΣΑΣ İ", "é ́e", f"a{'b'.join(SPACES)}c", "x" * 100_000, "word, " * 30_000, "\x1cA\x00b c",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>. Straße, ÉTÉ! ÿ? über:;", "a.,\u0301 b.\u0301 c,", "".join(map(chr, range(0xA0, 0x250))), "it's IT'S don't 'll", "1234 ½ ² 12,5",
]


@given(st.lists(st.one_of(st.integers(0, 50), st.integers(-EDGE - 1, EDGE)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_gives_values_back(values):
    values = np.sort(np.array(values, np.int64))
    code = elias_fano.EliasFano(elias_fano.encode(values))
    assert len(code) == len(values) and code.all().tolist() == values.tolist()
    assert [code.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    assert code.select(np.arange(len(values))[::-1]).tolist() == values[::-1].tolist()


def test_elias_fano_is_small_and_strict():
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 2000, 50_000))
    data = elias_fano.encode(ends)
    least = 2 + np.log2(ends[-1] / len(ends))  # bits a value
    assert 8 * len(data) / len(ends) < least + 0.5 < 64 / 4
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        elias_fano.EliasFano(data).select(50_000)
    with pytest.raises(IndexError):
        elias_fano.EliasFano(elias_fano.encode(np.array([], np.int64))).select(0)


def whole(texts):
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_words_have_the_ids_of_whole_texts():
    import pyarrow as pa

    tok = token_files.WordTokenizer(token_files.default_tokenizer())
    assert tok.by_words
    latin = [chr(c) for c in range(0x21, 0x180)]
    pairs = [f"{a}{b} {b}{a}{b}." for a in latin for b in latin[::7]]
    for texts in (ODD, ODD[::-1], [f"a{c}b {c}'s{c} ́{c}1" for c in SPACES], pairs, pairs):
        ids, sizes = tok.encode_batch(pa.array(texts, pa.string()))
        cuts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [c.tolist() + [1] for c in cuts] == whole(texts)
    other = token_files.WordTokenizer(token_files.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k"))
    assert not other.by_words
    ids, sizes = other.encode_batch(pa.array(["a  b", None, "c"]))
    assert sizes.tolist() == [len(other.whole.encode(t).ids) for t in ("a  b", "", "c")]


def expected(rows):
    out, start = [], 0
    for i, ids in rows:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [{}, {"block_docs": 2}, {"block_ids": 40}])
def test_files_hold_every_text_in_order(spark, tmp_path, size):
    ids = [None, 7, -5, 7, 7, 2**40, 3, 0, 1, 2**62, -(2**62), 11, 12, 13, 14]
    rows = [(i, t, 9, b"x", 1) for i, t in zip(ids, ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, ids binary, row int").repartition(5)
    token_files.write(docs.coalesce(1), str(tmp_path / "t"), **size)
    got = token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = {(i, tuple(x)) for i, x in zip(ids, whole(ODD))}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got} == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    brief = {(r.doc_id, r.start, r.n_tokens) for r in got}
    assert {tuple(r) for r in token_files.offsets(spark, str(tmp_path / "t")).collect()} == brief
    some = token_files.fetch(spark, str(tmp_path / "t"), [7, 2**62, 99]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in got if r.doc_id in (7, 2**62))
    assert token_files.fetch(spark, str(tmp_path / "t"), []).count() == 0


def test_query_over_repeated_rows_and_empty_tables(spark, tmp_path):
    texts = ["a b c"] * 40 + ["d"] * 40
    docs = spark.createDataFrame([(1 if k < 60 else 2, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op11_token_files.query(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert len(got) == 80 and [r[0] for r in got] == [1] * 60 + [2] * 20
    abc, d = whole(["a b c", "d"])
    first = got[0][2] == len(abc)
    runs = [(1, abc)] * 40 + [(1, d)] * 20 if first else [(1, d)] * 20 + [(1, abc)] * 40
    assert got == expected(runs + [(2, d)] * 20)
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert op11_token_files.query(spark, str(tmp_path / "none")).count() == 0
