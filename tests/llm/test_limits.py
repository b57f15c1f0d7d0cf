"""Operators at the limits of their inputs: very many words, repeats, repeated labelled rows, very long texts."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontamination, language_id, quality_crf, toxicity


def brute(items, words, size):
    """Word positions in windows of items, and the items that have one there."""
    hit, owners = set(), set()
    for name, text in items:
        w = decontamination.words_of(text)
        n = min(size, len(w))
        if not n:
            continue
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                owners.add(name)
    return hit, owners


@pytest.mark.parametrize("most_codes", [decontamination.MOST_CODES, 3])
@pytest.mark.parametrize("size", [13, 7, 3])
def test_hits_with_one_or_two_characters_a_word(most_codes, size):
    rng = np.random.default_rng(5)
    for kinds in (2, 5, 40):
        words = [f"w{k}" for k in range(kinds)]
        draw = lambda n: " ".join(rng.choice(words, n))
        items = [(str(k), draw(int(rng.integers(0, 60)))) for k in range(12)] + [("same", "w1 " * 50), ("null", None)]
        scanner = decontamination.Scanner(decontamination.build(items, size, most_codes))
        for text in (draw(400), items[3][1] + " x " + items[5][1], "w1 " * 200, "", items[0][1][:20]):
            line = decontamination.words_of(text)
            spans, owners = scanner.hits(line)
            assert ({k for a, b in spans for k in range(a, b)}, owners) == brute(items, line, size)


def test_items_with_more_words_than_characters():
    n = 1_200_000
    index = decontamination.build([("long", " ".join(map(str, range(n)))), ("short", "1 2 x")])
    assert index.unit == 2
    scanner = decontamination.Scanner(index)
    text = " ".join(map(str, [*range(500_000, 500_020), 7, 8, *range(n - 13, n), 1, 2])) + " x"
    spans, owners = scanner.hits(decontamination.words_of(text))
    assert {k for a, b in spans for k in range(a, b)} == {*range(20), *range(22, 38)} and owners == {"long", "short"}


def test_repeated_words_take_linear_time():
    scanner = decontamination.Scanner(decontamination.build([("a", "a " * 2000), ("b", "b a " * 500 + "a " * 20)]))
    start = time.time()
    spans, owners = scanner.hits([b"a"] * 200_000)
    assert time.time() - start < 5
    assert len(spans) > 0 and min(a for a, _ in spans) == 0 and max(b for _, b in spans) == 200_000 and owners == {"a", "b"}


def labelled(spark, n=50_000):
    docs = spark.createDataFrame([(1, "good words here\nand more of them"), (2, "you idiot scum"), (3, "plain text about a river\nwith lines")], "doc_id long, text string")
    many = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("good words here\nand more of them").alias("text"))
    return docs.unionByName(many), spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 1)], "doc_id long, toxic int, quality int")


def test_a_labelled_row_that_stands_very_often_is_learned_once(spark):
    docs, labels = labelled(spark)
    got = toxicity.sample(docs, labels, rows=10).collect()
    assert len(got) == len({r.text for r in got}) <= 3
    assert len(quality_crf._sample(docs, labels, "doc_id", "text", "quality", 10)) <= 3
    # different texts of one id are bounded too
    versions = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("version "), F.col("id").cast("string")).alias("text"))
    assert toxicity.sample(versions, labels, rows=10).count() <= 20
    assert len(quality_crf._sample(versions, labels, "doc_id", "text", "quality", 10)) <= 10


def test_samples_are_bounded_in_bytes(spark):
    long = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word and more\n"), 70_000)).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(12).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), (F.col("id") % 2).cast("int").alias("quality"))
    assert sum(len(r.text) for r in toxicity.sample(long, labels, rows=12, most_bytes=3_000_000).collect()) <= 6_000_000
    assert sum(own.nbytes for _, own, _ in quality_crf._sample(long, labels, "doc_id", "text", "quality", 12, 2_000_000)) < 40_000_000
    model = language_id.fit(long, rows=40, steps=3, hidden=4, most_chunks=50)
    assert model.languages == ["en"]
