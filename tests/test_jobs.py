"""The runnable jobs: against plain Python, over growing input, and after a failure."""

import json
import logging
import os
import subprocess
import sys
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import mutation_profiles, running_rates

DOCS = "doc_id long, text string, lang string, source string"


def texts(seed, n):
    letters = "ACGTacgt xyz\n"
    return ["".join(letters[(seed * 7 + k * k + 3 * k * i) % len(letters)] for k in range(40 + i % 30)) for i in range(n)]


def plain(rows, c):
    """Profiles and histograms in plain Python."""
    reads = []
    for i, text, gene, sample in rows:
        s = "".join(x for x in (text or "").upper() if x in "ACGT")
        reads += [(str(i), sample or "none", gene or "none", s[k : k + c.length]) for k in range(0, len(s), c.length) if len(s[k : k + c.length]) >= c.share * c.length]
    counts = Counter((g, p, b) for _, _, g, s in reads for p, b in enumerate(s))
    ref = {(g, p): min("ACGT", key=lambda b: (-counts[g, p, b], b)) for g, p, _ in counts}
    profile, histogram = {}, Counter()
    for _, sample, g, s in reads:
        miss = [b != ref[g, p] for p, b in enumerate(s)]
        histogram[sample, g, sum(miss)] += 1
        if c.low < sum(miss) / len(s) < c.high:
            for p in range(sum(1 for x in ref if x[0] == g)):
                cov, mis = profile.get((sample, g, p), (0, 0))
                profile[sample, g, p] = (cov + (p < len(s)), mis + (p < len(s) and miss[p]))
    return profile, histogram, ref


def check_profiles(spark, out, rows, c):
    profile, histogram, ref = plain(rows, c)
    got = mutation_profiles.read_output(spark, out).collect()
    assert {(r.sample, r.gene, r.pos): (r.covered, r.mismatches) for r in got if r.kind == "profile"} == profile
    assert Counter({(r.sample, r.gene, r.n_mut): r.n_reads for r in got if r.kind == "histogram"}) == histogram
    assert all(r.base == ref[r.gene, r.pos] for r in got if r.kind == "profile")
    return got


def test_mutation_profiles(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    c = mutation_profiles.Config(length=12, share=0.5, low=0.0, high=0.8)
    rows = [(i, t, f"g{i % 2}", f"s{i % 3}") for i, t in enumerate(texts(1, 60))] + [(None, "acgtacgtacgt", None, ""), (7, None, "g0", "s0"), (8, "", "g0", "s0"), (8, "", "g0", "s0")]
    rows += [rows[3]] * 5
    source, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash")).repartition(3).write.parquet(source)
    done = mutation_profiles.run(spark, source, out, c)
    first = sorted(map(repr, check_profiles(spark, out, rows, c)))
    assert done["read"] == len(rows) and done["library"] == sum("kind='library'" in r for r in first) > 0
    mutation_profiles.run(spark, source, out, c)
    assert sorted(map(repr, mutation_profiles.read_output(spark, out).collect())) == first
    assert f"read {len(rows)} rows" in caplog.text and f"library has {done['library']} rows" in caplog.text
    # other partitions stay if only some samples are done again
    only = mutation_profiles.Config(length=12, share=0.5, low=0.0, high=0.8, samples=("s1",))
    spark.createDataFrame([], mutation_profiles.PROFILES).write.mode("overwrite").partitionBy("sample", "gene").parquet(f"{out}/profiles/sample=s1")  # lost
    assert mutation_profiles.run(spark, source, out, only) == done
    assert sorted(map(repr, mutation_profiles.read_output(spark, out).collect())) == first
    ids = [line for r in spark.read.text(f"{out}/consensus").collect() if (line := r.value).startswith(">")]
    assert sorted(ids) == [">g0", ">g1", ">none"]


def test_mutation_profiles_without_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, "a", "b")], DOCS).write.parquet(str(tmp_path / "d"))
    mutation_profiles.run(spark, str(tmp_path / "d"), str(tmp_path / "out"))
    assert mutation_profiles.read_output(spark, str(tmp_path / "out")).count() == 0


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(start, n):
    return [(k, datetime(2024, 1, 1 + k % 5, k % 24), k % 4, ["a", "b", None, ""][k % 4 if k % 7 else 2], [None, float("nan"), 25.0, 3.0, 20.0][k % 5], "{}") for k in range(start, start + n)]


def rates(rows):
    out = {}
    for _, ts, pos, gene, value, _ in rows:
        key = (str(ts.date()) if ts else "none", gene or "none", pos)
        cov, inf, mods = out.get(key, (0, 0, 0))
        known = value is not None and value == value and pos is not None
        out[key] = (cov + 1, inf + known, mods + (known and value > 20))
    return out


def found(spark, out):
    got = running_rates.read_output(spark, out).collect()
    assert all(r.rate == (r.mods / r.informative if r.informative else None) for r in got)
    result = {(r.day, r.gene, r.pos): (r.covered, r.informative, r.mods) for r in got}
    assert len(result) == len(got)
    return result


def test_running_rates_take_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, out, at = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))
    rows = events(0, 200)
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(source)
    c = running_rates.Config(files_per_batch=2)
    assert running_rates.run(spark, source, out, at, c) == 2
    assert found(spark, out) == rates(rows)
    assert running_rates.run(spark, source, out, at, c) == 0
    before = {r[0]: r[1] for r in spark.read.parquet(f"{out}/rates").select(F.col("_metadata.file_path"), F.col("day").cast("string")).distinct().collect()}
    # late rows for one old day, and a new one
    late = [(900, datetime(2024, 1, 2, 3), 1, "b", 50.0, ""), (901, None, None, "new", 30.0, "")]
    spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(source)
    caplog.clear()
    assert running_rates.run(spark, source, out, at, c) == 1
    assert "read 2 events" in caplog.text
    assert found(spark, out) == rates(rows + late)
    after = {r[0]: r[1] for r in spark.read.parquet(f"{out}/rates").select(F.col("_metadata.file_path"), F.col("day").cast("string")).distinct().collect()}
    assert {d for f, d in before.items() if f not in after} == {"2024-01-02"}


def test_running_rates_after_a_failure(spark, tmp_path, monkeypatch):
    source, out, at = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))
    rows = events(0, 90)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(source)
    replace = running_rates._replace

    def failing(df, path, *by):
        replace(df, path, *by)
        if path.endswith("counts"):
            raise OSError("lost")

    monkeypatch.setattr(running_rates, "_replace", failing)
    with pytest.raises(Exception, match="lost"):
        running_rates.run(spark, source, out, at)
    monkeypatch.setattr(running_rates, "_replace", replace)
    assert running_rates.run(spark, source, out, at) == 1
    assert found(spark, out) == rates(rows)


def test_configs(tmp_path):
    assert mutation_profiles.Config.load(mutation_profiles.DEFAULT) == mutation_profiles.Config()
    assert running_rates.Config.load(running_rates.DEFAULT) == running_rates.Config()
    bad = tmp_path / "bad.json"
    for job in (mutation_profiles, running_rates):
        bad.write_text(json.dumps({"lenght": 1}))
        with pytest.raises(ValueError, match="lenght"):
            job.Config.load(str(bad))


def test_command_lines(spark, tmp_path):

    spark.createDataFrame([(i, t, "g", "s") for i, t in enumerate(texts(2, 30))], DOCS).write.parquet(str(tmp_path / "documents"))
    spark.createDataFrame(events(0, 50), EVENTS).write.parquet(str(tmp_path / "events"))
    (tmp_path / "c.json").write_text(json.dumps({"length": 10, "share": 0.5, "high": 0.9}))
    for job, more in (("mutation_profiles", ["--input", "documents", "--config", "c.json"]), ("running_rates", ["--input", "events", "--checkpoint", "at"])):
        root = str(Path(__file__).resolve().parents[1])
        got = subprocess.run([sys.executable, "-m", f"jobs.{job}", *more, "--output", job], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
        assert got.returncode == 0, got.stderr
        assert "wrote" in got.stderr
    assert mutation_profiles.read_output(spark, str(tmp_path / "mutation_profiles")).where("kind = 'profile'").count() == 10
    assert found(spark, str(tmp_path / "running_rates")) == rates(events(0, 50))
