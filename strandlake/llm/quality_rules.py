"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Each rule votes good (g), bad (b) or abstains (-). The votes of one document are a pattern; EM over the counts of all patterns
(at most 3 to the number of rules) estimates the share of good documents and, for each rule, how often its votes are bad on good
and on bad documents. A rule that abstains says nothing. The estimates give each pattern its posterior probability of being good.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts

_upper = bytes(range(65, 91))
_lower = bytes(range(97, 123))
_not_letters = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122) and c not in b" \t\n\v\f\r")
_marks = [bytes([c]) * 3 for c in b"#*$%&|<>=_~^"]


def measures(text: str | None) -> dict[str, int]:
    """Counts over a whole text's words (runs without the space and the characters 9 to 13) and lines."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, seen, dup = raw.split(b"\n"), set(), 0
    n_lines = 0
    for line in lines:
        if line.strip():
            n_lines += 1
            dup += line in seen
            seen.add(line)
    triples = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(triples)) < len(triples):
        times = Counter(triples)
        reach = 0
        for i, t in enumerate(triples):
            if times[t] > 1:
                repeat += i + 3 - max(reach, i)
                reach = i + 3
    kinds = Counter(words) if len(words) > 1 else {}
    bare = raw.translate(None, _not_letters).split()  # letters, and all bytes beyond ASCII
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, " \t\n\v\f\r")),
        "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "n_lines": n_lines,
        "n_bytes": sum(map(len, words)),
        "n_letters": sum(map(len, bare)),
        "n_bare": len(bare),
        "n_runs": sum(map(raw.count, _marks)),
        "n_upper": len(raw) - len(raw.translate(None, _upper)),
        "n_lower": len(raw) - len(raw.translate(None, _lower)),
        "n_bangs": raw.count(b"!"),
        "n_stops": raw.count(b".") + raw.count(b"?"),
        "n_kinds": len(kinds) or len(words),
        "n_top": max(kinds.values(), default=len(words)),
    }


MEASURES = list(measures(""))


def _rising(top: str, bottom: str, good: float, bad: float) -> Callable[[dict], np.ndarray]:
    """Votes good up to `good` per unit, bad from `bad` on; between them, or with nothing to divide by, it abstains."""

    def vote(m: dict[str, np.ndarray]) -> np.ndarray:
        rate = m[top] / np.maximum(m[bottom], 1)
        return np.where(m[bottom] == 0, -1, np.where(rate <= good, 1, np.where(rate >= bad, 0, -1)))

    return vote


def _falling(top: str, bottom: str, good: float, bad: float) -> Callable[[dict], np.ndarray]:
    """Votes good from `good` per unit on, bad under `bad`."""

    def vote(m: dict[str, np.ndarray]) -> np.ndarray:
        rate = m[top] / np.maximum(m[bottom], 1)
        return np.where(m[bottom] == 0, -1, np.where(rate >= good, 1, np.where(rate < bad, 0, -1)))

    return vote


def _word_length(m: dict[str, np.ndarray]) -> np.ndarray:
    mean = m["word_chars"] / np.maximum(m["n_words"], 1)
    return np.where(m["n_words"] == 0, 0, np.where((mean >= 3) & (mean <= 10), 1, np.where((mean < 2) | (mean > 14), 0, -1)))


def _variety(m: dict[str, np.ndarray]) -> np.ndarray:
    share = m["n_kinds"] / np.maximum(m["n_words"], 1) ** 0.85
    return np.where(m["n_words"] < 50, -1, np.where(share >= 0.8, 1, np.where(share < 0.35, 0, -1)))


def _sentences(m: dict[str, np.ndarray]) -> np.ndarray:
    per = m["n_words"] / np.maximum(m["n_stops"], 1)
    return np.where(m["n_words"] < 20, -1, np.where(per <= 30, 1, np.where(per > 80, 0, -1)))


#: Each rule has a view of its own: what words are made of, whether they are words, runs of one mark, words that prevail, and so on.
RULES: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "letters": _falling("n_letters", "n_bytes", 0.88, 0.78),
    "bare_words": _falling("n_bare", "n_words", 0.95, 0.8),
    "mark_runs": _rising("n_runs", "n_words", 0.005, 0.05),
    "top_word": _rising("n_top", "n_words", 0.15, 0.3),
    "same_lines": _rising("n_dup_lines", "n_lines", 0.0, 0.3),
    "repeats": _rising("n_repeat_words", "n_words", 0.1, 0.35),
    "capitals": _rising("n_upper", "n_lower", 0.15, 1.0),
    "bangs": _rising("n_bangs", "n_words", 0.02, 0.2),
    "word_length": _word_length,
    "variety": _variety,
    "sentences": _sentences,
}


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures (long) and the votes (string: one character g, b or - for each rule) of each row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measures(t) for t in texts(batch)]
            m = {k: np.array([r[k] for r in rows], np.int64) for k in MEASURES}
            votes = np.stack([rule(m) for rule in RULES.values()], axis=1)
            marks = np.array(["b", "g", "-"])[votes]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(m[k]) for k in MEASURES], pa.array(["".join(x) for x in marks])], ["doc_id", *MEASURES, "votes"]
            )

        return step

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES) + ", votes string"
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, schema)


#: Beta priors, as counts of bad and good votes, of a rule's share of bad votes: on bad documents nothing is assumed but that it
#: is no certainty, on good ones that bad votes are rare, with the weight of so many documents.
PRIOR = {"bad": (1.0, 1.0), "good": (0.5, 49.5)}
#: Prior counts of bad and good documents.
PRIOR_SHARE = (1.0, 1.0)


def posterior(votes: np.ndarray, good: float, rates: np.ndarray) -> np.ndarray:
    """Probabilities (pattern, class: bad and good) of patterns of votes (pattern, rule: 1 bad, 0 good, -1 abstains); rates:
    (class, rule), shares of bad votes."""
    like = np.log([1 - good, good]) + (votes == 1) @ np.log(rates).T + (votes == 0) @ np.log(1 - rates).T
    post = np.exp(like - like.max(1, keepdims=True))
    return post / post.sum(1, keepdims=True)


def fit(patterns: dict[str, int], rounds: int = 1000, tolerance: float = 1e-9) -> tuple[dict[str, float], dict]:
    """EM over the counts of vote patterns. Returns each pattern's posterior of good, and the estimates: the share of good
    documents and, for each rule, the shares of bad votes among its votes on bad and on good documents.

    It starts from the patterns with a bad vote against those without and ends when the share of good documents moves by less
    than the tolerance. The M-step takes the means of the Beta posteriors under PRIOR. No patterns: an empty result.
    """
    if not patterns:
        return {}, {"good": None, "rules": {}}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    votes = np.array([[{"b": 1, "g": 0, "-": -1}[c] for c in k] for k in keys])
    prior = np.array([PRIOR["bad"], PRIOR["good"]])
    suspect = np.array([0.9 if "b" in k else 0.1 for k in keys])
    post, good = np.stack([suspect, 1 - suspect], 1), -1.0
    for _ in range(rounds):
        w = post * n[:, None]
        good, before = float((w[:, 1].sum() + PRIOR_SHARE[1]) / (n.sum() + sum(PRIOR_SHARE))), good
        bad_votes, good_votes = w.T @ (votes == 1) + prior[:, :1], w.T @ (votes == 0) + prior[:, 1:]
        rates = bad_votes / (bad_votes + good_votes)
        post = posterior(votes, good, rates)
        if abs(good - before) < tolerance:
            break
    rules = {name: {"bad": float(rates[0, i]), "good": float(rates[1, i])} for i, name in enumerate(RULES)}
    return dict(zip(keys, post[:, 1].tolist())), {"good": good, "rules": rules}


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, measures, votes, posterior (double), base_failed and kept (boolean), one row for each row of df.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed and
    posterior >= threshold. Null texts count as empty, so base_failed; null and repeated ids are kept as they are; an empty
    table gives no rows. EM counts all rows that base_failed leaves; only the counts of distinct patterns reach the driver.
    """
    rows, _ = materialize(measured(df, id_col, text_col), "measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    seen = rows.groupBy("votes").agg(F.sum(F.when(failed, 0).otherwise(1)).alias("n")).collect()  # at most 3 ** len(RULES)
    found, _ = fit({r["votes"]: r["n"] for r in seen})
    table = df.sparkSession.createDataFrame(sorted(found.items()), "votes string, posterior double")
    out = rows.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
