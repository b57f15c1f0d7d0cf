"""Bernoulli mixtures over sparse reads: EM with restarts, a hierarchical Beta prior, variational Bayes, and EM with a correction
for reads in which close mutations are never seen.

Every model is a set of weights: the log-likelihood of a read under cluster k is const_k plus the sum of w_k over its modified
positions. One pass over the distinct position sets (with their numbers of reads) computes posteriors and sums them by
position; only clusters x positions numbers of each task come to the driver, whatever the number of reads, and nothing is chained
from one iteration to the next. Restarts share the passes: (run, cluster) is the key of the sums, and runs that have ended drop out, so
many runs take the jobs of the longest one.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.stats import digamma
from strandlake.sources.scratch import scratch_path

EPS = 1e-308


def position_sets(reads: DataFrame, mods: DataFrame) -> DataFrame:
    """(p, weight): distinct arrays of modified positions (0-based) and how many reads have each; reads without one too."""
    lists = mods.groupBy("read_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("p"))
    sets = reads.select("read_id").join(lists, "read_id", "left")
    return sets.groupBy(F.coalesce("p", F.array().cast("array<int>")).alias("p")).agg(F.count("*").alias("weight"))


def kept_sets(sets: DataFrame) -> DataFrame:
    """sets, cached for many passes in partitions by their bytes. They are written first: what is cached behind a shuffle keeps all of its
    partitions (200, by default), each of them a Python task of every pass, however few the sets."""
    path = scratch_path(sets.sparkSession, "position-sets")
    sets.write.parquet(path)
    return sets.sparkSession.read.schema(sets.schema).parquet(path).cache()


@dataclass
class Weights:
    const: np.ndarray  # K
    by_pos: np.ndarray  # K x D

    @classmethod
    def of(cls, mu: np.ndarray, pi: np.ndarray) -> Weights:
        off = np.log(1 - mu + EPS)
        return cls(np.log(pi) + off.sum(1), np.log(mu + EPS) - off)


@dataclass
class LocalSets:
    """Few position sets, held by the driver: set number and position of each modification, and the sets' weights."""

    row: np.ndarray
    pos: np.ndarray
    weight: np.ndarray

    def em_pass(self, weights: Weights) -> Sums:
        k_all, d = weights.by_pos.shape
        n = len(self.weight)
        ll = np.stack([np.bincount(self.row, w[self.pos], n) + c for w, c in zip(weights.by_pos, weights.const)])
        total = np.logaddexp.reduce(ll, axis=0)
        post = np.exp(ll - total) * self.weight
        counts = np.stack([np.bincount(self.pos, p[self.row], d) for p in post])
        return Sums(counts, post.sum(1), float((post * ll).sum()), float((self.weight * total).sum()))


#: Modifications in distinct position sets up to which EM of spaced mutations, with its hundreds of passes, runs on the driver (about 100 MB of numbers for each four clusters).
LOCAL_MODS = 2_000_000


def gathered(sets: DataFrame, most: int = LOCAL_MODS) -> LocalSets | None:
    """The sets on the driver if their counted modifications and rows are at most `most`, else None."""
    rows, mods = sets.agg(F.count("*"), F.sum(F.size("p"))).first()
    if rows > most or (mods or 0) > most:
        return None
    t = sets.select("p", "weight").toArrow()
    p = t.column("p").combine_chunks()
    sizes = np.asarray(p.value_lengths())
    return LocalSets(np.repeat(np.arange(len(sizes)), sizes), np.asarray(p.flatten()).astype(np.int64), t.column("weight").to_numpy().astype(float))


@dataclass
class Sums:
    counts: np.ndarray  # K x D: posterior-weighted modifications
    totals: np.ndarray  # K: posterior-weighted reads
    complete: float  # sum of posterior times log-likelihood
    marginal: float  # sum of log of summed likelihoods


def _literal(values: np.ndarray) -> Column:
    return F.from_json(F.lit(json.dumps([float(x) for x in values])), "array<double>")


def log_likelihoods(weights: Weights) -> Column:
    """Array of K log-likelihoods of a row's positions p."""

    def one(k: int) -> Column:
        w = _literal(weights.by_pos[k])
        return F.lit(float(weights.const[k])) + F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.get(w, x))

    return F.array(*[one(k) for k in range(len(weights.const))])


def posteriors(sets: DataFrame, weights: Weights) -> DataFrame:
    """sets with ll (array), total (log of summed likelihoods) and post (array)."""
    t = sets.withColumn("ll", log_likelihoods(weights))
    top = F.array_max("ll")
    t = t.withColumn("total", top + F.log(F.aggregate("ll", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("ll")))))
    return t.withColumn("post", F.transform("ll", lambda x: F.exp(x - F.col("total"))))


def predicted(sets: DataFrame, weights: Weights) -> DataFrame:
    """posteriors with cluster: the most likely one, the first of several."""
    return posteriors(sets, weights).withColumn("cluster", (F.array_position("post", F.array_max("post")) - 1).cast("long"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch of (p, weight): its sets by their size, the positions of each size as size x sets numbers."""
    for b in batches:
        size, flat, weight = pc.list_value_length(b.column("p")).to_numpy(), b.column("p").flatten().to_numpy(), b.column("weight").to_numpy().astype(float)
        order, start, (kinds, n) = np.argsort(size, kind="stable"), np.cumsum(size) - size, np.unique(size, return_counts=True)
        rows = np.split(order, np.cumsum(n)[:-1])
        p = [flat[start[r] + np.arange(k)[:, None]].ravel() for k, r in zip(kinds, rows)]
        numbers = [np.stack([kinds, n], 1).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *p]).astype(np.int32), weight[order]]
        yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in numbers), pa.array([weight.sum()]), pa.array([float(weight @ size)])], ["sizes", "p", "weight", "n", "ones"])


def packed_sets(sets: DataFrame) -> DataFrame:
    """sets (p, weight) for em_passes(): a row holds an Arrow batch of them as three columns of numbers, with n and ones, the numbers of
    reads and of their modifications. So what a pass takes from Spark are a few long values, not a row for each set."""
    return sets.select("p", "weight").mapInArrow(_packed, "sizes binary, p binary, weight binary, n double, ones double")


def kept_packed(sets: DataFrame) -> DataFrame:
    """packed_sets(), written and cached as kept_sets() are."""
    return kept_sets(packed_sets(sets))


#: Numbers of one task's sums up to which they come to the driver from each task of a pass; larger ones are summed in a shuffle first.
TASK_SUMS = 8192


def em_passes(sets: DataFrame, weights: list[Weights]) -> list[Sums]:
    """One E-step of several runs, with the sums that any M-step needs; sets: (p, weight), or packed_sets() of them.

    A task adds up its sets for each (run, cluster), all sets of a batch with the same number of positions together, by what the
    positions are and not by all that there might be. It sends runs x clusters x positions numbers.
    """
    runs, (k_all, d) = len(weights), weights[0].by_pos.shape
    by_pos, const = np.concatenate([w.by_pos for w in weights]), np.concatenate([w.const for w in weights])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # behind the positions stand reads, complete and marginal likelihood
        sums = np.zeros((runs * k_all, d + 3))
        for b in batches:
            for sizes, p, weight in zip(*(b.column(c).to_pylist() for c in ("sizes", "p", "weight"))):
                flat, weight, parts, at, row = np.frombuffer(p, np.int32).astype(np.intp), np.frombuffer(weight), [], 0, 0
                for k, n in np.frombuffer(sizes, np.int64).reshape(-1, 2).tolist():
                    parts.append((k, slice(row, row + n), flat[at : at + k * n]))
                    at, row = at + k * n, row + n
                ll = np.empty((runs * k_all, row))
                for k, rows, pos in parts:
                    for r, w in enumerate(by_pos):
                        ll[r, rows] = const[r] + w[pos.reshape(k, rows.stop - rows.start)].sum(0)
                ll = ll.reshape(runs, k_all, row)
                top = ll.max(1, keepdims=True)
                total = top + np.log(np.exp(ll - top).sum(1, keepdims=True))
                post = np.exp(ll - total) * weight
                each = post.reshape(runs * k_all, row)
                for k, rows, pos in parts:
                    if k:
                        for r in range(len(each)):
                            sums[r, :d] += np.bincount(pos, np.tile(each[r, rows], k), d)
                sums[:, d] += each.sum(1)
                sums[:, d + 1] += (post * ll).reshape(runs * k_all, row).sum(1)
                sums[::k_all, d + 2] += (total[:, 0] * weight).sum(1)
        key, pos = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(sums[key, pos])], ["key", "pos", "v"])

    found = (sets if "sizes" in sets.columns else packed_sets(sets)).select("sizes", "p", "weight").mapInArrow(run, "key int, pos int, v double")
    if runs * k_all * (d + 3) > TASK_SUMS:
        found = found.groupBy("key", "pos").agg(F.sum("v").alias("v"))
    found = found.toArrow()
    sums = np.zeros((runs * k_all, d + 3))
    np.add.at(sums, (found.column("key").to_numpy(), found.column("pos").to_numpy()), found.column("v").to_numpy())
    each = sums.reshape(runs, k_all, d + 3)
    return [Sums(e[:, :d], e[:, d], float(e[:, d + 1].sum()), float(e[:, d + 2].sum())) for e in each]


def em_pass(sets: DataFrame | LocalSets, weights: Weights) -> Sums:
    """em_passes() of one run."""
    return sets.em_pass(weights) if isinstance(sets, LocalSets) else em_passes(sets, [weights])[0]


def bic(n: float, clusters: int, length: int, ll: float) -> float:
    return math.log(n) * (length + 1) * clusters - 2 * ll


@dataclass
class Mixture:
    mu: np.ndarray
    pi: np.ndarray
    ll: float
    bic: float
    trace: list[tuple[int, float, float]] = field(default_factory=list)  # iteration, ll, change
    converged: bool = True  # ended by its rule, not by the limit of iterations

    @property
    def weights(self) -> Weights:
        return Weights.of(self.mu, self.pi)


def hashed_start(clusters: int, length: int) -> np.ndarray:
    """Starting rates that any engine can compute."""
    p, k = np.arange(length)[None, :], np.arange(clusters)[:, None]
    return 0.02 + 0.2 * ((p * 31 + k * 17) % 97) / 97


def beta_prior(cells: float, ones: float) -> tuple[float, float]:
    """alpha and beta of the hierarchical prior, in closed form; undefined without ones or without zeros."""
    n, c = float(cells), float(ones)
    b0 = (n + math.sqrt(n * n - 4 * c * (n - c))) / (2 * c)
    a0 = ((b0 - c + n) + math.sqrt((b0 * c + n) ** 2 + 4 * c * (c - n) * b0)) / (2 * (n - c))
    x = (n - c) * a0 + c
    beta = (x + math.sqrt(x * x - 4 * c * (n - c) * a0)) / (2 * c)
    y = c * beta + n
    return (y + math.sqrt(y * y + 4 * c * beta * (c - n))) / (2 * (n - c)), beta


def maximised(sums: Sums, prior: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    a, b = prior or (1.0, 1.0)
    mu = (sums.counts + a - 1) / np.maximum(sums.totals[:, None] + a + b - 2, 1e-300)
    return np.clip(mu, 0.0, 1.0), sums.totals / sums.totals.sum()


def fit(
    sets: DataFrame, clusters: int, length: int, runs: int = 1, threshold: float = 0.5, min_iters: int = 20, max_iters: int = 1000, seed: int = 386, hierarchical: bool = False, starts: list[np.ndarray] | None = None
) -> Mixture:
    """The run of least BIC. Starts are drawn from Beta(1.5, 20) for each of `runs`, or given as clusters x length rates; a run ends
    when the likelihood changes by less than the threshold after min_iters, or at max_iters (min_iters at least) with converged False.
    sets is written and cached meanwhile; all runs take their passes together. Needs at least one read."""
    sets = kept_packed(sets)
    max_iters = max(max_iters, min_iters)
    try:
        n, ones = sets.agg(F.sum("n"), F.sum("ones")).first()
        if not n:
            raise ValueError("no reads")
        prior = beta_prior(n * length, ones) if hierarchical else None
        if starts is None:
            starts = [np.random.default_rng([seed, run]).beta(1.5, 20, (clusters, length)) for run in range(runs)]
        mu, pi = list(starts), [np.full(clusters, 1 / clusters)] * len(starts)
        traces: list[list[tuple[int, float, float]]] = [[] for _ in starts]
        done = [False] * len(starts)
        for i in range(1, max_iters + 1):
            active = [r for r, ended in enumerate(done) if not ended]
            if not active:
                break
            for r, sums in zip(active, em_passes(sets, [Weights.of(mu[r], pi[r]) for r in active])):
                mu[r], share = maximised(sums, prior)
                pi[r] = np.maximum(share, 1e-300)
                change = sums.complete - (traces[r][-1][1] if traces[r] else 0.0)
                traces[r].append((i, sums.complete, change))
                done[r] = i >= min_iters and abs(change) < threshold
        found = [Mixture(mu[r], pi[r], t[-1][1], bic(n, clusters, length, t[-1][1]), t, done[r]) for r, t in enumerate(traces)]
        return min(found, key=lambda m: m.bic)
    finally:
        sets.unpersist()


def fit_variational(sets: DataFrame, clusters: int, length: int, updates: int = 1000, tolerance: float = 1e-6, seed: int = 386) -> Mixture:
    """Variational Bayes with Dirichlet(1e-5) weights and Beta(1/2, 1/2) rates; the same passes with expected log rates."""
    sets = kept_packed(sets)
    try:
        n, done = sets.agg(F.sum("n")).first()[0], False
        start = np.random.default_rng(seed).beta(1.5, 20, (clusters, length))
        sums, before = em_pass(sets, Weights.of(start, np.full(clusters, 1 / clusters))), None
        for _ in range(updates):
            a, b = 0.5 + sums.counts, 0.5 + sums.totals[:, None] - sums.counts
            both, share = digamma(a + b), 1e-5 + sums.totals
            e_log, e_off = digamma(a) - both, digamma(b) - both
            sums = em_pass(sets, Weights(digamma(share) - digamma(share.sum(keepdims=True)) + e_off.sum(1), e_log - e_off))
            if done := before is not None and np.abs(sums.totals - before).max() < tolerance * n:
                break
            before = sums.totals.copy()
        mu, pi = sums.counts / np.maximum(sums.totals[:, None], 1e-300), np.maximum(sums.totals / sums.totals.sum(), 1e-300)
        return Mixture(mu, pi, sums.marginal, bic(n, clusters, length, sums.marginal), converged=bool(done))
    finally:
        sets.unpersist()


# --- reads in which mutations closer than `gap` are never seen ----------------------------------------------------------


def _quiet(mu: np.ndarray, gap: int) -> np.ndarray:
    """For every position, the probability of no mutation at the gap - 1 positions after it."""
    off = np.concatenate([1 - mu, np.ones(gap)])
    out = np.ones(len(mu))
    for k in range(1, gap):
        out *= off[k : k + len(mu)]
    return out


def spaced_probability(mu: np.ndarray, gap: int = 4) -> np.ndarray:
    """For every position, the probability that from there on no two mutations are closer than gap; entry 0 is for a whole
    read, the entries past the end are 1."""
    d = [1.0] * (len(mu) + gap)
    on, off = (mu * _quiet(mu, gap)).tolist(), (1 - mu).tolist()
    for i in range(len(mu) - 1, -1, -1):
        d[i] = off[i] * d[i + 1] + on[i] * d[i + gap]
    return np.array(d)


def spaced_means(mu: np.ndarray, gap: int = 4) -> np.ndarray:
    """Expected rate of every position among reads without close mutations: of the position, quiet places next to it on either side,
    and no close mutations beyond these."""
    n = len(mu)
    after, before = spaced_probability(mu, gap), spaced_probability(mu[::-1], gap)
    right = _quiet(mu, gap) * after[gap : gap + n]
    left = (_quiet(mu[::-1], gap) * before[gap : gap + n])[::-1]
    return mu * left * right / after[0]


def solve_spaced(target: np.ndarray, gap: int = 4, rounds: int = 1000, tolerance: float = 1e-10, start: np.ndarray | None = None) -> np.ndarray:
    """Rates whose spaced_means are the target, by damped fixed-point steps on the odds, kept within (0, 1), from start or else the
    target on. Targets that no rates have (they need more mutations than the gap allows) end with a warning and the last step."""
    target = np.clip(target, 0, 1 - 1e-9)
    mu = target.copy() if start is None else np.where(target > 0, np.maximum(start, 1e-12), 0.0)
    for _ in range(rounds):
        now = spaced_means(mu, gap)
        ratio = np.where(now > 0, target / np.maximum(now, 1e-300), 1.0)
        new = np.clip(mu * ratio**0.8, 0, 1 - 1e-9)
        if np.abs(new - mu).max() < tolerance:
            return new
        mu = new
    warnings.warn(f"solve_spaced: not settled after {rounds} rounds", stacklevel=2)
    return mu


def fit_spaced(sets: DataFrame, max_clusters: int, length: int, runs: int = 10, cutoff: float = 0.5, min_iters: int = 300, max_iters: int = 1000, gap: int = 4, seed: int = 386, local_mods: int = LOCAL_MODS) -> list[Mixture]:
    """EM for 1, 2, ... clusters while the BIC falls; each result is the run of the largest likelihood.

    Likelihoods are over the probability of a read without close mutations, and BIC counts the distinct position sets. A run
    ends when, past min_iters, the likelihood rises by the cutoff at most. One cluster takes one run of at most 10 iterations.
    """
    sets = kept_sets(sets)
    try:
        distinct, passed = sets.count(), gathered(sets, local_mods) or sets
        out: list[Mixture] = []
        for clusters in range(1, max_clusters + 1):
            best: Mixture | None = None
            for run in range(1 if clusters == 1 else runs):
                rng = np.random.default_rng([seed, clusters, run])
                mu, pi, before, trace = rng.beta(1.5, 20, (clusters, length)), np.full(clusters, 1 / clusters), -np.inf, []
                least, most, done = (0, 10, False) if clusters == 1 else (min_iters, max(min_iters, max_iters), False)
                for i in range(1, most + 1):
                    w = Weights.of(mu, pi)
                    w.const = w.const - np.log([spaced_probability(m, gap)[0] for m in mu])
                    sums = em_pass(passed, w)
                    means, share = maximised(sums)
                    mu, pi = np.stack([solve_spaced(m, gap, start=x) for m, x in zip(means, mu)]), np.maximum(share, 1e-300)
                    trace.append((i, sums.marginal, sums.marginal - before))
                    if done := i >= least and sums.marginal - before <= cutoff:
                        break
                    before = sums.marginal
                ll = trace[-1][1]
                found = Mixture(mu, pi, ll, math.log(max(distinct, 1)) * length * clusters - 2 * ll, trace, bool(done))
                best = found if best is None or found.ll > best.ll else best
            if out and best.bic >= out[-1].bic:
                break
            out.append(best)
        return out
    finally:
        sets.unpersist()


def true_shares(mixture: Mixture, gap: int = 4) -> np.ndarray:
    """Cluster shares before reads with close mutations went missing."""
    real = mixture.pi / np.array([spaced_probability(m, gap)[0] for m in mixture.mu])
    return real / real.sum()
