"""Command lines: python -m strandlake.cli bmm|hbbmm|vi|spaced TABLE OUT, python -m strandlake.cli simulate OUT.

TABLE is a dense table of 0s and 1s; results are folders of Parquet and text in OUT.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import mixtures, simulate
from strandlake.plans import benchmark
from strandlake.plans.two_sample import assignments
from strandlake.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("bmm", "hbbmm", "vi", "spaced"):
        c = commands.add_parser(name, help="fit a mixture to a dense table")
        c.add_argument("table")
        c.add_argument("out")
        c.add_argument("--sep", default=",")
        c.add_argument("--clusters", type=int, default=2)
        c.add_argument("--runs", type=int, default=10)
        c.add_argument("--threshold", type=float, default=0.5)
        c.add_argument("--min-iters", type=int, default=300)
        c.add_argument("--seed", type=int, default=386)
    c = commands.add_parser("simulate", help="score methods on a simulated library")
    c.add_argument("out")
    c.add_argument("--mixture", default="A2", choices=sorted(simulate.MIXTURES))
    c.add_argument("--depth", type=int, default=100)
    c.add_argument("--length", type=int, default=100)
    c.add_argument("--similarity", type=float, default=0.5)
    c.add_argument("--rate", type=float, default=0.02)
    c.add_argument("--false-positives", type=float, default=0.0)
    c.add_argument("--seed", type=int, default=386)
    c.add_argument("--methods", nargs="+", default=["bmm", "kmeans"], choices=["kmeans", "ward", "kmedoids", "spectral", "bmm", "hbbmm", "bmm_vi", "spaced"])
    return p


def fitted(reads: DataFrame, mods: DataFrame, length: int, a: argparse.Namespace) -> list[mixtures.Mixture]:
    sets = mixtures.position_sets(reads, mods)
    if a.command == "vi":
        return [mixtures.fit_variational(sets, a.clusters, length, seed=a.seed)]
    if a.command == "spaced":
        return mixtures.fit_spaced(sets, a.clusters, length, a.runs, a.threshold, a.min_iters, seed=a.seed)
    return [mixtures.fit(sets, a.clusters, length, a.runs, a.threshold, a.min_iters, seed=a.seed, hierarchical=a.command == "hbbmm")]


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "simulate":
        s = simulate.Simulation(a.depth, a.length, simulate.MIXTURES[a.mixture], a.similarity, a.rate, a.false_positives, seed=a.seed)
        simulate.truths(spark, s).write.parquet(f"{a.out}/truths")
        simulate.library(spark, s).write.parquet(f"{a.out}/library")
        scores = [benchmark.run(spark, s, m) for m in a.methods]
        for one in scores[1:]:
            scores[0] = scores[0].unionByName(one)
        scores[0].write.parquet(f"{a.out}/scores")
        return
    rows = readers.dense_table(spark, a.table, a.sep).select(F.monotonically_increasing_id().alias("read_id"), "bits", "p").cache()
    length = rows.agg(F.max(F.length("bits"))).first()[0] or 0
    reads, mods = rows.select("read_id"), rows.select("read_id", F.explode("p").alias("pos"))
    models = fitted(reads, mods, length, a)
    writers.write_mixture(spark, models[-1], f"{a.out}/model")
    for name, table in writers.run_log(spark, models, vars(a)).items():
        table.write.parquet(f"{a.out}/log_{name}")
    found = assignments(reads, mods, models[-1])
    writers.write_lines(writers.posterior_lines(found, len(models[-1].pi)), f"{a.out}/posteriors")
    for name, table in writers.mutation_summary(reads, mods, length).items():
        table.write.parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
