"""Structures of sequences by a folding function that the caller brings; the library has none of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sequence, reactivities (or None), temperature, number of structures -> structures in dot-bracket notation.
Fold = Callable[[str, list[float] | None, float, int], list[str]]


def fold(sequences: DataFrame, folder: Fold, n: int = 250, temperature: float = 37.0) -> DataFrame:
    """(id, struct_id, db) for sequences (id, seq, reactivity: array or null); each is folded where it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, db) for i, seq, react in zip(f["id"], f["seq"], f["reactivity"]) for k, db in enumerate(folder(seq, None if react is None else list(react), temperature, n))]
            yield pd.DataFrame(rows, columns=["id", "struct_id", "db"])

    return sequences.select("id", "seq", "reactivity").mapInPandas(run, "id string, struct_id long, db string")


@dataclass(frozen=True)
class LogShape:
    """Pseudo-energy slope x ln(reactivity + 1) + intercept, in kcal/mol a stacked base."""

    slope: float = 2.6
    intercept: float = -0.8

    def energy(self, reactivity: Column) -> Column:
        return F.when(reactivity >= 0, F.lit(self.slope) * F.log(reactivity + 1) + F.lit(self.intercept)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class ProbabilityShape:
    """Pseudo-energy beta x |paired - unpaired probability|; a reactivity over 1 counts as 1."""

    beta: float = 0.89

    def energy(self, reactivity: Column, unpaired: float = 0.0) -> Column:
        """Of a base that the structure has unpaired (1) or paired (0)."""
        return F.when(reactivity >= 0, F.lit(self.beta) * F.abs(F.lit(unpaired) - F.least(reactivity, F.lit(1.0)))).otherwise(F.lit(0.0))


def pseudo_energies(reactivities: DataFrame, shape: LogShape | ProbabilityShape = LogShape()) -> DataFrame:  # noqa: B008
    """reactivities (reactivity, below 0 where there is none) with energy: what a base costs if it is paired, for folding functions
    that take soft constraints."""
    return reactivities.withColumn("energy", shape.energy(F.col("reactivity").cast("double")))


def fold_one(sequences: DataFrame, folder: Fold, temperature: float = 37.0) -> DataFrame:
    """(id, db): one structure of each sequence, such as the one of least energy, by a folding function that gives it first."""
    return fold(sequences, folder, 1, temperature).where("struct_id = 0").select("id", "db")
