"""Predicate banks and cell histograms.

Every row is mapped to a bit mask of the predicates that hold for it, and rows are counted by mask and class. One scan and
one small shuffle turn any number of rows into the cells that are not empty; metrics of half-spaces, conjunctions and
unions are then sums over cells. A bank keeps 62 predicates per word, so masks stay non-negative longs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import linear

BITS = 62


@dataclass(frozen=True)
class HalfSpace:
    """n.x + b <= 0 (side 1) or >= 0 (side -1) over named columns."""

    hs_id: int
    plane_id: str
    n: tuple[float, ...]
    b: float
    side: int
    pair: tuple[int, int] | None = None

    @property
    def oriented_id(self) -> str:
        return f"{self.plane_id}:{'≤' if self.side >= 0 else '≥'}"

    def column(self, features: list[str], tolerance: float = 0.0) -> Column:
        value = linear(features, list(self.n), self.b)
        return value <= tolerance if self.side >= 0 else value >= -tolerance


def histogram(samples: DataFrame, predicates: list[Column], label: str = "y") -> DataFrame:
    """(m0, m1, ..., y, cnt): rows counted by predicate mask and class. A predicate that is null counts as false."""
    words = [predicates[i : i + BITS] for i in range(0, len(predicates), BITS)]
    bit = lambda p, k: F.when(p, F.lit(1 << k)).otherwise(F.lit(0))
    masks = [reduce(lambda a, b: a.bitwiseOR(b), [bit(p, k).cast("long") for k, p in enumerate(word)]).alias(f"m{w}") for w, word in enumerate(words)]
    return samples.select(*masks, F.col(label).alias("y")).groupBy(*[f"m{w}" for w in range(len(words))], "y").agg(F.count("*").alias("cnt"))


def holds(k: int) -> Column:
    """Does predicate k hold in a cell?"""
    return F.col(f"m{k // BITS}").bitwiseAND(F.lit(1 << (k % BITS))) != 0


def membership(cells: DataFrame, size: int) -> DataFrame:
    """(k, y, cnt): the cells' counts for each predicate that holds there."""
    each = F.array_compact(F.array(*[F.when(holds(k), F.lit(k)) for k in range(size)]))
    return cells.select(F.explode(each).alias("k"), "y", "cnt").groupBy("k", "y").agg(F.sum("cnt").alias("cnt"))
