"""Vector and probability expressions over array<double> columns; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)))


def norm_inf(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda v: F.abs(v)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Point at share t of the segment from a to b."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def unit(a: Column) -> Column:
    size = norm(a) + EPS
    return F.transform(a, lambda v: v / size)


def residual(x: Column, n: Column, b: Column) -> Column:
    """Signed value n.x + b of a plane at a point."""
    return dot(x, n) + b


def inside(value: Column, side: Column) -> Column:
    """Membership of a half-space: value <= 0 for side >= 0, else value >= 0; points on the plane belong to both."""
    return F.when(side >= 0, value <= 0).otherwise(value >= 0)


def linear(columns: list[str], n: list[float], b: float) -> Column:
    """n.x + b over wide columns, without the terms that are zero."""
    terms = [F.col(c) * F.lit(float(w)) for c, w in zip(columns, n, strict=True) if w]
    return reduce(lambda x, y: x + y, terms, F.lit(float(b))) if terms else F.lit(float(b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - top))
    whole = total(e)
    return F.transform(e, lambda v: v / whole)


def argmax(a: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(p: Column) -> Column:
    """Natural-log entropy of a probability array."""
    return total(F.transform(p, lambda v: -v * F.log(v + EPS)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits after clipping at 1e-12 and renormalising."""
    clip = lambda a: F.transform(a, lambda v: F.greatest(v, F.lit(EPS)))
    p, q = clip(p), clip(q)
    sp, sq = total(p), total(q)
    p, q = F.transform(p, lambda v: v / sp), F.transform(q, lambda v: v / sq)
    part = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * F.log2(2 * x / (x + y))))
    return 0.5 * part(p, q) + 0.5 * part(q, p)
