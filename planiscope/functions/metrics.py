"""Ratios from integer counts. Three stages differ in edge cases, so each has its own set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def half_space(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """One-versus-rest metrics of a half-space for a class."""
    n = tp + fp + fn + tn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    base = ratio(tp + fn, n)
    return {
        "acc": ratio(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1": f1(precision, recall),
        "balacc": 0.5 * (recall + ratio(tn, tn + fp)),
        "baseline": base,
        "lift": F.when(base > 0, precision / base).when(precision > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
        "region_size": tp + fp,
        "region_frac": ratio(tp + fp, n),
    }


def class_score(balacc: Column, lift: Column, coverage: Column, purity: Column) -> Column:
    return 0.5 * balacc + 0.4 * lift * F.pow(coverage, F.lit(0.6)) + 0.1 * purity


def rule(size: Column, tp: Column, positives: Column, n: Column) -> dict[str, Column]:
    """Metrics of a mined conjunction: the F1 denominator carries 1e-12."""
    precision, recall = ratio(tp, size), ratio(tp, positives)
    base = ratio(positives, n)
    return {
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / (precision + recall + 1e-12),
        "baseline": base,
        "lift_precision": F.when(base > 0, precision / base).when(precision > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
    }


def beam(size: Column, tp: Column, positives: Column, n: Column) -> dict[str, Column]:
    """Metrics that the beam ranks by; lift is 0 without a baseline."""
    precision, recall = ratio(tp, size), ratio(tp, positives)
    base = ratio(positives, n)
    negatives = n - positives
    return {
        "precision": precision,
        "recall": recall,
        "f1": f1(precision, recall),
        "region_frac": ratio(size, n),
        "lift": ratio(precision, base),
        "wracc": ratio(size, n) * (precision - base),
        "balacc": 0.5 * (recall + ratio(negatives - (size - tp), negatives)),
    }
