"""Any classifier as scores: fitted Spark models, expressions, and functions of a matrix of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g

MODES = ("auto", "probability", "decision", "callable")


def probabilities(raw: np.ndarray, mode: str) -> np.ndarray:
    """Probabilities from what a function returned: one score for each row is the second class's, of `decision` values
    by the logistic function; several decision values by softmax; probabilities stay."""
    raw = np.asarray(raw, float)
    if raw.ndim == 2 and raw.shape[1] == 1:
        raw = raw[:, 0]
    if raw.ndim == 1:
        s = 1 / (1 + np.exp(-raw)) if mode == "decision" else raw
        return np.stack([1 - s, s], axis=1)
    if mode != "decision":
        return raw
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix_function(model: Callable[[np.ndarray], np.ndarray], mode: str = "callable") -> Callable[[np.ndarray], np.ndarray]:
    """The function as `boundary.flips` and `boundary.change_points` take it."""
    return lambda x: probabilities(model(x), mode)


def scored_by(df: DataFrame, model, features: str = "features", mode: str = "auto") -> DataFrame:
    """Adds p (probabilities, array) and label (their first argmax).

    auto: a model with a `transform` is a fitted Spark classifier, read by its probability column or, if it has none, by its
    raw predictions (one column by the logistic function, several by softmax); what is called with a column is an
    expression if it gives one; any other callable maps a matrix of rows, an Arrow batch at a time.
    """
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    if hasattr(model, "transform"):
        return _by_spark(df, model, features, mode)
    if mode == "auto":
        try:
            p = model(F.col(features))
        except Exception:  # not an expression: numpy refuses a column in many ways
            p = None
        if isinstance(p, Column):
            return df.withColumn("p", p).withColumn("label", g.argmax(F.col("p")))
    predict = matrix_function(model, "decision" if mode == "decision" else "callable")
    names = df.columns

    def run(frames):
        for d in frames:
            if len(d):
                p = predict(np.array(d[features].tolist(), float))
                yield d.assign(p=list(p), label=p.argmax(axis=1).astype(np.int32))[[*names, "p", "label"]]

    return df.mapInPandas(run, T.StructType([*df.schema, T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]))


def _by_spark(df: DataFrame, model, features: str, mode: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = "_vector"
    out = model.copy({model.getParam("featuresCol"): own}).transform(df.withColumn(own, array_to_vector(F.col(features))))
    given = set(df.columns)
    if mode in ("auto", "probability") and model.hasParam("probabilityCol") and model.getOrDefault("probabilityCol") in out.columns:
        p = vector_to_array(model.getOrDefault("probabilityCol"))
    else:
        raw = vector_to_array(model.getOrDefault("rawPredictionCol"))
        one = g.sigmoid(F.element_at(raw, -1))
        # linear separators give the two signs of one margin
        p = F.when(F.size(raw) == 2, F.array(1 - one, one)).otherwise(g.softmax(raw))
    return out.withColumn("_p", p).select(*sorted(given, key=df.columns.index), F.col("_p").alias("p")).withColumn("label", g.argmax(F.col("p")))


def scored_once_by(df: DataFrame, model, features: str = "features", mode: str = "auto", digits: int = 6) -> DataFrame:
    """As `scored_by`, each distinct rounded row scored once: what a cache of scores gives, without its memory."""
    key = F.transform(features, lambda v: F.round(v, digits))
    rows = df.withColumn("_key", key)
    distinct = scored_by(rows.select(F.col("_key").alias(features)).distinct(), model, features, mode)
    return rows.join(distinct.select(F.col(features).alias("_key"), "p", "label"), "_key").drop("_key")
