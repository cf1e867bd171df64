"""Ingestion of tables and matrices, and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, form: str | None = None, **options: str) -> DataFrame:
    """A table from Parquet, CSV, JSON or ORC, by its ending unless `form` is given; CSV has a header."""
    form = form or next((f for f in ("parquet", "csv", "json", "orc") if path.rstrip("/").endswith(f)), "parquet")
    reader = spark.read.options(**options)
    return reader.option("header", True).option("inferSchema", True).csv(path) if form == "csv" else reader.format(form).load(path)


def from_matrix(spark: SparkSession, rows: list[list[float]], labels: list | None = None, names: list[str] | None = None) -> DataFrame:
    """(row_id, x0.., y) from a local matrix; every row must have as many values."""
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("rows of different lengths")
    names = names or [f"x{i}" for i in range(len(rows[0]))]
    data = [(i, *map(float, r), *([labels[i]] if labels is not None else [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ["row_id", *names, *(["y"] if labels is not None else [])])


def wide_to_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def shape(df: DataFrame) -> tuple[int, int, int]:
    """Rows, columns and cells."""
    n = df.count()
    return n, len(df.columns), n * len(df.columns)


def taken(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among `keys`."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header, columns in the given order first; an empty table is an error."""
    if not df.take(1):
        raise ValueError("no rows to write")
    first = [c for c in order or [] if c in df.columns]
    df.select(*first, *[c for c in df.columns if c not in first]).write.option("header", True).mode("overwrite").csv(path)


def stage_timings(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Stage timings as CSV: the union of keys as columns, floats with six digits."""
    keys = list(dict.fromkeys(k for r in rows for k in r))
    text = lambda v: None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    write_csv(spark.createDataFrame([tuple(text(r.get(k)) for k in keys) for r in rows], ", ".join(f"`{k}` string" for k in keys)).coalesce(1), path)


def experiment_sink(folder: str, **tables: DataFrame) -> list[str]:
    """Write an experiment's tables (summary, planes, dims, runs, rules and so on) as one CSV folder each; arrays and
    structs become JSON. Returns the folders in the order given."""
    from pyspark.sql import types as T

    out = []
    for name, df in tables.items():
        columns = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name) for f in df.schema]
        path = f"{folder.rstrip('/')}/{name}.csv"
        df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
        out.append(path)
    return out


def dim_distribution(rules: DataFrame) -> DataFrame:
    """(num_dims, target, rules, best_f1): how rules spread over dimensionalities."""
    return rules.groupBy("num_dims", "target").agg(F.count("*").alias("rules"), F.max("f1").alias("best_f1"))
