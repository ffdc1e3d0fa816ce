"""Scaling, label encoding and one-hot targets."""
from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, functions as F


def minmax_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of every column, by one aggregation."""
    row = df.agg(*[f(F.col(c)).cast("double").alias(f"{p}{i}") for i, c in enumerate(cols)
                   for f, p in ((F.min, "lo"), (F.max, "hi"))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def minmax_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale columns to [0, 1]; a constant column becomes 0. Fitted on ``df`` itself, or on
    ``fit_on`` (the train part). The limits are inlined, so scaling is one projection."""
    limits = minmax_fit(df if fit_on is None else fit_on, cols)

    def scaled(c):
        lo, hi = limits[c]
        if lo is None:
            return F.lit(None).cast("double")
        span = hi - lo
        return (F.col(c).cast("double") - F.lit(lo)) / F.lit(span if span else 1.0)

    return df.select(*[scaled(c).alias(c) if c in limits else F.col(c) for c in df.columns])


def label_map(df: DataFrame, label: str) -> DataFrame:
    """(label, code): codes follow the sorted order of the distinct labels. The labels are
    deduplicated before they are gathered; there is one row per class."""
    classes = df.select(label).distinct().agg(F.array_sort(F.collect_set(label)).alias("_all"))
    return classes.select(F.posexplode("_all").alias("code", label)).select(label, "code")


def label_fit(df: DataFrame, label: str, out: str = "y") -> StringIndexerModel:
    """Encoder with codes in code-point order (upper case before lower)."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc").fit(df)


def label_encode(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    return label_fit(df, label, out).transform(df)


def one_hot(df: DataFrame, col: str, k: int, out: str = "onehot") -> DataFrame:
    """array<double> with a one at the class code."""
    return df.withColumn(out, F.array(*[(F.col(col) == F.lit(i)).cast("double") for i in range(k)]))
