"""Projections, filters and row-to-array reshaping."""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the columns of any numeric type, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def select_numeric(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns only, plus any named in ``keep`` (a row id or the label)."""
    wanted = set(numeric_columns(df)) | set(keep)
    return df.select(*[c for c in df.columns if c in wanted])


def select_positions(df: DataFrame, idx: list[int] | slice) -> DataFrame:
    """Project by position: a list of (possibly negative) positions or a slice."""
    names = df.columns
    return df.select(*(names[idx] if isinstance(idx, slice) else [names[i] for i in idx]))


def select_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def filter_label(df: DataFrame, label: str, values: list) -> DataFrame:
    """Rows of the listed classes; an ``IN`` filter that reaches the scan."""
    return df.filter(F.col(label).isin(list(values)))


def top_features(df: DataFrame, rank_df: DataFrame, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the ``n`` best ranked features. The rank table has one row per feature."""
    best = [r["feature"] for r in rank_df.filter(F.col("rank") <= n).orderBy("rank").collect()]
    return df.select(*keep, *best)


def slice_vector(df: DataFrame, vec: str, names: list[int], out: str) -> DataFrame:
    return VectorSlicer(inputCol=vec, outputCol=out, indices=names).transform(df)


def to_sequence(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Columns as one array<double>: each feature becomes a time step."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def to_vector(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Columns as one ML vector: a single time step."""
    return VectorAssembler(inputCols=cols, outputCol=out).transform(df)
