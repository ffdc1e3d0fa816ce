"""Row appends, key-aligned columns, anti rows and the per-split class table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_slices(dfs: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def align_columns(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Put the columns of two frames side by side, matched on an explicit row id."""
    return a.join(b, row_id, "inner")


def class_distribution(df: DataFrame, label: str, is_test: str) -> DataFrame:
    """Rows per class in the train and the test part, zeros kept. One aggregation counts both
    parts, so no outer join of two count tables is needed."""
    return df.groupBy(label).agg(
        F.sum(F.when(~F.col(is_test), 1).otherwise(0)).cast("bigint").alias("n_train"),
        F.sum(F.when(F.col(is_test), 1).otherwise(0)).cast("bigint").alias("n_test"),
    )


def outer_counts(a: DataFrame, b: DataFrame, label: str, names=("n_train", "n_test")) -> DataFrame:
    """Class counts of two separate frames, aligned on the class; a class missing on one side
    counts zero there."""
    one = a.groupBy(label).agg(F.count(F.lit(1)).alias(names[0]))
    two = b.groupBy(label).agg(F.count(F.lit(1)).alias(names[1]))
    return one.join(two, label, "full_outer").na.fill(0, list(names))


def anti_rows(df: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """Rows of ``df`` whose id does not occur in ``other``."""
    return df.join(other.select(row_id), row_id, "left_anti")


def label_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
