"""Vectors of Arrow batches as exact integers, first codebooks, and sums of integers over all rows."""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.llm.frames import name_of


def usable(vector: str, dims: int | None = None) -> Column:
    """True for vectors of ``dims`` components (any number above 0 without it), none null, NaN or infinite."""
    x = F.col(name_of(vector))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) == dims if dims is not None else F.size(x) > 0) & finite, F.lit(False))


def whole_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows that ``usable`` accepts and their components as a float64 matrix."""
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dims))
    start = column.offsets.to_numpy()
    size = np.diff(start)
    flat = column.values
    good = np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    bad = np.concatenate([[0], np.cumsum(~good)])
    fits = (size == dims) & (bad[start[1:]] == bad[start[:-1]])
    if column.null_count:
        fits &= column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    at = start[rows][:, None] + np.arange(dims)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return rows, values[at]


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x). Integers whose squared distances could leave 64 bits are refused."""
    whole = np.floor(x * scale)
    if whole.size and np.abs(whole).max() > most(x.shape[1]):
        raise ValueError(f"components beyond {most(x.shape[1])} / {scale} have no exact 64-bit distances")
    return whole.astype(np.int64)


def most(dims: int) -> int:
    """Largest size of an integer component for which squared distances in ``dims`` dimensions fit in 62 bits."""
    return int((2.0**62 / dims) ** 0.5 / 2)


def first_vectors(df: DataFrame, vector: str, order: Column, k: int, dims: int | None) -> list[list[float]]:
    """The ``k`` usable vectors that come first by ``order`` (nulls last), equal ones by their components. Only ``k`` rows leave a task."""
    x = F.col(name_of(vector)).cast("array<double>")
    rows = df.filter(usable(vector, dims)).select(order.alias("k"), x.alias("x")).orderBy(F.asc_nulls_last("k"), "x").limit(k)
    return [r["x"] for r in rows.collect()]


def integer_sums(df: DataFrame, columns: list[str], per_batch: Callable[[pa.RecordBatch], np.ndarray | None], shape: tuple) -> np.ndarray:
    """Exact sum over all batches of the integer arrays ``per_batch`` returns (None: nothing), as Python integers. A task adds up its
    batches; what moves is one row per entry of a task's sum."""
    size = int(np.prod(shape))

    def partial(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            if batch.num_rows and (part := per_batch(batch)) is not None:
                total += part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["at", "total"])

    rows = df.select(*[F.col(name_of(c)) for c in columns]).mapInArrow(partial, "at long, total long")
    out = np.array([0] * size, object)
    for r in rows.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["at"]] = int(Decimal(r["total"]))
    return out.reshape(shape)


def integer_digest(values) -> str:
    """Lowercase hex sha256 of integers in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in values).encode()).hexdigest()


def means_of(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) along the last axis; entries without rows stay as they are."""
    new = old.copy()
    for at in np.ndindex(counts.shape):
        if counts[at]:
            new[at] = [s // counts[at] for s in sums[at]]
    return new
