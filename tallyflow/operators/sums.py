"""Matrix sums over all rows: the one numeric building block behind ridge, discriminant
analysis, principal components, reservoir readouts and RBM training.

Each task turns its Arrow batches into small matrices and adds them up locally; the partial
matrices are shuffled as single rows keyed by (key, row number), so no reducer ever holds more
than its share of one matrix, whatever the number of input partitions.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SCHEMA = "key int, row int, vec array<double>"
#: Bytes of a batch that ``per_batch`` gets at once, so that its working copies stay small for wide rows.
_PART_BYTES = 4 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * _PART_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array<numeric> column of equal-length arrays as a float64 matrix."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0)
    if col.null_count or col.flatten().null_count or (sizes.size and (sizes != sizes[0]).any()):
        raise ValueError(f"column {name} must hold arrays of one length without nulls")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def arrow_lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists of doubles, without a Python object per row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def vector_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _emit(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not sums:
        return
    keys = sorted(sums)
    step = 1_000
    for at in range(0, len(keys), step):
        part = keys[at:at + step]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.int32()), pa.array([r for _, r in part], pa.int32()),
             pa.array([sums[k] for k in part], pa.list_(pa.float64()))], ["key", "row", "vec"])


def matrix_sums(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[int, np.ndarray]],
                combine: Callable = np.add) -> dict[int, np.ndarray]:
    """Sum ``per_batch(batch)[key]`` over all batches of ``df``; one matrix per key comes back. ``combine``
    may be another function that can be applied in any order, such as ``np.minimum``."""

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in _parts(whole)):
            for key, m in per_batch(batch).items():
                m = np.atleast_2d(np.asarray(m, dtype=np.float64))
                total[key] = combine(total[key], m) if key in total else m
        yield from _emit({(k, i): m[i] for k, m in total.items() for i in range(m.shape[0])})

    def merge(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys, rows = vector_of(batch, "key"), vector_of(batch, "row")
            vecs = batch.column(2)
            for i in range(batch.num_rows):
                at = (int(keys[i]), int(rows[i]))
                v = vecs[i].values.to_numpy(zero_copy_only=False)
                total[at] = combine(total[at], v) if at in total else v.copy()
        yield from _emit(total)

    merged = (df.mapInArrow(partial, _SCHEMA).repartition("key", "row").mapInArrow(merge, _SCHEMA))
    found: dict[int, dict[int, list[float]]] = {}
    for r in merged.collect():
        found.setdefault(r["key"], {})[r["row"]] = r["vec"]
    return {k: np.array([rows[i] for i in range(len(rows))]) for k, rows in found.items()}


def augmented_gram(df: DataFrame, vec: str, targets: str | None = None) -> np.ndarray:
    """Sum of ``[1, x, t]' [1, x, t]`` over all rows, for the arrays ``vec`` and ``targets``."""

    def per_batch(batch):
        parts = [np.ones((batch.num_rows, 1)), matrix_of(batch, vec)]
        if targets is not None:
            parts.append(matrix_of(batch, targets))
        a = np.hstack(parts)
        return {0: a.T @ a}

    cols = [vec] if targets is None else [vec, targets]
    return matrix_sums(df.select(*cols), per_batch)[0]
