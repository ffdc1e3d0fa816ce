"""Column expressions shared by the operators. All of them stay inside JVM codegen or
Spark's own higher-order functions; none is a Python UDF."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(arr) -> Column:
    """0-based position of the largest entry; the first one wins a tie."""
    arr = _col(arr)
    return (F.array_position(arr, F.array_max(arr)) - F.lit(1)).cast("int")


def round_half_even(x) -> Column:
    """Nearest integer, halves to the even neighbour (2.5 -> 2, 3.5 -> 4)."""
    return F.bround(_col(x), 0).cast("int")


def round_gt_half(x) -> Column:
    """Truncate, then add one only when the remaining fraction is above a half."""
    x = _col(x)
    whole = x.cast("int")
    return F.when(x - whole > F.lit(0.5), whole + F.lit(1)).otherwise(whole)


def reverse_sequence(arr) -> Column:
    return F.reverse(_col(arr))


def clip(x, lo, hi) -> Column:
    """Keep a scalar column inside [lo, hi]; bounds are numbers or columns."""
    bound = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    return F.greatest(bound(lo), F.least(bound(hi), _col(x)))


def clip_array(arr, lo: list[float], hi: list[float]) -> Column:
    """Keep entry d of an array column inside [lo[d], hi[d]]."""
    low, high = F.array(*[F.lit(float(v)) for v in lo]), F.array(*[F.lit(float(v)) for v in hi])
    floored = F.zip_with(_col(arr), low, lambda v, b: F.greatest(v, b))
    return F.zip_with(floored, high, lambda v, b: F.least(v, b))


def space_transform(x, kind: str) -> Column:
    """Map a raw coordinate to a parameter value: ``choice`` truncates to an integer,
    ``uniform`` keeps it, ``log_uniform`` reads it as a power of ten."""
    x = _col(x)
    if kind == "choice":
        return x.cast("int")
    if kind == "uniform":
        return x.cast("double")
    if kind == "log_uniform":
        return F.pow(F.lit(10.0), x)
    raise ValueError(f"unknown search-space kind {kind!r}")


def _key(seed, parts) -> Column:
    cols = [F.lit(str(seed))] + [
        p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts
    ]
    return F.md5(F.concat_ws("|", *cols))


def draw(seed, *parts) -> Column:
    """Uniform draw in [0, 1) that depends only on its keys, so a retried task repeats it.
    Parts are columns or literals."""
    return F.conv(F.substring(_key(seed, parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_below(frac: float, seed, *parts) -> Column:
    """``draw(seed, *parts) < frac`` as a plain comparison of hex digits."""
    limit = math.ceil(float(frac) * 4294967296)
    if limit >= 4294967296:
        return F.lit(True)
    return F.substring(_key(seed, parts), 1, 8) < F.lit(f"{max(0, limit):08x}")


def hash60(row_id, seed) -> Column:
    """60-bit pseudo-random order key per row id (bigint)."""
    return F.conv(F.substring(_key(seed, [_col(row_id)]), 1, 15), 16, 10).cast("bigint")
