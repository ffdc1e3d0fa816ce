"""Exact positions in a global order without a single-partition window.

* ``order_thresholds`` finds the order key standing at given ranks by narrowing a value range
  with mergeable quantile sketches and exact counts. "First n rows" then is a plain comparison
  with a literal, which needs no shuffle and reaches the file scan.
* ``ranked_by_hash`` numbers all rows per group in pseudo-random order, spreading a hot group
  over hash buckets.
* ``running_totals`` is a cumulative sum over value ranges.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, LongType, NumericType, TimestampNTZType, TimestampType

ROWS_PER_TASK = 1_000_000
_SKETCH = 10_000
_MARGIN = 1.0 / 2_000


def _plain(df: DataFrame, name: str) -> Column:
    """Order column as a number."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_date(F.col(name)) if kind == "date" else F.col(name)


def _literal(df: DataFrame, name: str, value) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.timestamp_micros(F.lit(value)).cast(kind)
    return F.date_from_unix_date(F.lit(value)) if kind == "date" else F.lit(value).cast(kind)


def at_or_before(df: DataFrame, order_by: list[str], values: tuple) -> Column:
    """Predicate "order key <= values", compared column by column; null comes first and NaN last. Never null."""
    name, value = order_by[0], values[0]
    c = F.col(name)
    same = c.isNull() if value is None else c.eqNullSafe(_literal(df, name, value))
    before = F.lit(False) if value is None else c.isNull() | (c < _literal(df, name, value))
    if len(order_by) == 1:
        return same if value is None else c.isNull() | (c <= _literal(df, name, value))
    return before | (same & at_or_before(df, order_by[1:], values[1:]))


class _Levels:
    """The numbers compared one after the other for an order key. A column with nulls starts with whether it
    is known, one with NaN goes on with whether it is NaN; 64-bit integers are halved, as sketches work on doubles."""

    def __init__(self, df: DataFrame, order_by: list[str]):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for name in order_by:
            if not isinstance(kinds[name], (NumericType, DateType, TimestampType, TimestampNTZType)):
                raise ValueError(f"order column {name} is {kinds[name].simpleString()}; numbers, dates and timestamps have an order here")
        real = [name for name in order_by if isinstance(kinds[name], (DoubleType, FloatType))]
        row = df.agg(*[F.max(F.col(c).isNull()).alias(f"null_{c}") for c in order_by], *[F.max(F.isnan(c)).alias(f"nan_{c}") for c in real]).first()
        self.columns: list[Column] = []
        self._parts: list[list[str]] = []
        for name in order_by:
            x, parts = _plain(df, name), []
            if row[f"null_{name}"]:
                parts.append("known")
                self.columns.append(F.col(name).isNotNull().cast("int"))
                x = F.coalesce(x, F.lit(0))
            if name in real and row[f"nan_{name}"]:
                parts.append("nan")
                self.columns.append(F.isnan(x).cast("int"))
                x = F.nanvl(x.cast("double"), F.lit(0.0))
            if isinstance(kinds[name], (LongType, TimestampType, TimestampNTZType)):
                parts += ["high", "low"]
                self.columns += [F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))]
            else:
                parts.append("value")
                self.columns.append(x)
            self._parts.append(parts)

    def key(self, values: tuple) -> tuple:
        """The order key of these numbers; None for null."""
        out, at = [], 0
        for parts in self._parts:
            got = dict(zip(parts, values[at:at + len(parts)]))
            at += len(parts)
            if got.get("known") == 0:
                out.append(None)
            elif got.get("nan") == 1:
                out.append(math.nan)
            else:
                out.append((got["high"] << 32) + got["low"] if "high" in got else got["value"])
        return tuple(out)


@dataclass
class _Request:
    group: object
    rank: int            # 1-based position asked for
    left: int            # position among the rows still in range
    rows: int            # rows still in range
    pred: Column         # range predicate
    level: int = 0       # order column being narrowed
    prefix: tuple = field(default_factory=tuple)
    key: tuple | None = None


def order_thresholds(df: DataFrame, order_by: list[str], ranks: dict, counts: dict,
                     group: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> dict:
    """``{(group value, rank): order key}`` for 1-based ranks ``{group value: [rank, ...]}``.

    ``counts`` holds the rows per group value (key ``None`` without a group). Order columns must
    be numeric, date or timestamp, others are refused at any size; nulls come first, NaN last. The last
    column should make the order unique.
    Every round scans once for a sketch and once for counts, for all requests together, and
    shrinks each range about a thousandfold; ranges below ``rows_per_task`` rows are ranked.
    """
    levels = _Levels(df, order_by)
    todo, done = [], []
    for g, wanted in ranks.items():
        where = F.lit(True) if group is None else F.col(group) == F.lit(g)
        for r in sorted(set(wanted)):
            if not 1 <= r <= counts[g]:
                raise ValueError(f"rank {r} outside 1..{counts[g]}")
            todo.append(_Request(g, r, r, counts[g], where))
    while todo:
        wide = [q for q in todo if q.rows > rows_per_task]
        done += [q for q in todo if q.rows <= rows_per_task]
        todo = _narrow(df, levels.columns, wide) if wide else []
        done += [q for q in todo if q.key is not None]
        todo = [q for q in todo if q.key is None]
    _rank_small(df, levels.columns, [q for q in done if q.key is None])
    return {(q.group, q.rank): levels.key(q.key) for q in done}


def _narrow(df: DataFrame, levels: list[Column], requests: list[_Request]) -> list[_Request]:
    aggs = []
    for i, q in enumerate(requests):
        at = q.left / q.rows
        probes = [max(0.0, at - _MARGIN), min(1.0, at + _MARGIN)]
        aggs.append(F.percentile_approx(F.when(q.pred, levels[q.level]), probes, _SKETCH)
                    .alias(f"q{i}"))
    guess = df.agg(*aggs).first()
    counts = []
    for i, q in enumerate(requests):
        c, (lo, hi) = levels[q.level], guess[f"q{i}"]
        counts += [F.count(F.when(q.pred & (c < F.lit(lo)), 1)).alias(f"b{i}"),
                   F.count(F.when(q.pred & (c <= F.lit(hi)), 1)).alias(f"u{i}")]
    seen = df.agg(*counts).first()
    for i, q in enumerate(requests):
        c, (lo, hi) = levels[q.level], guess[f"q{i}"]
        below, upto = seen[f"b{i}"], seen[f"u{i}"]
        low, high, was = F.lit(lo), F.lit(hi), (q.rows, q.left, q.level)
        if q.left <= below:
            q.pred, q.rows = q.pred & (c < low), below
        elif q.left > upto:
            q.pred, q.rows, q.left = q.pred & (c > high), q.rows - upto, q.left - upto
        elif lo == hi:
            q.pred, q.rows, q.left = q.pred & (c == low), upto - below, q.left - below
            q.prefix, q.level = q.prefix + (lo,), q.level + 1
            if q.level == len(levels):
                q.key = q.prefix
        else:
            # a range that will not shrink holds one heavy value beside others: probe its ends
            stuck = upto - below == q.rows
            q.pred, q.rows, q.left = q.pred & (c >= low) & (c <= high), upto - below, q.left - below
            if stuck:
                _split_heavy(df, levels, q, lo, hi)
        if was == (q.rows, q.left, q.level) and q.key is None:
            raise RuntimeError("an order key does not narrow; its values are not told apart as doubles")
    return requests


def _split_heavy(df: DataFrame, levels: list[Column], q: _Request, lo, hi) -> None:
    c, low, high = levels[q.level], F.lit(lo), F.lit(hi)
    row = df.agg(F.count(F.when(q.pred & (c == low), 1)).alias("at_lo"),
                 F.count(F.when(q.pred & (c == high), 1)).alias("at_hi")).first()
    middle = q.rows - row["at_hi"]
    if q.left <= row["at_lo"]:
        q.pred, q.rows, q.prefix = q.pred & (c == low), row["at_lo"], q.prefix + (lo,)
    elif q.left > middle:
        q.pred, q.rows, q.left, q.prefix = (q.pred & (c == high), row["at_hi"], q.left - middle,
                                            q.prefix + (hi,))
    else:
        q.pred, q.rows, q.left = (q.pred & (c > low) & (c < high), middle - row["at_lo"],
                                  q.left - row["at_lo"])
        return
    q.level += 1
    if q.level == len(levels):
        q.key = q.prefix


def _rank_small(df: DataFrame, levels: list[Column], requests: list[_Request]) -> None:
    if not requests:
        return
    tags = F.array(*[F.when(q.pred, F.lit(i)) for i, q in enumerate(requests)])
    keys = df.select(F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("_q"),
                     *[c.alias(f"k{j}") for j, c in enumerate(levels)])
    w = Window.partitionBy("_q").orderBy(*[f"k{j}" for j in range(len(levels))])
    wanted = F.element_at(F.array(*[F.lit(q.left) for q in requests]), F.col("_q") + 1)
    for row in keys.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == wanted).collect():
        requests[row["_q"]].key = tuple(row[f"k{j}"] for j in range(len(levels)))


def group_counts(df: DataFrame, group: str | None, values: list | None = None) -> dict:
    """Rows per listed group value (one entry per requested class), or ``{None: rows}``."""
    if group is None:
        return {None: df.count()}
    part = df if values is None else df.filter(F.col(group).isin(list(values)))
    return {r[0]: r[1] for r in part.groupBy(group).count().collect()}


def ranked_by_hash(df: DataFrame, row_id: str, seed, group: str, out: str,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Number the rows of each group from 0 in md5 order. Rows are shuffled once, by group and
    hash bucket; small per-bucket counts supply each bucket's starting number."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    rows = df.withColumn("_h", key)
    digits = max(0, math.ceil(math.log(max(1, df.count() / rows_per_task), 16)))
    if digits == 0:
        w = Window.partitionBy(group).orderBy("_h", row_id)
        return rows.withColumn(out, F.row_number().over(w) - 1).drop("_h")
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    w = Window.partitionBy(group, "_b").orderBy("_h", row_id)
    starts = starts.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_start")
    return (rows.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
            .withColumn(out, F.row_number().over(w) - 1 + F.col("_start"))
            .drop("_h", "_b", "_g", "_c", "_start"))


def running_totals(df: DataFrame, order_col: str, sums: list[str], descending: bool = False,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``cum_<c>`` columns: sums over all rows up to and including this one in the order of
    a unique numeric column. Rows are grouped into value ranges; each range starts from the
    total of the ranges before it."""
    n = df.count()
    parts = math.ceil(n / rows_per_task)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if parts <= 1:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in sums])
    probes = [i / parts for i in range(1, parts)]
    sketch = min(1_000_000, max(_SKETCH, 10 * parts))
    cuts = sorted({float(v) for v in df.agg(F.percentile_approx(order_col, probes, sketch)).first()[0]})
    rows = df.withColumn("_x", F.col(order_col).cast("double"))
    rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_r").transform(rows)
    bucket = F.col("_r").desc() if descending else F.col("_r").asc()
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per_range = rows.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    starts = per_range.select("_r", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}")
                                      for c in sums])
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(starts, "_r")
            .select(*df.columns, *[(F.sum(c).over(w) + F.col(f"_s_{c}")).alias(f"cum_{c}") for c in sums]))

