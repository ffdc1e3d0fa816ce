"""Class re-balancing, samples, splits and folds. Fractions of a class are taken in a stated
order, and every draw depends on the row id only, so results do not change with partitioning."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.functions import draw_below, hash60
from tallyflow.operators.ranking import (
    ROWS_PER_TASK, at_or_before, group_counts, order_thresholds, ranked_by_hash,
)

# Share of each class kept when re-balancing the public flow sets.
PROFILE_TEN = {
    "WWW": 0.01, "MAIL": 0.1, "FTP-CONTROL": 0.1, "FTP-DATA": 0.5, "ATTACK": 1.0, "SERVICES": 1.0,
    "P2P": 1.0, "DATABASE": 1.0, "MULTIMEDIA": 1.0, "FTP-PASV": 1.0,
}
PROFILE_TWELVE = {**PROFILE_TEN, "INTERACTIVE": 1.0, "GAMES": 1.0}
PROFILE_ELEVEN = {
    "DNS": 0.1, "lime": 0.006, "HTTP": 0.2, "FTP": 1.0, "TELNET": 1.0, "localForwarding": 1.0,
    "remoteForwarding": 1.0, "scp": 1.0, "sftp": 1.0, "shell": 1.0, "x11": 1.0,
}


def head_of_class(df: DataFrame, label: str, fractions: dict, order_by: list[str],
                  rows_per_task: int = ROWS_PER_TASK) -> Column:
    """Predicate true for the first ``int(n_c * f_c)`` rows of every listed class c."""
    counts = group_counts(df, label, list(fractions))
    size = {c: int(n * fractions[c]) for c, n in counts.items()}
    partial = {c: [k] for c, k in size.items() if 0 < k < counts[c]}
    cut = order_thresholds(df, order_by, partial, counts, label, rows_per_task) if partial else {}
    parts = []
    for c, k in size.items():
        if k >= counts[c]:
            parts.append(F.col(label) == F.lit(c))
        elif k > 0:
            parts.append((F.col(label) == F.lit(c)) & at_or_before(df, order_by, cut[(c, k)]))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def rebalance_head(df: DataFrame, label: str, fractions: dict, order_by: list[str],
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keep the head fraction of each listed class; classes not listed are dropped. The result
    is a filter over the input: no row is shuffled."""
    return df.filter(head_of_class(df, label, fractions, order_by, rows_per_task))


def holdout_head(df: DataFrame, label: str, fractions: dict, order_by: list[str],
                 rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(train, test): the head fraction of each class is the test part, all else is train."""
    is_test = F.coalesce(head_of_class(df, label, fractions, order_by, rows_per_task), F.lit(False))
    return df.filter(~is_test), df.filter(is_test)


def sample_by_class(df: DataFrame, label: str, fractions: dict, seed, row_id: str) -> DataFrame:
    """Keep each row of class c with probability ``fractions[c]``."""
    keep = reduce(lambda a, b: a | b,
                  [(F.col(label) == F.lit(c)) & draw_below(f, seed, F.col(row_id)) for c, f in fractions.items()], F.lit(False))
    return df.filter(keep)


def sample_n(df: DataFrame, n: int, seed, row_id: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Exactly ``n`` rows drawn without replacement. The n-th smallest hash is found first, so
    the sample itself is a filter and never passes through one task."""
    rows = df.count()
    if n >= rows:
        return df
    if n <= 0:
        return df.filter(F.lit(False))
    keyed = df.withColumn("_h", hash60(row_id, seed))
    cut = order_thresholds(keyed, ["_h", row_id], {None: [n]}, {None: rows}, rows_per_task=rows_per_task)
    return keyed.filter(at_or_before(keyed, ["_h", row_id], cut[(None, n)])).drop("_h")


def shuffle_rows(df: DataFrame, seed, row_id: str) -> DataFrame:
    """Rows in pseudo-random order (a range-partitioned sort on the row hash)."""
    return df.withColumn("_h", hash60(row_id, seed)).orderBy("_h", row_id).drop("_h")


def split_hash(df: DataFrame, row_id: str, test_frac: float = 0.5, seed=0,
               out: str = "is_test") -> DataFrame:
    """Flag a random test part. The flag is a column, so scaled and raw columns of one frame
    share it."""
    return df.withColumn(out, draw_below(test_frac, seed, F.col(row_id)))


def split_ordered(df: DataFrame, order_by: list[str], frac: float = 0.8, out: str = "is_test",
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Flag everything after the first ``int(n * frac)`` rows as test."""
    n = df.count()
    k = int(n * frac)
    if k <= 0 or k >= n:
        return df.withColumn(out, F.lit(k <= 0))
    cut = order_thresholds(df, order_by, {None: [k]}, {None: n}, rows_per_task=rows_per_task)
    return df.withColumn(out, ~at_or_before(df, order_by, cut[(None, k)]))


def stratified_folds(df: DataFrame, label: str, k: int, seed, row_id: str, out: str = "fold",
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal the rows of each class in random order to k folds, so class counts differ by at most
    one between folds."""
    ranked = ranked_by_hash(df, row_id, seed, label, "_rn", rows_per_task)
    return ranked.withColumn(out, (F.col("_rn") % k).cast("int")).drop("_rn")


def contiguous_folds(df: DataFrame, order_by: list[str], k: int, out: str = "fold",
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """k runs of consecutive rows; the first ``n % k`` folds are one row larger."""
    n = df.count()
    ends, at = [], 0
    for i in range(k - 1):
        at += n // k + (1 if i < n % k else 0)
        ends.append(at)
    wanted = sorted({e for e in ends if 0 < e < n})
    cut = order_thresholds(df, order_by, {None: wanted}, {None: n}, rows_per_task=rows_per_task) \
        if wanted else {}
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        if ends[i] >= n:
            fold = F.lit(i)
        elif ends[i] > 0:
            fold = F.when(at_or_before(df, order_by, cut[(None, ends[i])]), F.lit(i)).otherwise(fold)
    return df.withColumn(out, fold.cast("int"))
