"""Evaluation by aggregation. Only the class-by-class counts, never rows, leave the map side."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyflow.operators.ranking import ROWS_PER_TASK, running_totals
from tallyflow.sources.storage import durable


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Matches, rows and their ratio."""
    hit = F.sum((F.col(y) == F.col(p)).cast("int")).cast("bigint")
    n = F.count(F.lit(1)).cast("bigint")
    return df.agg(hit.alias("n_correct"), n.alias("n_rows"), (hit / n).alias("accuracy"))


def _cells(df: DataFrame, y: str, p: str) -> DataFrame:
    maybe = lambda c: F.when(F.col(c).isNotNull(), F.col(c))  # noqa: E731  both sides nullable alike
    return df.groupBy(maybe(y).alias("y"), maybe(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """Long form (truth, predicted, n) over every class seen on either side, zero cells kept.

    The rows are reduced to class-pair counts first; the zero cells are added by walking the
    sorted class list inside one record of classes x classes counts."""
    gathered = _cells(df, y, p).agg(F.collect_list(F.struct("y", "p", "n")).alias("c"))
    listed = gathered.select(
        F.array_sort(F.array_distinct(F.concat(F.transform("c", lambda s: s["y"]),
                                               F.transform("c", lambda s: s["p"])))).alias("classes"),
        F.map_from_entries(F.transform("c", lambda s: F.struct(F.struct(s["y"].alias("y"), s["p"].alias("p")), s["n"]))).alias("m"))
    truths = listed.select("m", "classes", F.explode("classes").alias("truth"))
    cells = truths.select("m", "truth", F.explode("classes").alias("predicted"))
    return cells.select("truth", "predicted",
                        F.coalesce(F.element_at("m", F.struct(F.col("truth").alias("y"), F.col("predicted").alias("p"))), F.lit(0))
                        .cast("bigint").alias("n"))


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, then accuracy, macro and weighted averages.
    0/0 counts as 0. Rows: one per class, plus ``accuracy``, ``macro avg``, ``weighted avg``."""
    cells = _cells(df, y, p)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").cast("string").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("claimed"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("support", "claimed", "hit")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = (per.withColumn("precision", ratio(F.col("hit"), F.col("claimed")))
           .withColumn("recall", ratio(F.col("hit"), F.col("support"))))
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))
    total = F.sum("support")
    metric = ("precision", "recall", "f1")
    averages = per.agg(total.cast("bigint").alias("support"), (F.sum("hit") / total).alias("acc"),
                       *[F.avg(m).alias(f"m_{m}") for m in metric],
                       *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"w_{m}") for m in metric])
    line = lambda name, cols: F.struct(
        F.lit(name).alias("class"), *[F.col(c).alias(m) for m, c in zip(metric, cols)],
        F.col("support").alias("support"))
    summary = averages.select(F.inline(F.array(
        line("accuracy", ["acc"] * 3), line("macro avg", [f"m_{m}" for m in metric]),
        line("weighted avg", [f"w_{m}" for m in metric]))))
    return per.select("class", *metric, "support").unionByName(summary)


def log_loss(df: DataFrame, y: str, prob: str, eps: float = 1e-15, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean negative log probability of the true class, per group of ``by`` if given; ``prob`` is an array per class code."""
    p = F.element_at(F.col(prob), F.col(y).cast("int") + 1)
    held = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    mean = (-F.avg(F.log(held))).alias("log_loss")
    return df.groupBy(*by).agg(mean) if by else df.agg(mean)


def binary_log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    held = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(p)))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.log(held)).otherwise(F.log(1 - held)))).alias("log_loss"))


def binary_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of class 1."""
    one = lambda c: F.sum(c.cast("int")).cast("bigint")
    t, q = F.col(y) == 1, F.col(p) == 1
    s = df.agg(one(t & q).alias("tp"), one(~t & q).alias("fp"), one(t & ~q).alias("fn"), one(~t & ~q).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"))


def _per_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positive and negative rows per distinct score; rows whose score is null or NaN have no rank and are left
    out. Stored once: the ranges, their totals and the running sums all read it, and the source is scanned a single time."""
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return durable(df.filter(known).groupBy(F.col(score).alias("threshold")).agg(
        F.sum((F.col(y) == 1).cast("int")).cast("bigint").alias("pos"),
        F.sum((F.col(y) != 1).cast("int")).cast("bigint").alias("neg")))


def roc_curve(df: DataFrame, y: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score, from the highest down."""
    per = _per_score(df, y, score)
    total = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    run = running_totals(per, "threshold", ["pos", "neg"], descending=True, rows_per_task=rows_per_task)
    share = lambda c, n: (F.col(c) / F.lit(float(n)) if n else F.lit(0.0))
    return run.select("threshold", F.col("cum_pos").cast("bigint").alias("tp"),
                      F.col("cum_neg").cast("bigint").alias("fp"),
                      share("cum_pos", total["p"]).alias("tpr"), share("cum_neg", total["n"]).alias("fpr"))


def roc_auc(df: DataFrame, y: str, score: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Chance that a positive row scores above a negative one, ties counted half."""
    per = _per_score(df, y, score)
    run = running_totals(per, "threshold", ["pos"], descending=True, rows_per_task=rows_per_task)
    above = (F.col("cum_pos") - F.col("pos")).cast("double") + F.col("pos") / 2.0
    return run.agg((F.sum(F.col("neg") * above) / (F.sum("pos").cast("double") * F.sum("neg").cast("double")))
                   .alias("auc"))


def rmse(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), 2))).alias("rmse"))


def sorted_predictions(df: DataFrame, p: str, row_id: str) -> DataFrame:
    """All rows from the highest prediction down, ids breaking ties."""
    return df.orderBy(F.col(p).desc(), F.col(row_id).asc())
