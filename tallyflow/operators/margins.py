"""Penalised linear classifiers fitted many at a time: every fold, class and penalty advances in the same pass.

A task (C, penalty, fold, loss) is a one-against-rest classifier: for each class the sum over the rows outside its fold of
``C * loss(y * f)`` plus half the squared weights (L2) or their absolute sum (L1). The intercept is the weight of a constant
feature and is penalised as the others. Each pass gives every open problem its loss, gradient and curvature at a trial point;
the driver then takes a proximal Newton step on the d x d model, or halves the last step if the loss did not fall as it should.
Columns are scaled to unit spread for the steps, with penalties in the original units, so the optimum is that of the data as they
are; nothing divides by a spread of zero. Rows are read once into memory (or executor disks) for all passes.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallyflow.functions import argmax
from tallyflow.operators.passes import held
from tallyflow.operators.sums import arrow_lists, matrix_of, matrix_sums, vector_of

#: Bytes of curvature matrices a Python worker adds up at once; more problems are advanced in turns.
CURVATURE_BYTES = 128 << 20
#: Rows mapped at once.
MAP_ROWS = 1_000


@dataclass(frozen=True)
class Task:
    C: float = 1.0
    penalty: str = "l2"
    fold: int | None = None
    loss: str = "squared_hinge"

    def __post_init__(self):
        if self.penalty not in ("l1", "l2") or self.loss not in ("squared_hinge", "logistic") or not self.C > 0:
            raise ValueError(f"no such task: {self}")


def _loss(kind: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature by margin."""
    if kind == "squared_hinge":
        gap = np.maximum(0.0, 1.0 - m)
        return gap * gap, -2.0 * gap, 2.0 * (gap > 0)
    p = 0.5 * (1.0 - np.tanh(0.5 * m))
    return np.logaddexp(0.0, -m), -p, p * (1.0 - p)


def _as_array(df: DataFrame, vec: str) -> Column:
    return vector_to_array(F.col(vec)) if dict(df.dtypes)[vec] == "vector" else F.col(vec).cast("array<double>")


@dataclass
class LinearModel:
    """Margins ``x @ weights + bias`` per class as the vector ``rawPrediction``; the largest wins, the first of ties. With a fold
    column, row r is scored by the model fitted without r's fold."""
    vec: str
    weights: np.ndarray            # folds x d x classes
    bias: np.ndarray               # folds x classes
    fold_col: str | None = None
    folds: tuple[int, ...] = ()

    def margins(self, x: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
        if self.fold_col is None:
            return x @ self.weights[0] + self.bias[0]
        out = np.empty((len(x), self.bias.shape[1]))
        at = np.searchsorted(self.folds, fold)
        for i in np.unique(at):
            out[at == i] = x[at == i] @ self.weights[i] + self.bias[i]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        carried = df.drop("rawPrediction", "prediction").withColumn("_x", _as_array(df, self.vec)).withColumn(
            "_fold", F.col(self.fold_col).cast("bigint") if self.fold_col else F.lit(0).cast("bigint"))
        schema = StructType([*carried.schema.fields[:-2], StructField("_margins", ArrayType(DoubleType()))])

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    m = self.margins(matrix_of(batch, "_x"), vector_of(batch, "_fold"))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-2], arrow_lists(m)], names=schema.names)

        out = carried.mapInArrow(run, schema)
        return out.withColumn("rawPrediction", array_to_vector("_margins")).withColumn("prediction", argmax("_margins").cast("double")).drop("_margins")


class _Problem:
    """One task and class on the driver: weights in scaled units, the accepted point and the trial."""

    def __init__(self, task: Task, sign_class: int, scale: np.ndarray):
        self.task, self.cls = task, sign_class
        self.weight = scale                      # original weight = scaled weight * this
        self.at = np.zeros(len(scale))
        self.value, self.trial, self.step, self.slope = np.inf, self.at.copy(), None, 0.0
        self.shrink, self.done, self.passes = 1.0, False, 0

    def penalty(self, u: np.ndarray) -> float:
        w = u * self.weight
        return float(np.abs(w).sum() if self.task.penalty == "l1" else 0.5 * w @ w)

    def advance(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, tol: float) -> None:
        """Accept or shorten the trial, then choose the next one."""
        self.passes += 1
        C = self.task.C
        value = C * loss + self.penalty(self.trial)
        if self.step is not None and not value <= self.value + 1e-4 * self.shrink * self.slope + 1e-12 * abs(self.value):
            self.shrink *= 0.5
            if self.shrink < 1e-8:
                self.done = True
            self.trial = self.at + self.shrink * self.step
            return
        self.at, self.value = self.trial, value
        g, h = C * gradient, C * curvature
        u = self._minimum(g, h)
        self.step, self.shrink = u - self.at, 1.0
        quadratic = 0.5 * self.step @ h @ self.step
        self.slope = float(g @ self.step) + self.penalty(u) - self.penalty(self.at)
        if -(self.slope + quadratic) <= tol * max(1.0, abs(value)) or not np.any(self.step):
            self.done = True
        self.trial = u

    def _minimum(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Minimum of the quadratic model of the loss plus the penalty."""
        s = self.weight
        if self.task.penalty == "l2":
            return np.linalg.solve(h + np.diag(s * s) + 1e-12 * np.eye(len(s)), h @ self.at - g)
        u, grad = self.at.copy(), g.copy()
        diag = np.diag(h) + 1e-12
        for _ in range(1000):
            moved = 0.0
            for j in range(len(u)):
                z = u[j] - grad[j] / diag[j]
                new = np.sign(z) * max(0.0, abs(z) - s[j] / diag[j])
                if new != u[j]:
                    grad += h[:, j] * (new - u[j])
                    moved = max(moved, abs(new - u[j]) * np.sqrt(diag[j]))
                    u[j] = new
            if moved <= 1e-10 * (1.0 + np.sqrt(abs(self.value))):
                break
        return u


def fit_margins(df: DataFrame, vec: str, label: str, tasks: list[Task], classes: int, fold_col: str | None = None, tol: float = 1e-9,
                passes: int = 200, mapping: Callable | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights d x classes, bias) of every task. Two classes are one problem with opposite margins. Rows with a null or NaN
    feature or label are refused. Problems still open after ``passes`` passes raise an error. With ``mapping``, a function of a matrix of
    rows, the classifiers are those of the mapped rows: only rows as they are, often far narrower, are held, and every pass maps them."""
    cols = [_as_array(df, vec).alias("x"), F.col(label).cast("double").alias("y"),
            (F.col(fold_col).cast("bigint") if fold_col else F.lit(-1).cast("bigint")).alias("fold")]
    if fold_col is None and any(t.fold is not None for t in tasks):
        raise ValueError("tasks with a fold need a fold column")
    with held(df.select(*cols)) as rows:
        first = matrix_sums(rows, lambda batch: {0: sum(_moments(x, y) for x, y, _ in _mapped_parts(batch, mapping))})
        if not first:
            raise ValueError("no rows to fit")
        n, sx, sxx = first[0][0, 0], first[0][1], first[0][2]
        spread = np.sqrt(np.maximum(sxx / n - (sx / n) ** 2, 0.0))
        size = np.sqrt(sxx / n)
        scale = np.where(spread > 1e-12 * size, spread, np.where(size > 0, size, 1.0))
        per = np.append(1.0 / scale, 1.0)
        codes = [1] if classes == 2 else list(range(classes))
        problems = [_Problem(t, c, per) for t in tasks for c in codes]
        at_once = max(1, CURVATURE_BYTES // (8 * (len(per) + 2) ** 2))
        for turn in range(0, len(problems), at_once):
            _solve(rows, problems[turn:turn + at_once], per, tol, passes, mapping)
    out = []
    for i in range(len(tasks)):
        w = np.stack([p.at * p.weight for p in problems[i * len(codes):(i + 1) * len(codes)]], 1)
        if classes == 2:
            w = np.hstack([-w, w])
        out.append((w[:-1], w[-1]))
    return out


def _mapped_parts(batch: pa.RecordBatch, mapping: Callable | None):
    """(features, labels, folds) of a batch, or of a few of its rows at a time if they are mapped."""
    x, y, fold = matrix_of(batch, "x"), vector_of(batch, "y"), vector_of(batch, "fold")
    if mapping is None:
        yield x, y, fold
        return
    for at in range(0, len(x), MAP_ROWS):
        yield mapping(x[at:at + MAP_ROWS]), y[at:at + MAP_ROWS], fold[at:at + MAP_ROWS]


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not (np.isfinite(x).all() and np.isfinite(y.astype(np.float64)).all()):
        raise ValueError("features and labels must be finite numbers")
    return np.vstack([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0)])


def _solve(rows: DataFrame, problems: list[_Problem], per: np.ndarray, tol: float, passes: int, mapping: Callable | None = None) -> None:
    for _ in range(passes):
        live = {i: (p.task, p.cls, p.trial) for i, p in enumerate(problems) if not p.done}
        if not live:
            return
        shared = rows.sparkSession.sparkContext.broadcast(live)

        def sums(batch, shared=shared):
            out = {}
            for x, y, fold in _mapped_parts(batch, mapping):
                x = np.hstack([x * per[:-1], np.ones((len(x), 1))])
                for i, (task, cls, u) in shared.value.items():
                    rows_of = x if task.fold is None else x[fold != task.fold]
                    sign = np.where((y if task.fold is None else y[fold != task.fold]) == cls, 1.0, -1.0)
                    value, slope, curve = _loss(task.loss, sign * (rows_of @ u))
                    live_rows = curve > 0
                    some = rows_of[live_rows]
                    h = (some * curve[live_rows, None]).T @ some
                    head = np.zeros(len(u))
                    head[0] = value.sum()
                    found = np.vstack([head, (slope * sign) @ rows_of, h])
                    out[i] = out[i] + found if i in out else found
            return out

        for i, m in matrix_sums(rows, sums).items():
            problems[i].advance(m[0, 0], m[1], m[2:], tol)
        shared.unpersist()
    if any(not p.done for p in problems):
        raise RuntimeError(f"not settled in {passes} passes")


def fit_linear(df: DataFrame, vec: str = "features", label: str = "y", classes: int | None = None, task: Task = Task(), **options) -> LinearModel:
    """One classifier on all rows. Without ``classes`` they are 0 to the largest label."""
    w, b = fit_margins(df, vec, label, [task], classes or _classes(df, label), **options)[0]
    return LinearModel(vec, w[None], b[None])


def fit_linear_folds(df: DataFrame, fold_col: str, vec: str = "features", label: str = "y", classes: int | None = None, task: Task = Task(),
                     **options) -> LinearModel:
    """One classifier per fold, fitted without it in shared passes; ``transform`` scores every row by its own fold's, in one pass."""
    folds = _folds(df, fold_col)
    tasks = [Task(task.C, task.penalty, f, task.loss) for f in folds]
    fits = fit_margins(df, vec, label, tasks, classes or _classes(df, label), fold_col, **options)
    return LinearModel(vec, np.stack([w for w, _ in fits]), np.stack([b for _, b in fits]), fold_col, tuple(folds))


def linear_grid(df: DataFrame, fold_col: str, grid: list[Task], vec: str = "features", label: str = "y", classes: int | None = None, **options) -> DataFrame:
    """(loss, penalty, C, accuracy, is_best): mean accuracy over the folds of every grid point, all points and folds fitted in shared
    passes and scored in one. The first of equal accuracies is best."""
    folds = _folds(df, fold_col)
    k = classes or _classes(df, label)
    tasks = [Task(t.C, t.penalty, f, t.loss) for t in grid for f in folds]
    fits = fit_margins(df, vec, label, tasks, k, fold_col, **options)
    models = df.sparkSession.sparkContext.broadcast([LinearModel(vec, np.stack([w for w, _ in fits[i:i + len(folds)]]), np.stack([b for _, b in fits[i:i + len(folds)]]), "f", tuple(folds))
                                                     for i in range(0, len(fits), len(folds))])

    def hits(batch):
        x, y, fold = matrix_of(batch, "x"), vector_of(batch, "y"), vector_of(batch, "fold")
        at = np.searchsorted(folds, fold)
        good = [np.bincount(at, m.margins(x, fold).argmax(axis=1) == y, len(folds)) for m in models.value]
        return {0: np.vstack([np.bincount(at, minlength=len(folds)), *good])}

    rows = df.select(_as_array(df, vec).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold_col).cast("bigint").alias("fold"))
    counts = matrix_sums(rows, hits)[0]
    share = (counts[1:] / counts[0]).mean(axis=1)
    best = int(np.argmax(share))
    found = [(t.loss, t.penalty, float(t.C), float(share[i]), i == best) for i, t in enumerate(grid)]
    return df.sparkSession.createDataFrame(found, "loss string, penalty string, C double, accuracy double, is_best boolean")


def _classes(df: DataFrame, label: str) -> int:
    return int(df.agg(F.max(label)).first()[0]) + 1


def _folds(df: DataFrame, fold_col: str) -> list[int]:
    return sorted(int(r[0]) for r in df.select(fold_col).distinct().collect())
