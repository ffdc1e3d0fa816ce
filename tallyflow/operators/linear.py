"""Closed-form models fitted from one pass of matrix sums: ridge readouts, linear discriminant
analysis and principal components. Only d x d matrices reach the driver."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.functions import argmax, round_half_even
from tallyflow.operators.prepare import one_hot
from tallyflow.operators.sums import augmented_gram, matrix_sums


def affine(vec: str | Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """``x @ weights + bias`` as an array column, computed per Arrow batch."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()).astype(np.float64) @ weights + bias)) if len(x) else x

    return apply(vec)


def ridge_solve(gram: np.ndarray, d: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (d x t) and intercepts from the augmented sums; the intercept is not penalised."""
    n, sx, st = gram[0, 0], gram[0, 1:d + 1], gram[0, d + 1:]
    xx = gram[1:d + 1, 1:d + 1] - np.outer(sx, sx) / n
    xt = gram[1:d + 1, d + 1:] - np.outer(sx, st) / n
    a = xx + alpha * np.eye(d)
    weights = np.linalg.solve(a, xt) if alpha > 0 else np.linalg.lstsq(a, xt, rcond=None)[0]
    return weights, st / n - (sx / n) @ weights


#: Columns of a sketch, and bytes of it that one pass sums.
_SKETCH, _SKETCH_BYTES = 512, 16 << 20


def ridge_free(rows: DataFrame, features: Callable, targets: Callable, alpha: float, tol: float = 1e-8) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ridge weights (d x t) and intercepts per key without a d x d matrix: conjugate gradients, one pass of ``X' (X P)``
    over the rows a step for all keys and targets together. Steps are preconditioned with the leading directions of the scatter,
    found from its product with ``_SKETCH`` random columns at most (a Nystrom sketch, in passes of ``_SKETCH_BYTES``), so that their number
    depends on what the sketch leaves over, not on the largest direction. ``features(batch)``
    gives {key: n x d}, ``targets(batch)`` n x t. A target is settled when its residual is below ``tol`` of its right side;
    ``alpha`` must be positive. What a task sends is t x d numbers a key or a part of the sketch; the driver holds the sketch of every key."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")

    def moments(batch):
        t = targets(batch)
        out = {key: np.vstack([x.sum(0), t.T @ x]) for key, x in features(batch).items()}
        return {**out, -1: [[float(len(t)), *t.sum(0)]]}

    first = matrix_sums(rows, moments)
    n, st = first[-1][0, 0], first[-1][0, 1:]
    mean = {key: g[0] / n for key, g in first.items() if key >= 0}
    right = {key: first[key][1:].T - np.outer(m, st) for key, m in mean.items()}

    def scatter(at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Product of the centred scatter with ``at[key]`` (d x any), in one pass."""
        shared = rows.sparkSession.sparkContext.broadcast(at)

        def products(batch):
            return {key: (x.T @ (x @ shared.value[key])).T for key, x in features(batch).items() if key in shared.value}

        sums = matrix_sums(rows, products)
        shared.unpersist()
        return {key: g.T - n * np.outer(mean[key], mean[key] @ at[key]) for key, g in sums.items()}

    leading = _leading({key: len(m) for key, m in mean.items()}, scatter, alpha)

    def conditioned(key: int, r: np.ndarray) -> np.ndarray:
        u, values = leading[key]
        return r + u @ (((values[-1] + alpha) / (values + alpha) - 1)[:, None] * (u.T @ r)) if len(values) else r

    w, p, rz, best = {}, {}, {}, {}
    for key, r in right.items():
        best[key] = tol * np.linalg.norm(r, axis=0)
        w[key] = np.zeros_like(r)
        p[key] = conditioned(key, r)
        rz[key] = np.sum(r * p[key], axis=0)
    rest = dict(right)
    size = max((len(r) for r in right.values()), default=0)
    for _ in range(10 * size + 10):
        open_ = {key: np.linalg.norm(rest[key], axis=0) > best[key] for key in rest}
        at = {key: p[key] * o for key, o in open_.items() if o.any()}
        if not at:
            break
        for key, g in scatter(at).items():
            o = open_[key]
            q = g + alpha * at[key]
            step = np.where(o, rz[key] / np.where(o, np.sum(at[key] * q, axis=0), 1.0), 0.0)
            w[key] = w[key] + step * at[key]
            rest[key] = rest[key] - step * q
            z = conditioned(key, rest[key])
            new = np.sum(rest[key] * z, axis=0)
            p[key] = z + np.where(o, new / np.where(o, rz[key], 1.0), 0.0) * p[key]
            rz[key] = np.where(o, new, rz[key])
    else:
        raise RuntimeError("conjugate gradients did not settle")
    return {key: (w[key], st / n - mean[key] @ w[key]) for key in w}


def _leading(sizes: dict[int, int], scatter: Callable, alpha: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Approximate leading eigenvectors and values (falling) of every key's scatter. A sketch grows by parts until it holds
    half of the dimensions or ``_SKETCH`` columns, or its least value is below ``alpha``, where more of it would not save a step."""
    drawn = {key: np.zeros((d, 0)) for key, d in sizes.items()}
    image, found = dict(drawn), {key: (m, np.zeros(0)) for key, m in drawn.items()}
    part = max(1, _SKETCH_BYTES // (8 * max(1, sum(sizes.values()))))
    open_ = set(sizes)
    while open_:
        new = {}
        for key in sorted(open_):
            d, have = drawn[key].shape
            new[key] = np.random.default_rng([17, key, have]).standard_normal((d, min(part, max(0, min(_SKETCH, d // 2) - have))))
        new = {key: m for key, m in new.items() if m.shape[1]}
        open_ = set(new)
        if not new:
            break
        for key, y in scatter(new).items():
            drawn[key], image[key] = np.hstack([drawn[key], new[key]]), np.hstack([image[key], y])
            found[key] = _nystrom(drawn[key], image[key])
            if len(found[key][1]) < drawn[key].shape[1] or found[key][1][-1] < alpha:
                open_.discard(key)
    return found


def _nystrom(drawn: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and values of the matrix that ``image`` = A @ ``drawn`` tells of the positive semidefinite A."""
    none = np.zeros((len(drawn), 0)), np.zeros(0)
    if not np.isfinite(image).all():
        return none
    q, r = np.linalg.qr(drawn)
    y = np.linalg.solve(r.T, image.T).T
    core = q.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-12 * max(values[-1], 0.0)
    if not keep.any():
        return none
    u, s, _ = np.linalg.svd((y @ vectors[:, keep]) / np.sqrt(values[keep]), full_matrices=False)
    return u, s * s


@dataclass
class RidgeModel:
    """Linear readout. With several targets ``prediction`` is the largest score's position;
    with one target it is the score rounded to the nearest class code."""
    vec: str
    weights: np.ndarray
    bias: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("scores", affine(self.vec, self.weights, self.bias))
        if self.weights.shape[1] == 1:
            return out.withColumn("prediction", round_half_even(F.element_at("scores", 1)))
        return out.withColumn("prediction", argmax("scores"))


def ridge_fit(df: DataFrame, vec: str, targets: str, alpha: float = 1.0) -> RidgeModel:
    """Ridge regression of the array ``targets`` on the array ``vec``."""
    d = df.select(F.size(vec)).first()[0]
    return RidgeModel(vec, *ridge_solve(augmented_gram(df, vec, targets), d, alpha))


def ridge_classifier(df: DataFrame, vec: str, label: str, k: int, alpha: float = 1.0) -> RidgeModel:
    return ridge_fit(one_hot(df, label, k, "_t"), vec, "_t", alpha)


def ridge_code(df: DataFrame, vec: str, label: str, alpha: float = 1.0) -> RidgeModel:
    """Regression on the class code itself, to be rounded."""
    return ridge_fit(df.withColumn("_t", F.array(F.col(label).cast("double"))), vec, "_t", alpha)


@dataclass
class DiscriminantModel:
    vec: str
    weights: np.ndarray
    bias: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("scores", affine(self.vec, self.weights, self.bias))
        top = scored.withColumn("_e", F.transform("scores", lambda s: F.exp(s - F.array_max("scores"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
        return (top.withColumn("probability", F.transform("_e", lambda e: e / total)).drop("_e")
                .withColumn("prediction", argmax("probability")))


def discriminant_fit(df: DataFrame, vec: str, label: str, k: int) -> DiscriminantModel:
    """Linear discriminant analysis with a pooled covariance. Class sizes, class sums and the
    pooled scatter all come out of the same augmented sums. Classes without rows are never
    predicted; directions without spread inside the classes are ignored."""
    g = augmented_gram(one_hot(df, label, k, "_t"), vec, "_t")
    d = g.shape[0] - 1 - k
    n, sizes, sums = g[0, 0], g[0, d + 1:], g[1:d + 1, d + 1:]
    seen = sizes > 0
    means = np.where(seen, sums / np.where(seen, sizes, 1), 0.0)
    within = g[1:d + 1, 1:d + 1] - (means * sizes) @ means.T
    cov = within / max(n - seen.sum(), 1)
    weights = np.linalg.pinv(cov, rcond=1e-10, hermitian=True) @ means
    bias = np.where(seen, -0.5 * np.sum(means * weights, axis=0)
                    + np.log(np.where(seen, sizes, 1) / n), -np.inf)
    return DiscriminantModel(vec, weights, np.where(seen, bias, -1e300))


@dataclass
class ComponentsModel:
    vec: str
    mean: np.ndarray
    components: np.ndarray   # d x k
    variance: np.ndarray

    def transform(self, df: DataFrame, out: str = "projected") -> DataFrame:
        return df.withColumn(out, affine(self.vec, self.components, -self.mean @ self.components))


def components_of(n: float, sx: np.ndarray, xx: np.ndarray, k: int | None
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, leading eigenvectors and variances from plain sums. Each component's entry of
    largest size is made positive, which fixes the sign."""
    mean = sx / n
    cov = (xx - np.outer(sx, sx) / n) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1][:k or len(values)]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return mean, vectors * np.where(signs == 0, 1, signs), values[order]


def pca_fit(df: DataFrame, vec: str, k: int | None = None) -> ComponentsModel:
    """Principal components of an array column, on centred data."""
    g = augmented_gram(df, vec)
    return ComponentsModel(vec, *components_of(g[0, 0], g[0, 1:], g[1:, 1:], k))


def pca_project(df: DataFrame, model: ComponentsModel, out: str = "projected") -> DataFrame:
    return model.transform(df, out)
