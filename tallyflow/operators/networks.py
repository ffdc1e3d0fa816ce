"""Layered models and the feature transforms around them: wide perceptrons, corrupted inputs
with bottleneck features, restricted Boltzmann machine pre-training, fixed convolutions."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.functions import draw_below
from tallyflow.operators.classifiers import fit_perceptron
from tallyflow.operators.noise import keyed_uniform
from tallyflow.operators.sums import matrix_of, matrix_sums, vector_of


def noise_augment(df: DataFrame, cols: list[str], rate: float, seed, row_id: str) -> DataFrame:
    """Blank each value with probability ``rate``; kept values grow by ``1 / (1 - rate)``, so the
    mean stays. The draw depends on seed, row id and column name."""
    def noisy(c):
        return F.when(draw_below(rate, seed, F.col(row_id), c), F.lit(0.0)).otherwise(F.col(c) / F.lit(1.0 - rate))
    return df.select(*[noisy(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def perceptron_layers(model) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights in x out, bias) of every layer of a fitted perceptron."""
    flat, sizes, at, out = model.weights.toArray(), model.getLayers(), 0, []
    for a, b in zip(sizes[:-1], sizes[1:]):
        w = flat[at:at + a * b].reshape(a, b)
        out.append((w, flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def bottleneck_features(df: DataFrame, model, features: str, out: str = "code") -> DataFrame:
    """Activations of the narrowest hidden layer as an array column."""
    layers = perceptron_layers(model)
    hidden = model.getLayers()[1:-1]
    depth = int(np.argmin(hidden)) + 1

    @F.pandas_udf("array<double>")
    def encode(x: pd.Series) -> pd.Series:
        a = np.stack(x.to_numpy()).astype(np.float64)
        for w, b in layers[:depth]:
            a = _sigmoid(a @ w + b)
        return pd.Series(list(a))

    return df.withColumn(out, encode(vector_to_array(F.col(features))))


@dataclass
class BoltzmannModel:
    vec: str
    weights: np.ndarray       # visible x hidden
    visible: np.ndarray
    hidden: np.ndarray

    def transform(self, df: DataFrame, out: str = "hidden") -> DataFrame:
        w, b = self.weights, self.hidden

        @F.pandas_udf("array<double>")
        def activate(x: pd.Series) -> pd.Series:
            return pd.Series(list(_sigmoid(np.stack(x.to_numpy()).astype(np.float64) @ w + b)))

        return df.withColumn(out, activate(self.vec))


def rbm_fit(df: DataFrame, vec: str, row_id: str, hidden: int = 200, lr: float = 0.01, iters: int = 40,
            seed: int = 0) -> BoltzmannModel:
    """Restricted Boltzmann machine on inputs in [0, 1]. Each iteration is one pass: tasks sum
    the contrastive-divergence statistics of their rows and the mean gradient is applied. The
    Bernoulli draws depend on row id and iteration."""
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vec).alias("v"))
    d = rows.select(F.size("v")).first()[0]
    w = np.random.default_rng(seed).normal(0, 0.01, (d, hidden))
    a, b = np.zeros(d), np.zeros(hidden)
    for it in range(iters):
        shared = df.sparkSession.sparkContext.broadcast((w, a, b))

        def statistics(batch, it=it, shared=shared):
            w, a, b = shared.value
            v, ids = matrix_of(batch, "v"), vector_of(batch, "id")
            h = _sigmoid(v @ w + b)
            on = (keyed_uniform(ids, it, hidden, seed) < h).astype(np.float64)
            v2 = _sigmoid(on @ w.T + a)
            h2 = _sigmoid(v2 @ w + b)
            return {0: v.T @ h - v2.T @ h2, 1: (v - v2).sum(0), 2: (h - h2).sum(0), 3: [[float(len(v))]]}

        s = matrix_sums(rows, statistics)
        n = s[3][0, 0]
        w, a, b = w + lr * s[0] / n, a + lr * s[1][0] / n, b + lr * s[2][0] / n
        shared.unpersist()
    return BoltzmannModel(vec, w, a, b)


def fit_belief_net(train: DataFrame, vec: str, features: str, label: str, row_id: str, classes: int,
                   hidden: int = 200, lr: float = 0.01, iters: int = 40, seed: int = 0, **p):
    """Perceptron fine-tuned from RBM weights: the first layer starts from the pre-training,
    the output layer from small random weights."""
    rbm = rbm_fit(train, vec, row_id, hidden, lr, iters, seed)
    d = rbm.weights.shape[0]
    out = np.random.default_rng(seed).normal(0, 0.1, hidden * classes)
    start = Vectors.dense(np.concatenate([rbm.weights.ravel(), rbm.hidden, out, np.zeros(classes)]))
    return fit_perceptron(train, [d, hidden, classes], features, label, initialWeights=start, **p)


def conv_features(seq: str | Column, kernels: list[tuple[list[float], float]], pool: int = 2) -> Column:
    """1-D convolution (no padding), ReLU and max-pooling of an array column for every
    (weights, bias) kernel, the maps laid end to end. Incomplete pools at the end are dropped."""
    x = F.col(seq) if isinstance(seq, str) else seq

    def one(weights, bias):
        size = len(weights)

        def respond(i):
            total = F.lit(float(bias))
            for j, w in enumerate(weights):
                total = total + F.element_at(x, i + j) * F.lit(float(w))
            return F.greatest(F.lit(0.0), total)

        pools = F.sequence(F.lit(0), F.floor((F.size(x) - (size - 1)) / pool).cast("int") - 1)
        # each pool works out its own responses, so no map is built more than once
        return F.transform(pools, lambda j: F.array_max(F.array(*[respond(j * pool + i) for i in range(1, pool + 1)])))

    return F.flatten(F.array(*[one(w, b) for w, b in kernels]))


def conv_bank(df: DataFrame, seq: str, kernels: list[tuple[np.ndarray, np.ndarray]], pool: int = 2,
              out: str = "maps") -> DataFrame:
    """Stacked convolution layers with many filters, per Arrow batch. Layer l is
    (weights size x in x filters, bias filters), each followed by ReLU and max-pooling."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        a = np.stack(x.to_numpy()).astype(np.float64)[:, :, None]
        for w, b in kernels:
            steps = a.shape[1] - w.shape[0] + 1
            a = np.maximum(0.0, sum(a[:, j:j + steps] @ w[j] for j in range(w.shape[0])) + b)
            whole = steps // pool * pool
            a = a[:, :whole].reshape(len(a), whole // pool, pool, -1).max(axis=2)
        return pd.Series(list(a.reshape(len(a), -1)))

    return df.withColumn(out, apply(seq))


def random_kernels(filters: list[int], size: int = 3, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeded kernels for ``conv_bank``, scaled by the fan-in."""
    rng, prev, out = np.random.default_rng(seed), 1, []
    for f in filters:
        out.append((rng.normal(0, np.sqrt(2.0 / (size * prev)), (size, prev, f)), rng.normal(0, 0.01, f)))
        prev = f
    return out
