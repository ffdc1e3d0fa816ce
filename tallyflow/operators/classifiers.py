"""Classifiers on Spark ML. Every ``fit_*`` takes a frame with a feature vector and a numeric
class code and returns a model whose ``transform`` adds ``prediction`` and, where the method
defines one, ``probability``."""
from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.functions import argmax
from tallyflow.operators.combine import union_slices
from tallyflow.operators.margins import MAP_ROWS as _MAP_ROWS, Task, fit_linear, fit_linear_folds
from tallyflow.operators.passes import held
from tallyflow.operators.sums import arrow_lists

PARALLEL_FITS = 4


def decision_tree(features="features", label="y", **p):
    return DecisionTreeClassifier(featuresCol=features, labelCol=label, **{"maxDepth": 20, "seed": 0, **p})


def random_forest(features="features", label="y", **p):
    return RandomForestClassifier(featuresCol=features, labelCol=label, **{"numTrees": 100, "seed": 0, **p})


def extra_trees(features="features", label="y", **p):
    """Forest grown on all rows with random feature subsets per split. Split points are still
    optimised over bins rather than drawn at random."""
    return random_forest(features, label, **{"bootstrap": False, "featureSubsetStrategy": "sqrt", **p})


def logistic_regression(features="features", label="y", C: float = 1.0, n: int | None = None, **p):
    """``C`` is the inverse penalty on the summed loss; Spark's penalty is per row, so it needs
    the row count ``n``. Without ``n`` the fit is unpenalised."""
    reg = {"regParam": 1.0 / (C * n)} if n else {}
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                              **{"maxIter": 100, "standardization": False, **reg, **p})


def linear_svm(features="features", label="y", C: float = 1.0, n: int | None = None, parallelism: int = PARALLEL_FITS, **p):
    reg = {"regParam": 1.0 / (C * n)} if n else {}
    base = LinearSVC(**{"maxIter": 50, "standardization": False, **reg, **p})
    return OneVsRest(classifier=base, featuresCol=features, labelCol=label, parallelism=parallelism)


def perceptron(layers: list[int], features="features", label="y", **p):
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers,
                                          **{"maxIter": 100, "seed": 0, **p})


def fit_held(estimator, train: DataFrame):
    """Fit with the training columns held for the passes of the fit."""
    with held(train.select(estimator.getFeaturesCol(), estimator.getLabelCol())) as rows:
        return estimator.fit(rows)


def fit_decision_tree(train, features="features", label="y", **p):
    return fit_held(decision_tree(features, label, **p), train)


def fit_random_forest(train, features="features", label="y", **p):
    return fit_held(random_forest(features, label, **p), train)


def fit_extra_trees(train, features="features", label="y", **p):
    return fit_held(extra_trees(features, label, **p), train)


def fit_logistic_regression(train, features="features", label="y", C=None, **p):
    n = train.count() if C else None
    return fit_held(logistic_regression(features, label, C or 1.0, n, **p), train)


def fit_linear_svm(train, features="features", label="y", C: float = 1.0, penalty: str = "l2", **options):
    """Squared-hinge classifiers of all classes, fitted in shared passes."""
    return fit_linear(train, features, label, task=Task(C, penalty), **options)


def fit_perceptron(train, layers, features="features", label="y", **p):
    return fit_held(perceptron(layers, features, label, **p), train)


# ---- kernel machines through random features -------------------------------------------------

def _mapped(vec: str | Column, features) -> Column:
    """``features`` of matrices of a few rows each, without a Python object per row."""
    def mapped(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return arrow_lists(features(flat.reshape(len(x), -1)))

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        return pa.concat_arrays([mapped(x.slice(at, _MAP_ROWS)) for at in range(0, len(x), _MAP_ROWS)] or [pa.array([], pa.list_(pa.float64()))])

    return apply(vec)


def fourier_features(d: int, size: int, gamma: float, seed: int):
    """A function of rows to random Fourier features, whose inner products approximate ``exp(-gamma |x-y|^2)``."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(d, size))
    b = rng.uniform(0, 2 * np.pi, size)

    return lambda x: np.sqrt(2.0 / size) * np.cos(x @ w + b)


def fourier_map(vec: str | Column, d: int, size: int, gamma: float, seed: int) -> Column:
    return _mapped(vec, fourier_features(d, size, gamma, seed))


def polynomial_features(d: int, size: int, gamma: float, degree: int, seed: int):
    """A function of rows to random product features, whose inner products approximate ``(gamma <x,y>)^degree``."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(degree, d, size))

    def products(x):
        z = np.ones((len(x), size))
        for s in signs:
            z *= (x * np.sqrt(gamma)) @ s
        return z / np.sqrt(size)

    return products


def polynomial_map(vec: str | Column, d: int, size: int, gamma: float, degree: int, seed: int) -> Column:
    return _mapped(vec, polynomial_features(d, size, gamma, degree, seed))


class MappedModel:
    """A fitted model behind a feature map on an array column."""

    def __init__(self, mapping, model, features):
        self.mapping, self.model, self.features = mapping, model, features

    def transform(self, df: DataFrame) -> DataFrame:
        mapped = df.withColumn(self.features, array_to_vector(self.mapping()))
        return self.model.transform(mapped).drop(self.features)


def _spread(train: DataFrame, vec: str) -> tuple[int, float]:
    """Length of the arrays and the variance over all their entries."""
    x = F.col(vec).cast("array<double>")
    add = lambda f: F.sum(F.aggregate(F.transform(x, f), F.lit(0.0), lambda a, v: a + v))
    r = train.agg(F.max(F.size(vec)).alias("d"), F.sum(F.size(vec)).alias("n"),
                  add(lambda v: v).alias("s"), add(lambda v: v * v).alias("q")).first()
    mean = r["s"] / r["n"]
    return r["d"], r["q"] / r["n"] - mean * mean


def fit_rbf_svm(train: DataFrame, vec: str, label: str = "y", C: float = 1.0, gamma: float | None = None,
                size: int = 256, seed: int = 0, **p) -> MappedModel:
    """Gaussian-kernel SVM approximated by a linear SVM on random Fourier features. The default
    width is ``1 / (d * variance)``."""
    d, var = _spread(train, vec)
    width = gamma if gamma is not None else 1.0 / (d * var if var > 0 else d)
    return _behind(fourier_features(d, size, width, seed), vec, lambda f: fit_linear_svm(train, vec, label, C, mapping=f, **p))


def _behind(features, vec: str, fit: Callable) -> MappedModel:
    """The model that ``fit`` makes of mapped rows, behind their map."""
    model = fit(features)
    model.vec = "_mapped"
    return MappedModel(lambda: _mapped(vec, features), model, "_mapped")


def rbf_svm_folds(df: DataFrame, fold_col: str, vec: str, label: str = "y", C: float = 1.0, gamma: float | None = None, size: int = 256,
                  seed: int = 0, **options) -> MappedModel:
    """Gaussian-kernel SVM per fold, all fitted without their fold in shared passes; every row is scored by its own fold's model. The
    default width comes from all rows, labels and folds apart."""
    d, var = _spread(df, vec)
    width = gamma if gamma is not None else 1.0 / (d * var if var > 0 else d)
    return _behind(fourier_features(d, size, width, seed), vec, lambda f: fit_linear_folds(df, fold_col, vec, label, task=Task(C), mapping=f, **options))


def fit_poly_svm(train: DataFrame, vec: str, label: str = "y", C: float = 1.0, degree: int = 3,
                 gamma: float | None = None, size: int = 256, seed: int = 0, **p) -> "CalibratedModel":
    """Polynomial-kernel SVM on random product features, with calibrated probabilities."""
    d = train.select(F.max(F.size(vec))).first()[0]
    svm = _behind(polynomial_features(d, size, gamma or 1.0 / d, degree, seed), vec, lambda f: fit_linear_svm(train, vec, label, C, mapping=f, **p))
    return calibrate(svm, train, label)


# ---- calibration and voting ------------------------------------------------------------------

class CalibratedModel:
    def __init__(self, base, curves: list[tuple[float, float]], margin: str):
        self.base, self.curves, self.margin = base, curves, margin

    def transform(self, df: DataFrame) -> DataFrame:
        m = vector_to_array(F.col(self.margin))
        parts = [1.0 / (1.0 + F.exp(-(F.lit(a) * F.element_at(m, i + 1) + F.lit(b))))
                 for i, (a, b) in enumerate(self.curves)]
        scored = self.base.transform(df).withColumn("_p", F.array(*parts))
        total = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v)
        share = F.transform("_p", lambda v: F.when(total > 0, v / total).otherwise(1.0 / len(parts)))
        return scored.drop("prediction").withColumn("probability", share).drop("_p") \
            .withColumn("prediction", argmax("probability").cast("double"))


def calibrate(base, df: DataFrame, label: str = "y", margin: str = "rawPrediction") -> CalibratedModel:
    """Platt scaling: per class a one-feature logistic regression of class membership on the
    margin of a fitted model; the class probabilities are then normalised."""
    scored = base.transform(df).select(vector_to_array(F.col(margin)).alias("m"), F.col(label).alias("t"))
    with held(scored) as rows:
        k = rows.select(F.size("m")).first()[0]

        def curve(i):
            one = rows.select(array_to_vector(F.array(F.element_at("m", i + 1))).alias("x"),
                              (F.col("t") == i).cast("double").alias("y"))
            fit = LogisticRegression(featuresCol="x", labelCol="y", maxIter=50, family="binomial").fit(one)
            return float(fit.coefficients[0]), float(fit.intercept)

        with ThreadPool(min(k, PARALLEL_FITS)) as pool:
            return CalibratedModel(base, pool.map(curve, range(k)), margin)


def soft_vote(df: DataFrame, prob_cols: list[str], weights: list[float] | None = None) -> DataFrame:
    """Average probability arrays of several models and take the largest class."""
    weights = weights or [1.0] * len(prob_cols)
    total = sum(weights)
    def add(mean, c, share):
        return F.zip_with(mean, F.col(c), lambda a, b: a + b * share)

    mean = F.transform(F.col(prob_cols[0]), lambda v: v * (weights[0] / total))
    for c, w in zip(prob_cols[1:], weights[1:]):
        mean = add(mean, c, w / total)
    return df.withColumn("probability", mean).withColumn("prediction", argmax("probability"))


def probability_array(scored: DataFrame, out: str) -> DataFrame:
    """Keep a model's probabilities as an array under a new name and drop its other outputs."""
    p = F.col("probability")
    if dict(scored.dtypes)["probability"] == "vector":
        p = vector_to_array(p)
    return scored.withColumn(out, p).drop("probability", "prediction", "rawPrediction", "scores")


# ---- folds -----------------------------------------------------------------------------------

def out_of_fold(df: DataFrame, estimator, fold_col: str) -> DataFrame:
    """Prediction for every row by the model that was fitted without the row's fold. Fits run
    in parallel on held rows; the held-out parts are scored lazily from the source."""
    with held(df) as rows:
        folds = [r[0] for r in rows.select(fold_col).distinct().orderBy(fold_col).collect()]
        with ThreadPool(min(len(folds), PARALLEL_FITS)) as pool:
            models = pool.map(lambda f: estimator.fit(rows.filter(F.col(fold_col) != f)), folds)
    return union_slices([m.transform(df.filter(F.col(fold_col) == f)).select(*df.columns, "prediction")
                         for f, m in zip(folds, models)])


def cross_val_accuracy(df: DataFrame, estimator, fold_col: str, label: str = "y") -> DataFrame:
    """(fold, accuracy, n_rows) of the out-of-fold predictions."""
    return out_of_fold(df, estimator, fold_col).groupBy(F.col(fold_col).alias("fold")).agg(
        F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_folds"))


def grid_search(df: DataFrame, estimator, grid: list, fold_col: str, parallelism: int = PARALLEL_FITS) -> DataFrame:
    """(params, accuracy, is_best) per grid point, by cross validation on a given fold column."""
    judge = MulticlassClassificationEvaluator(labelCol=estimator.getLabelCol(), metricName="accuracy")
    with held(df) as rows:
        found = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, foldCol=fold_col,
                               numFolds=rows.select(F.max(fold_col)).first()[0] + 1,
                               parallelism=parallelism).fit(rows)
    best = int(np.argmax(found.avgMetrics))
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(g.items(), key=lambda e: e[0].name)), float(m), i == best)
            for i, (g, m) in enumerate(zip(grid, found.avgMetrics))]
    return df.sparkSession.createDataFrame(rows, "params string, accuracy double, is_best boolean")


# ---- importances -----------------------------------------------------------------------------

def feature_rank(model: Model, cols: list[str], spark) -> DataFrame:
    """(rank, feature, importance), most important first; ties keep column order."""
    imp = model.featureImportances.toArray()
    order = sorted(range(len(cols)), key=lambda i: (-imp[i], i))
    return spark.createDataFrame([(r + 1, cols[i], float(imp[i])) for r, i in enumerate(order)],
                                 "rank int, feature string, importance double")


def forest_importance(df: DataFrame, cols: list[str], features="features", label="y", extra: bool = False,
                      **p) -> DataFrame:
    """Rank table of a forest fitted on all rows; entropy splits and seed 123 by default."""
    make = extra_trees if extra else random_forest
    options = {"seed": 123, **({} if extra else {"impurity": "entropy"}), **p}
    return feature_rank(fit_held(make(features, label, **options), df), cols, df.sparkSession)


def select_from_model(df: DataFrame, rank_df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project to the features at or above the mean importance (one row per feature)."""
    rows = rank_df.collect()
    mean = sum(r["importance"] for r in rows) / len(rows)
    kept = {r["feature"] for r in rows if r["importance"] >= mean}
    return df.select(*keep, *[c for c in df.columns if c in kept])
