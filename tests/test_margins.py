"""Batched linear classifiers against plain optimality conditions and separate fits."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyflow.operators import classifiers as clf
from tallyflow.operators import margins
from tallyflow.operators.margins import Task


def data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 4)) * [1.0, 50.0, 0.01, 1.0] + np.array([[0, 0, 0, 0], [1, 0, 0.01, 0], [0, 80, 0, 0]])[y] + [0, 1000, 0, 0]
    x[:, 3] = 7.0                                     # a constant column
    return x, y


def frame(spark, x, y):
    rows = [(i, [float(t) for t in r], float(c), i * 5 % 7 % 4) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, vec array<double>, y double, fold int").withColumn("features", array_to_vector("vec")).repartition(3)


def objective(task, w, x, sign):
    m = sign * (x @ w)
    loss = np.maximum(0, 1 - m) ** 2 if task.loss == "squared_hinge" else np.logaddexp(0, -m)
    return task.C * loss.sum() + (np.abs(w).sum() if task.penalty == "l1" else 0.5 * w @ w)


@pytest.mark.parametrize("task", [Task(1.0), Task(0.01), Task(1.0, "l1"), Task(0.05, "l1"), Task(2.0, "l2", None, "logistic"), Task(0.5, "l1", None, "logistic")])
def test_no_direction_lowers_the_objective(spark, task):
    x, y = data()
    w, b = margins.fit_margins(frame(spark, x, y), "vec", "y", [task], 3)[0]
    full = np.hstack([x, np.ones((len(x), 1))])
    rng = np.random.default_rng(1)
    for c in range(3):
        u, sign = np.append(w[:, c], b[c]), np.where(y == c, 1.0, -1.0)
        best = objective(task, u, full, sign)
        assert np.isfinite(best)
        for _ in range(300):
            step = rng.normal(size=5) * rng.choice([1e-1, 1e-3, 1e-5]) / np.append(np.abs(x).max(0), 1)
            assert objective(task, u + step, full, sign) >= best - 1e-6 * max(1, best)
    if task.penalty == "l1" and task.loss == "squared_hinge" and task.C < 1:
        assert (w == 0).any()


def test_shared_passes_equal_separate_fits(spark):
    x, y = data(seed=3)
    df = frame(spark, x, y)
    tasks = [Task(c, p, f) for c in (1.0, 0.1) for p in ("l2", "l1") for f in (0, 2)]
    together = margins.fit_margins(df, "features", "y", tasks, 3, "fold")
    for task, (w, b) in zip(tasks, together):
        w1, b1 = margins.fit_margins(df.filter(F.col("fold") != task.fold), "vec", "y", [Task(task.C, task.penalty)], 3)[0]
        scale = np.append(np.abs(x).max(0), 1)[:, None]
        assert np.abs((np.vstack([w, b]) - np.vstack([w1, b1])) * scale).max() < 1e-3 * max(1, np.abs(np.vstack([w1, b1]) * scale).max())


def test_turns_do_not_change_the_result(spark, monkeypatch):
    x, y = data(60)
    df = frame(spark, x, y)
    a = margins.fit_linear(df, task=Task(0.5))
    monkeypatch.setattr(margins, "CURVATURE_BYTES", 1)
    b = margins.fit_linear(df, task=Task(0.5))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.bias, b.bias)


def test_folds_are_scored_in_one_pass_by_their_own_model(spark):
    x, y = data(120)
    df = frame(spark, x, y)
    model = margins.fit_linear_folds(df, "fold")
    got = {r["row_id"]: r for r in model.transform(df).collect()}
    assert len(got) == 120
    for f in range(4):
        one = margins.fit_linear(df.filter(F.col("fold") != f), classes=3)
        for r in one.transform(df.filter(F.col("fold") == f)).collect():
            assert np.allclose(r["rawPrediction"].toArray(), got[r["row_id"]]["rawPrediction"].toArray(), atol=1e-3)
    grid = margins.linear_grid(df, "fold", [Task(1.0), Task(1e-9), Task(1.0, "l1")]).collect()
    share = np.mean([np.mean([r["prediction"] == r["y"] for r in got.values() if r["fold"] == f]) for f in range(4)])
    assert abs(grid[0]["accuracy"] - share) < 1e-12 and sum(r["is_best"] for r in grid) == 1 and grid[1]["accuracy"] < grid[0]["accuracy"]


def test_two_classes_and_calibration(spark):
    x, y = data(90)
    df = frame(spark, x, y % 2)
    model = margins.fit_linear(df, task=Task(1.0))
    r = model.transform(df).first()
    assert abs(r["rawPrediction"][0] + r["rawPrediction"][1]) < 1e-9
    out = clf.calibrate(model, df).transform(df)
    assert out.filter(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0


def test_refused_input(spark):
    df = spark.createDataFrame([(0, [float("nan")], 1.0, 0)], "row_id long, vec array<double>, y double, fold int")
    with pytest.raises(Exception, match="finite"):
        margins.fit_linear(df, "vec", classes=2)
    with pytest.raises(ValueError):
        margins.fit_linear(df.limit(0), "vec", classes=2)
    with pytest.raises(ValueError):
        Task(0.0)
    with pytest.raises(ValueError):
        margins.fit_margins(df, "vec", "y", [Task(1.0, "l2", 1)], 2)


def test_kernel_machines_hold_rows_as_they_are(spark, monkeypatch):
    """The fit is that of a column of mapped rows, but what it holds has the width of the rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 3))
    rows = spark.createDataFrame([(i, [float(v) for v in r], float((r[0] * r[1] > 0) + (r[2] > 1)), i % 2) for i, r in enumerate(x)], "row_id long, vec array<double>, y double, fold int").repartition(2)
    mapped = rows.withColumn("z", array_to_vector(clf.fourier_map("vec", 3, 40, 0.5, 0)))
    want = [margins.fit_linear(mapped, "z"), margins.fit_linear_folds(mapped, "fold", "z")]
    widths, held = [], margins.held

    def spy(df):
        widths.append(df.select(F.max(F.size("x"))).first()[0])
        return held(df)

    monkeypatch.setattr(margins, "held", spy)
    got = [clf.fit_rbf_svm(rows, "vec", gamma=0.5, size=40).model, clf.rbf_svm_folds(rows, "fold", "vec", gamma=0.5, size=40).model]
    clf.fit_poly_svm(rows, "vec", size=40)
    assert widths == [3, 3, 3]
    for a, b in zip(got, want):
        assert np.allclose(a.weights, b.weights, atol=1e-5) and np.allclose(a.bias, b.bias, atol=1e-5)
