import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tallyflow.operators import classifiers as clf
from tallyflow.operators import linear, networks, prepare, project, sampling, semi

COLS = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def rows(planted):
    df = prepare.label_encode(prepare.minmax_scale(planted, COLS + ["flat"]), "label")
    df = project.to_sequence(df, COLS, "vec").withColumn("features", array_to_vector("vec"))
    return sampling.split_hash(df, "row_id", 0.5, 0).cache()


def hit_rate(model, df):
    out = model.transform(df)
    return out.filter("prediction = y").count() / out.count()


def test_preparation(planted, rows):
    assert project.numeric_columns(planted) == ["row_id", *COLS, "flat"]
    assert "note" not in project.select_numeric(planted).columns
    limits = rows.agg(*[f(c) for c in COLS for f in (F.min, F.max)]).first()
    assert list(limits) == [0.0, 1.0] * 4 and rows.filter("flat <> 0").count() == 0
    codes = {r["label"]: r["y"] for r in rows.select("label", "y").distinct().collect()}
    assert codes == {"DNS": 0.0, "lime": 1.0, "x11": 2.0}
    assert {r["label"]: r["code"] for r in prepare.label_map(planted, "label").collect()} == codes
    train_only = prepare.minmax_scale(planted, COLS, fit_on=planted.filter("row_id < 100"))
    assert train_only.filter("row_id < 100 AND (f0 < 0 OR f0 > 1)").count() == 0


FITS = {
    "tree": lambda tr: clf.fit_decision_tree(tr),
    "forest": lambda tr: clf.fit_random_forest(tr, numTrees=10),
    "extra": lambda tr: clf.fit_extra_trees(tr, numTrees=10),
    "logistic": lambda tr: clf.fit_logistic_regression(tr, C=10.0),
    "linear svm": lambda tr: clf.fit_linear_svm(tr, C=10.0),
    "rbf svm": lambda tr: clf.fit_rbf_svm(tr, "vec", C=10.0, size=64),
    "poly svm": lambda tr: clf.fit_poly_svm(tr, "vec", C=10.0, gamma=4.0, size=128),
    "perceptron": lambda tr: clf.fit_perceptron(tr, [4, 8, 3]),
    "belief net": lambda tr: networks.fit_belief_net(tr, "vec", "features", "y", "row_id", 3, hidden=8, iters=3),
    "discriminant": lambda tr: linear.discriminant_fit(tr, "vec", "y", 3),
    "ridge": lambda tr: linear.ridge_classifier(tr, "vec", "y", 3, 0.1),
    "ridge code": lambda tr: linear.ridge_code(tr, "vec", "y", 0.1),
}


@pytest.mark.parametrize("name", list(FITS))
def test_classifiers_separate_the_planted_classes(rows, name):
    model = FITS[name](rows.filter("NOT is_test"))
    assert hit_rate(model, rows.filter("is_test")) > 0.9


def test_bottleneck_reads_the_fitted_weights(rows):
    model = clf.fit_perceptron(rows, [4, 6, 2, 5, 3])
    got = networks.bottleneck_features(rows, model, "features").orderBy("row_id").first()
    a = np.array(got["vec"])
    for w, b in networks.perceptron_layers(model)[:2]:
        a = 1 / (1 + np.exp(-(a @ w + b)))
    assert len(got["code"]) == 2 and np.allclose(got["code"], a)
    # all layers together reproduce the model's own prediction
    x = np.array([r["vec"] for r in rows.orderBy("row_id").collect()])
    layers = networks.perceptron_layers(model)
    for w, b in layers[:-1]:
        x = 1 / (1 + np.exp(-(x @ w + b)))
    own = [r["prediction"] for r in model.transform(rows).orderBy("row_id").collect()]
    assert (np.argmax(x @ layers[-1][0] + layers[-1][1], axis=1) == own).all()


def test_noise_keeps_the_mean_and_depends_on_the_row(spark):
    df = spark.range(4000).select(F.col("id"), F.lit(1.0).alias("a"))
    noisy = networks.noise_augment(df, ["a"], 0.5, 1, "id")
    assert {r["a"] for r in noisy.select("a").distinct().collect()} == {0.0, 2.0}
    assert abs(noisy.agg(F.avg("a")).first()[0] - 1) < 0.05
    again = networks.noise_augment(df.repartition(9), ["a"], 0.5, 1, "id")
    assert noisy.join(again.withColumnRenamed("a", "b"), "id").filter("a <> b").count() == 0


def test_importance_and_selection(spark, rows):
    rank = clf.forest_importance(rows, COLS, numTrees=20)
    top = rank.orderBy("rank").first()
    assert top["feature"] in ("f0", "f1", "f2") and rank.orderBy(F.desc("rank")).first()["feature"] == "f3"
    assert "f3" not in clf.select_from_model(rows.select("row_id", *COLS), rank, keep=("row_id",)).columns
    assert project.top_features(rows, rank, 1).columns == [top["feature"]]


def test_voting_and_calibration(rows):
    both = rows.select("row_id", F.array(F.lit(0.6), F.lit(0.4)).alias("a"), F.array(F.lit(0.1), F.lit(0.9)).alias("b"))
    assert clf.soft_vote(both, ["a", "b"]).filter("prediction <> 1").count() == 0
    assert clf.soft_vote(both, ["a", "b"], [9.0, 1.0]).filter("prediction <> 0").count() == 0
    out = clf.calibrate(clf.fit_linear_svm(rows), rows).transform(rows)
    assert out.filter(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).count() == 0
    assert out.filter("prediction = y").count() > 270


def test_folds_cover_every_row_once(rows):
    df = sampling.stratified_folds(rows, "y", 3, 1, "row_id")
    out = clf.out_of_fold(df, clf.decision_tree(), "fold")
    assert out.count() == 300 and out.select("row_id").distinct().count() == 300
    assert out.filter("prediction = y").count() > 270
    scores = clf.cross_val_accuracy(df, clf.decision_tree(), "fold")
    assert clf.mean_score(scores).first()["mean_accuracy"] > 0.9
    model = clf.logistic_regression()
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 1000.0]).build()
    found = {r["params"]: r for r in clf.grid_search(df, model, grid, "fold").collect()}
    assert found["regParam=0.0"]["is_best"] and found["regParam=0.0"]["accuracy"] > 0.9


def test_pseudo_labels(rows):
    known, pool = semi.unlabel(rows.select("row_id", "features", "y"), "row_id", 0.8, 3)
    model = semi.PseudoLabeler(clf.random_forest(numTrees=5), pool.drop("y"), 0.5, 1, "row_id").fit(known)
    assert hit_rate(model, rows) > 0.9
    guessed = pool.drop("y").withColumn("prediction", F.lit(1.0))
    both = semi.pseudo_label_union(known, guessed, "y", "prediction", 0.25, 1, "row_id")
    assert both.count() == known.count() + int(pool.count() * 0.25)
    with pytest.raises(ValueError):
        semi.PseudoLabeler(clf.decision_tree(), pool, 1.5)
    sweep = semi.pseudo_label_sweep(sampling.contiguous_folds(known, ["row_id"], 2), pool.drop("y"),
                                    {"tree": clf.decision_tree()}, [0.0, 1.0], "fold", "row_id")
    assert sweep.count() == 4 and sweep.agg(F.min("accuracy")).first()[0] > 0.8


def test_self_training_moves_every_confident_row_once(rows):
    known, pool = semi.unlabel(rows.select("row_id", "features", "y"), "row_id", 0.8, 3)
    model, done, rest = semi.self_train(known, pool.drop("y"), clf.logistic_regression(n=60, C=100.0), "row_id", 0.9)
    assert done.count() + rest.count() == 300 and done.select("row_id").distinct().count() == done.count()
    assert rest.join(done, "row_id", "left_semi").count() == 0 and hit_rate(model, rows) > 0.9
