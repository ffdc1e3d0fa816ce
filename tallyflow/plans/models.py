"""Neighbours, closed-form models, Spark ML classifiers, networks, importances and folds."""
from __future__ import annotations


from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tallyflow.operators import classifiers as clf
from tallyflow.operators import linear, margins, neighbours, networks, prepare, project, sampling, trees
from tallyflow.operators.margins import Task
from tallyflow.plans.registry import draw_sql, md5_sql, query, r6, table

KNN = 5
_OUT = ("row_id", "y", "prediction")
ORDER_FEATURES = ["o_totalprice", "o_custkey", "day"]


def vectors(spark, sf, classes: int = 10):
    """Embeddings as (row_id, vec array<double>, features vector, y, is_test)."""
    df = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"),
        (F.col("label") * classes / 10).cast("int").cast("double").alias("y"))
    return sampling.split_hash(df.withColumn("features", array_to_vector("vec")), "row_id", 0.5, 0)


def order_rows(spark, sf):
    """Orders as (row_id, three scaled features, y = status code, is_test)."""
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"),
        F.dayofyear("o_orderdate").cast("double").alias("day"), "o_orderstatus")
    scaled = prepare.minmax_scale(df, ORDER_FEATURES)
    coded = prepare.label_encode(scaled, "o_orderstatus")
    rows = project.to_vector(project.to_sequence(coded, ORDER_FEATURES, "vec"), ORDER_FEATURES)
    return sampling.split_hash(rows, "row_id", 0.5, 0)


def halves(df):
    return df.filter(~F.col("is_test")), df.filter(F.col("is_test"))


def scored(model, test):
    return model.transform(test).select("row_id", F.col("y").cast("bigint").alias("y"),
                                        F.col("prediction").cast("bigint").alias("prediction"))


_DIST = "round(sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda p: pow(p[1] - p[2], 2)))), 6)"
_VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


_KNN_SQL = f"""WITH e AS ({_VEC}), d AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, list_distance(q.v, t.v) AS dd,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rank FROM e q CROSS JOIN e t)
 SELECT query_id, train_id, round(dd, 6) AS distance, rank::BIGINT AS rank FROM d WHERE rank <= 6"""


def _neighbours(spark, sf, **options):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = neighbours.knn_join(df, df, "v", "vec_id", "vec_id", 6, **options)
    return found.select("query_id", "train_id", r6("distance", "distance"), F.col("rank").cast("bigint").alias("rank"))


@query("knn_neighbours", _KNN_SQL)
def _(spark, sf):
    return _neighbours(spark, sf)


@query("knn_neighbours_rounds", _KNN_SQL)
def _(spark, sf):
    """The path for train sides beyond a broadcast, forced."""
    return _neighbours(spark, sf, broadcast_bytes=0, rows_per_piece=100)


@query("clf_knn", f"""WITH e AS (SELECT *, substr({md5_sql(0, 'vec_id')}, 1, 8) < '80000000' AS is_test FROM ({_VEC})),
 d AS (SELECT q.vec_id AS row_id, q.label AS y, t.label AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, t.v), t.vec_id) AS rk
  FROM e q CROSS JOIN e t WHERE q.is_test AND NOT t.is_test), v AS (SELECT row_id, y, c, count(*) AS n FROM d WHERE rk <= {KNN} GROUP BY ALL)
 SELECT row_id, y::BIGINT AS y, arg_min(c, -n * 1000 + c)::BIGINT AS prediction FROM v GROUP BY ALL""")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    votes = neighbours.knn_classify(train, test, "vec", "y", "row_id", KNN)
    return test.select("row_id", F.col("y").cast("bigint").alias("y")).join(votes, F.col("row_id") == F.col("query_id")) \
        .select("row_id", "y", F.col("prediction").cast("bigint").alias("prediction"))


@query("clf_knn_lsh")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    votes = neighbours.knn_classify(train, test, "vec", "y", "row_id", KNN, method="lsh", radius=1.4)
    return test.select("row_id", "y").join(votes, F.col("row_id") == F.col("query_id")).select("row_id", "y", "prediction")


# ---- closed forms with an SQL oracle ----------------------------------------------------------

_ORD = f"""WITH lim AS (SELECT min(o_totalprice) AS a0, max(o_totalprice) AS a1, min(o_custkey) AS b0, max(o_custkey) AS b1 FROM orders),
 r AS (SELECT o_orderkey AS row_id, (o_totalprice - a0) / (a1 - a0) AS x1, (o_custkey - b0) / (b1 - b0)::DOUBLE AS x2,
  (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS y, substr({md5_sql(0, 'o_orderkey')}, 1, 8) < '80000000' AS is_test FROM orders, lim),
 tr AS (SELECT * FROM r WHERE NOT is_test)"""


def _pairs(spark, sf):
    return order_rows(spark, sf).withColumn("vec", F.array("o_totalprice", "o_custkey"))


def _ridge_sql(y: str, i: str) -> str:
    """Intercept and two ridge weights (alpha 5) for one target, as columns w0/w1/w2 + suffix."""
    return (f"SELECT avg({y}) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) * var_pop(x1) + 5 AS s11, count(*) * var_pop(x2) + 5 AS s22, "
            f"count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, {y}) AS t1, count(*) * covar_pop(x2, {y}) AS t2, {i} AS k FROM tr")


_SOLVE = """ s AS (SELECT k, my, m1, m2, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS w1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS w2 FROM g)"""


@query("ridge_code_readout", _ORD + f", g AS ({_ridge_sql('y', '0')})," + _SOLVE + """
 SELECT row_id, y::BIGINT AS y, round(my + w1 * (x1 - m1) + w2 * (x2 - m2), 6) AS score,
 round_even(my + w1 * (x1 - m1) + w2 * (x2 - m2), 0)::BIGINT AS prediction FROM r, s WHERE is_test""")
def _(spark, sf):
    train, test = halves(_pairs(spark, sf))
    out = linear.ridge_code(train, "vec", "y", 5.0).transform(test)
    return out.select("row_id", F.col("y").cast("bigint").alias("y"), r6(F.element_at("scores", 1), "score"),
                      F.col("prediction").cast("bigint").alias("prediction"))


@query("ridge_readout", _ORD + ", g AS (" + " UNION ALL ".join(_ridge_sql(f"(y = {i})::INT", str(i)) for i in range(3)) + ")," + _SOLVE + """,
 z AS (SELECT row_id, y, list(my + w1 * (x1 - m1) + w2 * (x2 - m2) ORDER BY k) AS sc FROM r, s WHERE is_test GROUP BY ALL)
 SELECT row_id, y::BIGINT AS y, round(sc[1], 6) AS s0, round(sc[2], 6) AS s1, round(sc[3], 6) AS s2,
 (list_position(sc, list_max(sc)) - 1)::BIGINT AS prediction FROM z""")
def _(spark, sf):
    train, test = halves(_pairs(spark, sf))
    out = linear.ridge_classifier(train, "vec", "y", 3, 5.0).transform(test)
    return out.select("row_id", F.col("y").cast("bigint").alias("y"),
                      *[r6(F.element_at("scores", i + 1), f"s{i}") for i in range(3)],
                      F.col("prediction").cast("bigint").alias("prediction"))


@query("clf_lda", _ORD + """, c AS (SELECT y AS k, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS v11,
  var_pop(x2) * count(*) AS v22, covar_pop(x1, x2) * count(*) AS v12 FROM tr GROUP BY 1),
 p AS (SELECT sum(v11) / (sum(n) - count(*)) AS a, sum(v22) / (sum(n) - count(*)) AS d, sum(v12) / (sum(n) - count(*)) AS b, sum(n) AS n_all FROM c),
 w AS (SELECT k, (d * m1 - b * m2) / (a * d - b * b) AS w1, (a * m2 - b * m1) / (a * d - b * b) AS w2, m1, m2, n / n_all::DOUBLE AS prior FROM c, p),
 z AS (SELECT row_id, y, list(w1 * x1 + w2 * x2 - 0.5::DOUBLE * (w1 * m1 + w2 * m2) + ln(prior) ORDER BY k) AS sc FROM r, w WHERE is_test GROUP BY ALL),
 e AS (SELECT row_id, y, list_transform(sc, lambda v: exp(v)) AS e FROM z)
 SELECT row_id, y::BIGINT AS y, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2,
 (list_position(e, list_max(e)) - 1)::BIGINT AS prediction FROM e""")
def _(spark, sf):
    train, test = halves(_pairs(spark, sf))
    out = linear.discriminant_fit(train, "vec", "y", 3).transform(test)
    return out.select("row_id", F.col("y").cast("bigint").alias("y"),
                      *[r6(F.element_at("probability", i + 1), f"p{i}") for i in range(3)],
                      F.col("prediction").cast("bigint").alias("prediction"))


@query("pca_project", _ORD + """, m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS a, var_samp(x2) AS d, covar_samp(x1, x2) AS b FROM r),
 l AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS lam FROM m),
 v AS (SELECT m1, m2, b / sqrt(b * b + pow(lam - a, 2)) AS e1, (lam - a) / sqrt(b * b + pow(lam - a, 2)) AS e2 FROM l),
 s AS (SELECT m1, m2, CASE WHEN greatest(abs(e1), abs(e2)) = greatest(e1, e2) THEN e1 ELSE -e1 END AS e1,
  CASE WHEN greatest(abs(e1), abs(e2)) = greatest(e1, e2) THEN e2 ELSE -e2 END AS e2 FROM v),
 t AS (SELECT m1, m2, e1, e2, CASE WHEN abs(e2) >= abs(e1) THEN e2 * sign(e2) ELSE -e2 * sign(e1) END AS f1,
  CASE WHEN abs(e2) >= abs(e1) THEN -e1 * sign(e2) ELSE e1 * sign(e1) END AS f2 FROM s)
 SELECT row_id, round((x1 - m1) * e1 + (x2 - m2) * e2, 6) AS c1, round((x1 - m1) * f1 + (x2 - m2) * f2, 6) AS c2 FROM r, t""")
def _(spark, sf):
    df = _pairs(spark, sf)
    out = linear.pca_project(df, linear.pca_fit(df, "vec", 2))
    return out.select("row_id", *[r6(F.element_at("projected", i + 1), f"c{i + 1}") for i in range(2)])


@query("pca_vectors")
def _(spark, sf):
    df = vectors(spark, sf)
    return linear.pca_project(df, linear.pca_fit(df, "vec", 20)).select("row_id", "projected")


@query("ridge_vectors")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    return scored(linear.ridge_classifier(train, "vec", "y", 10, 5.0), test)


@query("lda_vectors")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    return scored(linear.discriminant_fit(train, "vec", "y", 10), test)


# ---- Spark ML classifiers ---------------------------------------------------------------------

def _classifier(name, fit, rows=order_rows):
    @query(name)
    def _(spark, sf):
        train, test = halves(rows(spark, sf))
        return scored(fit(train), test)


def _forest(spec, vec="vec", classes=3):
    return lambda tr: trees.fit_forest(tr, vec, "y", "row_id", classes, spec)


_classifier("clf_decision_tree", _forest(trees.DECISION_TREE))
_classifier("clf_random_forest", _forest(trees.RANDOM_FOREST))
_classifier("clf_extra_trees", _forest(trees.EXTRA_TREES))
_classifier("clf_logreg", lambda tr: clf.fit_logistic_regression(tr, C=1.0))
_classifier("clf_linear_svm", lambda tr: clf.fit_linear_svm(tr))
_classifier("clf_rbf_svm", lambda tr: clf.fit_rbf_svm(tr, "vec"))
_classifier("clf_poly_svm", lambda tr: clf.fit_poly_svm(tr, "vec"))
_classifier("clf_mlp", lambda tr: clf.fit_perceptron(tr, [3, 16, 3], maxIter=40))
_classifier("clf_mlp_wide", lambda tr: clf.fit_perceptron(tr, [64, 200, 100, 50, 10], maxIter=20), vectors)


# ---- linear classifiers in shared passes ------------------------------------------------------

CORNERS = _ORD + """,
 c AS (SELECT row_id, is_test, CASE WHEN x2 > 0.75::DOUBLE THEN 2 WHEN x1 > 0.75::DOUBLE THEN 1 ELSE 0 END AS y FROM r
  WHERE x2 > 0.75::DOUBLE OR x2 < 0.25::DOUBLE AND (x1 < 0.25::DOUBLE OR x1 > 0.75::DOUBLE))"""


def corners(spark, sf):
    """Orders in three regions of (price, customer) that straight lines part with room to spare; y is the region."""
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    df = _pairs(spark, sf).filter((cust > 0.75) | (cust < 0.25) & ((price < 0.25) | (price > 0.75)))
    return df.withColumn("y", F.when(cust > 0.75, 2.0).when(price > 0.75, 1.0).otherwise(0.0))


@query("clf_linear_corners", CORNERS + " SELECT row_id, y::BIGINT AS y, y::BIGINT AS prediction FROM c WHERE is_test")
def _(spark, sf):
    train, test = halves(corners(spark, sf))
    return scored(clf.fit_linear_svm(train, "vec"), test)


@query("forest_corners", CORNERS + " SELECT row_id, y::BIGINT AS y, y::BIGINT AS prediction FROM c WHERE is_test")
def _(spark, sf):
    train, test = halves(corners(spark, sf))
    return scored(_forest(trees.RANDOM_FOREST)(train), test)


def bands(spark, sf):
    """Orders whose class alternates over 200 bands of the customer key."""
    return _pairs(spark, sf).withColumn("y", F.floor(F.col("o_custkey") * 200) % 2)


_BANDS = _ORD + """ SELECT row_id, floor(x2 * 200)::BIGINT % 2 AS y, floor(x2 * 200)::BIGINT % 2 AS prediction FROM r"""


@query("tree_bands", _BANDS)
def _(spark, sf):
    """A rule that needs far more than 30 levels, learnt and read back by one tree."""
    df = bands(spark, sf)
    return scored(_forest(trees.DECISION_TREE, classes=2)(df), df)


@query("extra_trees_bands", _BANDS)
def _(spark, sf):
    df = bands(spark, sf)
    return scored(_forest(trees.EXTRA_TREES, classes=2)(df), df)


@query("svm_grid_corners", CORNERS + """, g AS (SELECT * FROM (VALUES ('l2', 1.0::DOUBLE), ('l2', 0.1::DOUBLE), ('l1', 1.0::DOUBLE), ('l1', 0.1::DOUBLE)) t(penalty, C))
 SELECT 'squared_hinge' AS loss, penalty, C, avg(1.0::DOUBLE) AS accuracy, penalty = 'l2' AND C = 1 AS is_best FROM g, c GROUP BY ALL""")
def _(spark, sf):
    df = sampling.contiguous_folds(corners(spark, sf).select("row_id", "vec", "y"), ["row_id"], 5)
    return margins.linear_grid(df, "fold", [Task(c, p) for p in ("l2", "l1") for c in (1.0, 0.1)], "vec")


@query("svm_grid")
def _(spark, sf):
    """Penalties and C of the linear SVM over five folds of the orders."""
    df = sampling.contiguous_folds(order_rows(spark, sf).select("row_id", "vec", "y"), ["row_id"], 5)
    return margins.linear_grid(df, "fold", [Task(c, p) for p in ("l2", "l1") for c in (1.0, 0.1, 0.01, 0.001)], "vec")


def _fold_accuracy(out):
    return out.groupBy("fold").agg(F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


@query("cv_logistic")
def _(spark, sf):
    """Accuracy by fold of ten stratified folds, fitted and scored together."""
    df = folded(spark, sf, 10)
    return _fold_accuracy(margins.fit_linear_folds(df, "fold", task=Task(1.0, loss="logistic")).transform(df))


@query("cv_random_forest")
def _(spark, sf):
    df = sampling.stratified_folds(order_rows(spark, sf).select("row_id", "vec", "y"), "y", 10, 7, "row_id")
    return _fold_accuracy(trees.fit_forest(df, "vec", "y", "row_id", 3, trees.RANDOM_FOREST, "fold", 10).transform(df))


@query("cv_rbf_svm")
def _(spark, sf):
    df = sampling.stratified_folds(order_rows(spark, sf).select("row_id", "vec", "y"), "y", 10, 7, "row_id")
    return _fold_accuracy(clf.rbf_svm_folds(df, "fold", "vec", size=64).transform(df))


@query("calibrate")
def _(spark, sf):
    train, test = halves(order_rows(spark, sf))
    out = clf.calibrate(clf.fit_linear_svm(train), train).transform(test)
    return out.select("row_id", "probability", "prediction")


def vote_parts(train, test, classes, n_rows, svm_c=1.0, trees=30, lr_c=1.0, lr_iter=50, k=KNN):
    """Test rows with the probability arrays of the five voters."""
    models = {"p_svm": clf.fit_poly_svm(train, "vec", C=svm_c, size=64),
              "p_rf": clf.fit_random_forest(train, numTrees=trees, maxDepth=8),
              "p_lr": clf.fit_held(clf.logistic_regression(C=lr_c, n=n_rows, maxIter=lr_iter), train),
              "p_lda": linear.discriminant_fit(train, "vec", "y", classes)}
    out = test
    for name, m in models.items():
        out = clf.probability_array(m.transform(out), name)
    pairs = neighbours.knn_join(test, train, "vec", "row_id", "row_id", k, carry="y")
    knn = neighbours.knn_probability(pairs, classes).withColumnRenamed("probability", "p_knn")
    return out.join(knn.withColumnRenamed("query_id", "row_id"), "row_id")


VOTERS = ["p_svm", "p_rf", "p_lr", "p_knn", "p_lda"]


@query("clf_soft_vote")
def _(spark, sf):
    train, test = halves(vectors(spark, sf, classes=2))
    return scored(_Voted(), vote_parts(train, test, 2, train.count()))


class _Voted:
    def transform(self, df):
        return clf.soft_vote(df, VOTERS)


# ---- networks ---------------------------------------------------------------------------------

_NOISE = ", ".join(f"round(CASE WHEN {draw_sql(9, 'o_orderkey', chr(39) + c + chr(39))} < 0.5::DOUBLE THEN 0 ELSE {c} / (1 - 0.5::DOUBLE) END, 6) AS {c}"
                   for c in ("o_totalprice", "o_custkey"))


@query("noise_augment", f"SELECT o_orderkey, {_NOISE} FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    noisy = networks.noise_augment(df, ["o_totalprice", "o_custkey"], 0.5, 9, "o_orderkey")
    return noisy.select("o_orderkey", r6("o_totalprice", "o_totalprice"), r6("o_custkey", "o_custkey"))


@query("bottleneck_features")
def _(spark, sf):
    train, test = halves(order_rows(spark, sf))
    noisy = networks.noise_augment(train.select("row_id", "y", *ORDER_FEATURES), ORDER_FEATURES, 0.5, 9, "row_id")
    model = clf.fit_perceptron(project.to_vector(noisy, ORDER_FEATURES), [3, 12, 2, 12, 3], maxIter=30)
    return networks.bottleneck_features(test, model, "features").select("row_id", "code")


def _unit():
    return F.transform("vec", lambda v: (v + 1.0) / 2.0)


@query("rbm_features")
def _(spark, sf):
    df = vectors(spark, sf).withColumn("unit", _unit())
    return networks.rbm_fit(df, "unit", "row_id", hidden=50, iters=5).transform(df).select("row_id", "hidden")


@query("clf_dbn")
def _(spark, sf):
    df = vectors(spark, sf).withColumn("unit", _unit()).withColumn("features", array_to_vector("unit"))
    train, test = halves(df)
    return scored(networks.fit_belief_net(train, "unit", "features", "y", "row_id", 10, hidden=50, iters=5, maxIter=20), test)


@query("conv_features", """WITH c AS (SELECT vec_id, list_transform(range(1, 63), lambda i: greatest(0::DOUBLE, 0.5::DOUBLE * embedding[i]::DOUBLE
 - 1.0::DOUBLE * embedding[i + 1]::DOUBLE + 0.25::DOUBLE * embedding[i + 2]::DOUBLE + 0.01::DOUBLE)) AS m FROM embeddings)
 SELECT vec_id, j::BIGINT AS pool, round(greatest(m[2 * j + 1], m[2 * j + 2]), 6) AS v FROM c, unnest(range(0, 31)) AS g(j)""")
def _(spark, sf):
    seq = F.col("embedding").cast("array<double>")
    df = table(spark, sf, "embeddings").select("vec_id", networks.conv_features(seq, [([0.5, -1.0, 0.25], 0.01)]).alias("m"))
    return df.select("vec_id", F.posexplode("m").alias("pool", "v")).select(
        "vec_id", F.col("pool").cast("bigint").alias("pool"), r6("v", "v"))


@query("clf_conv")
def _(spark, sf):
    df = networks.conv_bank(vectors(spark, sf), "vec", networks.random_kernels([16, 8], 3, 0))
    train, test = halves(df.withColumn("features", array_to_vector("maps")))
    return scored(clf.fit_logistic_regression(train, C=1.0, maxIter=30), test)


# ---- importances ------------------------------------------------------------------------------

def _importance(spark, sf, extra=False):
    spec = trees.Spec(rule="drawn", bootstrap=False, seed=123) if extra else trees.Spec(criterion="entropy", seed=123)
    return trees.fit_forest(order_rows(spark, sf), "vec", "y", "row_id", 3, spec, votes=False).rank(ORDER_FEATURES)


@query("feature_rank")
def _(spark, sf):
    return _importance(spark, sf)


@query("extra_importance")
def _(spark, sf):
    return _importance(spark, sf, extra=True)


@query("topn_project")
def _(spark, sf):
    df = order_rows(spark, sf).select("row_id", *ORDER_FEATURES)
    return project.top_features(df, _importance(spark, sf), 2, keep=("row_id",))


@query("select_by_importance")
def _(spark, sf):
    df = order_rows(spark, sf).select("row_id", *ORDER_FEATURES)
    return clf.select_from_model(df, _importance(spark, sf, extra=True), keep=("row_id",))


# ---- folds and grids --------------------------------------------------------------------------

def folded(spark, sf, k):
    df = order_rows(spark, sf).select("row_id", "features", "y")
    return sampling.stratified_folds(df, "y", k, 7, "row_id")


@query("oof_predictions")
def _(spark, sf):
    out = clf.out_of_fold(folded(spark, sf, 10), clf.decision_tree(maxDepth=5), "fold")
    return out.select("row_id", "fold", "y", "prediction")


@query("cv_accuracy")
def _(spark, sf):
    return clf.cross_val_accuracy(folded(spark, sf, 10), clf.decision_tree(maxDepth=5), "fold")


@query("cv_mean")
def _(spark, sf):
    df = sampling.contiguous_folds(order_rows(spark, sf).select("row_id", "features", "y"), ["row_id"], 5)
    return clf.mean_score(clf.cross_val_accuracy(df, clf.decision_tree(maxDepth=5), "fold"))


@query("grid_search")
def _(spark, sf):
    df = sampling.contiguous_folds(order_rows(spark, sf).select("row_id", "features", "y"), ["row_id"], 5)
    n = df.count()
    model = clf.logistic_regression(maxIter=20)
    grid = ParamGridBuilder().addGrid(model.regParam, [1.0 / (c * n) for c in (1.0, 0.1, 0.01, 0.001)]).build()
    return clf.grid_search(df, model, grid, "fold")
