"""Reservoir features, series regression, pseudo-labelling and self-training."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyflow.operators import classifiers as clf
from tallyflow.operators import neighbours, prepare, reservoir, sampling, semi, series, trees
from tallyflow.plans.models import CORNERS, corners, halves, order_rows, scored, vectors
from tallyflow.plans.registry import hash60_sql, md5_sql, query, r6, table
from tallyflow.sources import work_path
from tallyflow.streaming import continue_stream

RHO, SCALE = 0.9, 0.7


def ring2(bidirectional=False):
    return reservoir.Reservoir((reservoir.Layer(units=2, rho=RHO, leak=None, scaling=SCALE, noise=0.0, ring=True,
                                                bidirectional=bidirectional, seed=1),))


def _ring_sql(x: list[str], w: list[str]) -> str:
    """State after each step of the two-unit ring, written out."""
    s1 = s2 = "0::DOUBLE"
    out = []
    for i, v in enumerate(x):
        s1, s2 = f"a{i}", f"b{i}"
        p1, p2 = ("0::DOUBLE", "0::DOUBLE") if i == 0 else (f"a{i - 1}", f"b{i - 1}")
        out.append(f"q{i} AS (SELECT *, tanh({RHO}::DOUBLE * {p2} + {w[0]} * {v}) AS {s1}, tanh({RHO}::DOUBLE * {p1} + {w[1]} * {v}) AS {s2} "
                   f"FROM {'q' if i == 0 else 'q' + str(i - 1)})")
    return ", ".join(out)


_W = [f"{v}::DOUBLE" for v in reservoir.input_weights(2, 1, SCALE, 1)[:, 0]]
_X = ["o_totalprice / 500000::DOUBLE", "o_custkey / 1000::DOUBLE", "dayofyear(o_orderdate) / 366::DOUBLE"]


@query("reservoir_states", "WITH q AS (SELECT * FROM orders), " + _ring_sql(_X, _W) +
       ", u AS (" + " UNION ALL ".join(f"SELECT o_orderkey, {i}::BIGINT AS step, a{i} AS s1, b{i} AS s2 FROM q2" for i in range(3)) +
       ") SELECT o_orderkey, step, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM u")
def _(spark, sf):
    seq = F.array(F.col("o_totalprice") / 500000.0, F.col("o_custkey") / 1000.0, F.dayofyear("o_orderdate") / 366.0)
    df = table(spark, sf, "orders").select("o_orderkey", seq.alias("seq"))
    steps = reservoir.reservoir_states(df, "seq", "o_orderkey", ring2()).select("o_orderkey", F.posexplode("states").alias("step", "s"))
    return steps.select("o_orderkey", F.col("step").cast("bigint").alias("step"),
                        r6(F.element_at("s", 1), "s1"), r6(F.element_at("s", 2), "s2"))


def small(seed=0, **kw):
    return reservoir.Layer(**{"units": 50, "rho": 0.6, "leak": 0.6, "density": 0.25, "scaling": 0.1, "noise": 0.01,
                              "washout": 5, "seed": seed, **kw})


@query("reservoir_embedding")
def _(spark, sf):
    train, test = halves(vectors(spark, sf).select("row_id", "vec", "y", "is_test"))
    a, b = reservoir.reservoir_embedding(train, test, "vec", "row_id", reservoir.Reservoir((small(),)), k=10)
    return a.unionByName(b).select("row_id", "is_test", "embedding")


@query("clf_reservoir")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    ring = reservoir.Layer(units=60, rho=0.99, leak=1.0, scaling=1.0, noise=0.0, ring=True)
    return scored(reservoir.fit_reservoir(train, "vec", "y", "row_id", 10, reservoir.Reservoir((ring,)), k=10), test)


@query("clf_reservoir_code")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    model = reservoir.fit_reservoir(train, "vec", "y", "row_id", 10, reservoir.Reservoir((small(),)), k=10, code_target=True)
    return scored(model, test)


@query("clf_reservoir_stacked")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    two = reservoir.Reservoir((small(units=30), small(units=30, seed=1)))
    return scored(reservoir.fit_reservoir(train, "vec", "y", "row_id", 10, two, k=10), test)


def wide(units, **kw):
    """The reservoirs of the two widest embeddings: 75 components of 2 x 50 states, 100 of 2 x 250."""
    return reservoir.Reservoir((small(units=units, **kw),))


@query("reservoir_embedding_wide")
def _(spark, sf):
    train, test = halves(vectors(spark, sf).select("row_id", "vec", "y", "is_test"))
    a, b = reservoir.reservoir_embedding(train, test, "vec", "row_id", wide(50, density=0.01), k=75)
    return a.unionByName(b).select("row_id", "is_test", "embedding")


@query("clf_reservoir_wide")
def _(spark, sf):
    train, test = halves(vectors(spark, sf))
    return scored(reservoir.fit_reservoir(train, "vec", "y", "row_id", 10, wide(250, rho=1.0, leak=1.0, density=1.0, scaling=1.0), k=100, alpha=1.0,
                                          readout_alpha=1.0), test)


_WAVE = 32


def waves(spark, sf):
    """Customers as one wave each: a full number of periods by segment (first two of five, or the rest), the phase by key."""
    df = prepare.label_encode(table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), "c_mktsegment"), "c_mktsegment")
    df = df.withColumn("y", (F.col("y") >= 2).cast("double"))
    turn = lambda i: (i * 2 * (F.col("y") + 1.0) / _WAVE + (F.col("row_id") % 97) / 97.0) * (2 * math.pi)
    df = df.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(_WAVE - 1)), lambda i: F.sin(turn(i))))
    return sampling.split_hash(df, "row_id", 0.5, 0)


@query("clf_reservoir_waves", f"""WITH c AS (SELECT c_custkey AS row_id, (dense_rank() OVER (ORDER BY c_mktsegment) > 2)::BIGINT AS y,
 substr({md5_sql(0, 'c_custkey')}, 1, 8) < '80000000' AS is_test FROM customer) SELECT row_id, y, y AS prediction FROM c WHERE is_test""")
def _(spark, sf):
    train, test = halves(waves(spark, sf))
    return scored(reservoir.fit_reservoir(train, "vec", "y", "row_id", 2, wide(50, scaling=1.0, noise=0.001), k=75), test)


# ---- many series ------------------------------------------------------------------------------

SPEC = series.SeriesSpec(inputs=1, outputs=1, units=30, rho=0.8, noise=0.0, input_scaling=1.0, teacher_scaling=0.002, seed=3)


def user_series(spark, sf):
    df = table(spark, sf, "events").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), "event_id",
        F.array(F.hour("ts") / 24.0).alias("x"), F.array("value").alias("y"))
    return sampling.split_ordered(df, ["t", "event_id"], 0.8)


def fit_users(spark, sf):
    train, test = halves(user_series(spark, sf))
    return series.series_reservoir_fit(train, "user_id", "t", "x", "y", SPEC), test


@query("series_reservoir")
def _(spark, sf):
    model, _ = fit_users(spark, sf)
    return model.fitted()


@query("series_continue")
def _(spark, sf):
    model, test = fit_users(spark, sf)
    return series.series_continue(model, test, "user_id", "t", "x")


@query("series_continue_stream")
def _(spark, sf):
    """The continuation fed by a file stream: new rows land in a folder, results go to a folder."""
    model, test = fit_users(spark, sf)
    landing, out, marks = (work_path(spark, n) for n in ("landing", "continued", "marks"))
    arrived = test.select("user_id", "t", "x")
    arrived.write.parquet(landing)
    stream = spark.readStream.schema(arrived.schema).parquet(landing)
    run = continue_stream(model, stream, "user_id", "t", "x").writeStream.outputMode("append").format("parquet") \
        .option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


# ---- pseudo-labels ----------------------------------------------------------------------------

def labelled_and_pool(spark, sf):
    """Training half of the orders: half of it labelled, half a pool; plus the test half."""
    train, test = halves(order_rows(spark, sf).select("row_id", "features", "y", "is_test"))
    known, pool = semi.unlabel(train, "row_id", 0.5, 21)
    return known, pool.drop("y"), test


@query("pseudo_label_union", f"""WITH d AS (SELECT l.doc_id, n_chars, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
 p AS (SELECT doc_id, n_chars, (n_chars > 600)::INT AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
 SELECT doc_id, n_chars, quality::BIGINT AS quality FROM d UNION ALL SELECT doc_id, n_chars, quality::BIGINT FROM
 (SELECT *, row_number() OVER (ORDER BY {hash60_sql(42, 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM p) WHERE rn <= floor(n * 0.3::DOUBLE)""")
def _(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels")
    known = docs.join(labels, "doc_id").select("doc_id", "n_chars", F.col("quality").cast("bigint").alias("quality"))
    pool = docs.join(labels, "doc_id", "left_anti").withColumn("guess", (F.col("n_chars") > 600).cast("int"))
    return semi.pseudo_label_union(known, pool, "quality", "guess", 0.3, 42, "doc_id")


@query("pseudo_label")
def _(spark, sf):
    known, pool, test = labelled_and_pool(spark, sf)
    model = semi.PseudoLabeler(clf.random_forest(numTrees=20, maxDepth=6), pool, 0.3, 42, "row_id").fit(known)
    return scored(model, test)


_RATES = [i / 9 for i in range(10)]


def sweep(df, specs: dict):
    """Ten rates by the given models over ten folds of the labelled half of ``df``; the rest is the pool."""
    known, pool = semi.unlabel(df.select("row_id", "vec", "y"), "row_id", 0.5, 21)
    known = sampling.contiguous_folds(known, ["row_id"], 10)
    return semi.pseudo_label_grid(known, pool.drop("y"), specs, _RATES, "fold", 10, "vec", "y", "row_id", 3)


def models(n: int) -> dict:
    return {"forest": trees.Spec(trees=n), "knn": neighbours.Knn(), "extra": trees.Spec(trees=n, rule="drawn", bootstrap=False)}


@query("pseudo_label_sweep")
def _(spark, sf):
    return sweep(order_rows(spark, sf), models(5))


@query("pseudo_label_sweep_corners", CORNERS + f""", k AS (SELECT ntile(10) OVER (ORDER BY row_id) - 1 AS fold FROM c WHERE substr({md5_sql(21, 'row_id')}, 1, 8) >= '80000000'),
 n AS (SELECT fold::INT AS fold, count(*) AS n_rows FROM k GROUP BY fold),
 m AS (SELECT unnest(['forest', 'knn', 'extra']) AS model), s AS (SELECT unnest(range(10)) / 9::DOUBLE AS rate)
 SELECT model, rate, fold, 1.0::DOUBLE AS accuracy, n_rows FROM n, m, s""")
def _(spark, sf):
    """Regions that every model learns without error, pseudo-labels included, at all rates and folds."""
    return sweep(corners(spark, sf), models(20))


@query("self_training")
def _(spark, sf):
    known, pool = semi.unlabel(order_rows(spark, sf).select("row_id", "features", "y"), "row_id", 0.5, 21)
    _, rows, rest = semi.self_train(known, pool.drop("y"), clf.decision_tree(maxDepth=6), "row_id", threshold=0.45, max_rounds=3)
    left = rest.select("row_id", F.lit(None).cast("double").alias("y"), F.lit(-1).alias("round"))
    return rows.select("row_id", "y", "round").unionByName(left)
