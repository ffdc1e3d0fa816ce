import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.operators import evaluate, ranking, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one order value, and one class holds most rows."""
    rng = np.random.default_rng(1)
    rows = [(i, 50 if i % 3 == 0 else int(rng.integers(0, 100)), "big" if i % 10 else "small") for i in range(3000)]
    return spark.createDataFrame(rows, "id long, v int, c string").repartition(7).cache()


def sorted_rows(df):
    return sorted((r["v"], r["id"]) for r in df.collect())


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_thresholds_are_exact_at_any_size_limit(skewed, limit):
    want = sorted_rows(skewed)
    ranks = [1, 2, 999, 1000, 1001, 1500, 2000, 2001, 2999, 3000]
    got = ranking.order_thresholds(skewed, ["v", "id"], {None: ranks}, {None: 3000}, rows_per_task=limit)
    assert {r: got[(None, r)] for r in ranks} == {r: want[r - 1] for r in ranks}


@pytest.mark.parametrize("limit", [1_000_000, 25])
def test_head_fraction_per_class(skewed, limit):
    shares = {"big": 0.37, "small": 0.01}
    kept = sampling.rebalance_head(skewed, "c", shares, ["v", "id"], limit)
    got = {c: sorted_rows(kept.filter(F.col("c") == c)) for c in shares}
    for c, f in shares.items():
        full = sorted_rows(skewed.filter(F.col("c") == c))
        assert got[c] == full[:int(len(full) * f)]


def test_head_fraction_is_a_pushed_filter(spark, tmp_path, skewed):
    skewed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = sampling.rebalance_head(df, "c", {"big": 0.5}, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(c)" in plan and "LessThanOrEqual(id" in plan


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_folds_and_ordered_split(skewed, limit):
    order = [i for _, i in sorted_rows(skewed)]
    folds = sampling.contiguous_folds(skewed, ["v", "id"], 7, rows_per_task=limit)
    place = {r["id"]: r["fold"] for r in folds.collect()}
    sizes = [3000 // 7 + (1 if i < 3000 % 7 else 0) for i in range(7)]
    assert [place[i] for i in order] == [f for f, n in enumerate(sizes) for _ in range(n)]
    split = sampling.split_ordered(skewed, ["v", "id"], 0.8, rows_per_task=limit)
    flags = {r["id"]: r["is_test"] for r in split.collect()}
    assert [flags[i] for i in order] == [False] * 2400 + [True] * 600


def test_stratified_folds_do_not_depend_on_the_bucketing(skewed):
    a = sampling.stratified_folds(skewed, "c", 5, 3, "id")
    b = sampling.stratified_folds(skewed.repartition(3), "c", 5, 3, "id", rows_per_task=40)
    assert {r["id"]: r["fold"] for r in a.collect()} == {r["id"]: r["fold"] for r in b.collect()}
    counts = a.groupBy("c", "fold").count().groupBy("c").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in counts)


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_sample_is_exact_and_repeatable(skewed, limit):
    got = {r["id"] for r in sampling.sample_n(skewed, 777, 4, "id", limit).collect()}
    assert len(got) == 777
    assert got == {r["id"] for r in sampling.sample_n(skewed.repartition(2), 777, 4, "id").collect()}
    assert sampling.sample_n(skewed, 0, 4, "id").count() == 0 and sampling.sample_n(skewed, 9999, 4, "id").count() == 3000


def test_shuffle_order_depends_on_ids_only(skewed):
    a, b = ([r["id"] for r in sampling.shuffle_rows(d, 1, "id").collect()] for d in (skewed, skewed.repartition(2)))
    assert a == b and sorted(a) == list(range(3000)) and a != sorted(a)


def test_holdout_parts_are_disjoint_and_complete(skewed):
    train, test = sampling.holdout_head(skewed, "c", {"big": 0.2}, ["v", "id"])
    a, b = ({r["id"] for r in d.collect()} for d in (train, test))
    assert not a & b and len(a | b) == 3000 and len(b) == int(2700 * 0.2)


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_roc_against_numpy(spark, limit):
    rng = np.random.default_rng(2)
    score, y = np.round(rng.normal(size=500), 1), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)], "s double, y int")
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in evaluate.roc_curve(df, "y", "s", limit).collect()}
    assert got == {float(s): (int(((score >= s) & (y == 1)).sum()), int(((score >= s) & (y == 0)).sum())) for s in set(score)}
    diff = score[y == 1][:, None] - score[y == 0][None, :]
    auc = evaluate.roc_auc(df, "y", "s", limit).first()[0]
    assert abs(auc - ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size) < 1e-12


def test_report_handles_classes_never_predicted_or_never_true(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a"), ("b", "c")], "y string, p string")
    rep = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rep["b"]["precision"] == 0 and rep["c"]["recall"] == 0 and rep["c"]["support"] == 0
    assert rep["a"]["precision"] == 0.5 and rep["accuracy"]["f1"] == 0.25
    cells = {(r["truth"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[("c", "c")] == 0


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_null_labels_keep_their_rows_in_folds(spark, limit):
    df = spark.range(1000).selectExpr("id", "if(id % 4 = 0, null, string(id % 3)) AS label")
    out = sampling.stratified_folds(df, "label", 5, 0, "id", rows_per_task=limit)
    assert out.count() == 1000
    assert {r["n"] for r in out.filter("label IS NULL").groupBy("fold").agg(F.count("id").alias("n")).collect()} == {50}


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_null_order_keys_come_first(spark, limit):
    df = spark.range(400).selectExpr("id", "if(id % 10 = 0, null, id) AS k", "'a' AS label")
    head = sampling.rebalance_head(df, "label", {"a": 0.5}, ["k", "id"], rows_per_task=limit)
    got = {r["id"] for r in head.collect()}
    assert len(got) == 200 and {i for i in range(0, 400, 10)} <= got
    train, test = sampling.holdout_head(df, "label", {"a": 0.05}, ["k", "id"], rows_per_task=limit)
    assert (train.count(), test.count()) == (380, 20)
    assert sampling.split_ordered(df, ["k", "id"], 0.8, rows_per_task=limit).filter("is_test IS NULL").count() == 0


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_large_integers_and_nan_order_exactly(spark, limit):
    big = spark.range(600).selectExpr("id", f"if(id < 300, {2**60 + 127}L, {2**60}L + id) AS k")
    rows = sorted((r["k"], r["id"]) for r in big.collect())
    got = ranking.order_thresholds(big, ["k", "id"], {None: [1, 299, 450]}, {None: 600}, rows_per_task=limit)
    assert [got[(None, n)] for n in (1, 299, 450)] == [rows[n - 1] for n in (1, 299, 450)]
    odd = spark.range(300).selectExpr("id", "if(id % 3 = 0, double('NaN'), double(id)) AS k")
    assert sampling.split_ordered(odd, ["k", "id"], 0.5, rows_per_task=limit).filter("NOT is_test").count() == 150


def test_string_order_keys_are_refused_at_any_size(spark):
    df = spark.range(10).selectExpr("string(id) AS k")
    with pytest.raises(ValueError, match="order column k"):
        sampling.split_ordered(df, ["k"])


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_roc_leaves_out_rows_without_a_score(spark, limit):
    df = spark.range(500).selectExpr("int(id % 2) AS y", "case when id % 10 = 0 then null when id % 10 = 5 then double('NaN') else id / 500 end AS s")
    rows = evaluate.roc_curve(df, "y", "s", rows_per_task=limit)
    assert rows.count() == 400 and rows.agg(F.max("tp")).first()[0] == 200
