import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from tallyflow.operators import classifiers as clf
from tallyflow.operators import evaluate, linear, neighbours, search, trees, votes
from tallyflow.plans import searches


def rows(spark, classes):
    rng = np.random.default_rng(4)
    made = []
    for i in range(160):
        c = i % classes
        x = rng.normal(size=3) + np.array([c, -c, 0.5 * c])
        made.append((i, [float(v) for v in x], float(c)))
    df = spark.createDataFrame(made, "row_id long, vec array<double>, y double")
    return df.filter("row_id % 4 <> 0"), df.filter("row_id % 4 = 0")


@pytest.mark.parametrize("classes", [3])
def test_settings_together_lose_as_each_alone(spark, classes):
    train, test = rows(spark, classes)
    settings = [votes.Setting(1.5, 4, 0.5, 100, 7)]
    got = votes.VoteSearch(train, test, "vec", "y", "row_id", classes, size=16).losses(settings)
    n = train.count()
    featured = [df.withColumn("features", array_to_vector("vec")) for df in (train, test)]
    for s, loss in zip(settings, got):
        models = {"p_svm": clf.fit_poly_svm(train, "vec", C=s.svm_c, size=16),
                  "p_rf": trees.fit_forest(train, "vec", "y", "row_id", classes, trees.Spec(trees=s.trees)),
                  "p_lr": clf.fit_held(clf.logistic_regression(C=s.lr_c, n=n), featured[0]),
                  "p_lda": linear.discriminant_fit(train, "vec", "y", classes)}
        out = featured[1]
        for name, m in models.items():
            out = clf.probability_array(m.transform(out), name)
        knn = neighbours.knn_probability(neighbours.knn_join(test, train, "vec", "row_id", "row_id", s.k, carry="y"), classes)
        out = out.join(knn.withColumnRenamed("probability", "p_knn").withColumnRenamed("query_id", "row_id"), "row_id")
        want = evaluate.log_loss(clf.soft_vote(out, votes.VOTERS), "y", "probability").first()[0]
        assert abs(loss - want) < 2e-4


def test_later_settings_may_ask_for_more_trees_and_neighbours(spark):
    train, test = rows(spark, 2)
    small, large = votes.Setting(1.0, 3, 1.0, 50, 5), votes.Setting(1.0, 8, 1.0, 50, 500)
    made = votes.VoteSearch(train, test, "vec", "y", "row_id", 2, size=8)
    first = made.losses([small])
    assert np.allclose(made.losses([large, small]), [made.losses([large])[0], first[0]], atol=1e-9)
    few = votes.fit_logits(train, "vec", "y", 2, [(1.0, 1), (1.0, 50)])
    assert not np.allclose(few[0][0], few[1][0])           # the number of steps is one of the parameters


def test_first_trees_of_a_forest_in_turns(spark):
    train, test = rows(spark, 2)
    forest = trees.fit_forest(train, "vec", "y", "row_id", 2, trees.Spec(trees=6))
    whole = {r["row_id"]: r["probabilities"] for r in forest.probabilities_at(test, [2, 6]).collect()}
    assert np.allclose([whole[r["row_id"]][2:] for r in forest.transform(test).collect()], [r["probability"] for r in forest.transform(test).collect()])
    forest.model_bytes = 1
    assert whole == {r["row_id"]: r["probabilities"] for r in forest.probabilities_at(test, [2, 6]).collect()}
    with pytest.raises(ValueError):
        forest.probabilities_at(test, [7])


def test_the_vote_is_searched_by_the_whole_swarm(spark, monkeypatch):
    seen = {}

    def spy(spark, space, objective, rule, pop, gens, **options):
        seen.update(space=space, rule=rule, pop=pop, gens=gens, options=options)
        return [], 0.0, spark.createDataFrame([(0, 0, 0, [1.0], 0.5)], "run_id long, gen int, cand_id long, x array<double>, fitness double")

    monkeypatch.setattr(search, "population_search", spy)
    from tests.test_oracles import SF
    import __spark_entry__ as e
    assert e.queries()["search_vote"](spark, SF).count() == 1
    assert seen["pop"] == 100 and seen["gens"] == 20 and seen["space"] is searches.VOTE_SPACE
    assert seen["space"][0].high == 499 and seen["space"][3].high == 999 and seen["space"][4].high == 99
