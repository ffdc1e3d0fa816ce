import pytest
from pyspark.sql import functions as F

from tallyflow.operators import search

SPACE = (search.Dim("int", 20, 50), search.Dim("uniform", 0, 1), search.Dim("choice", values=(0.1, 0.5, 0.9)))


def bowl(points):
    """Smallest at (30, 0.5, 0.5)."""
    return [((p[0] - 30) / 30) ** 2 + (p[1] - 0.5) ** 2 + (p[2] - 0.5) ** 2 for p in points]


def test_population_has_different_points_inside_the_space(spark):
    pop = search.init_population(spark, SPACE, 12, 3).collect()
    assert len({tuple(r["x"]) for r in pop}) == 12 and [r["cand_id"] for r in sorted(pop, key=lambda r: r["cand_id"])] == list(range(12))
    for r in pop:
        assert 20 <= r["x"][0] <= 50 and r["x"][0] == int(r["x"][0]) and 0 <= r["x"][1] <= 1 and r["x"][2] in (0.1, 0.5, 0.9)
    with pytest.raises(ValueError):
        search.init_population(spark, (search.Dim("choice", values=(1.0, 2.0)),), 3, 0)


@pytest.mark.parametrize("rule,options", [
    ("ga", {"mutate": 0.2}), ("pso", {}), ("ffa", {"gamma": 0.01}), ("gwo", {}), ("ssa", {}),
    ("pso2", {"whole": [True, False, False], "redraw": [True, False, False]})])
def test_rules_keep_size_and_never_lose_the_best(spark, rule, options):
    best, value, history = search.population_search(spark, SPACE, bowl, rule, 6, 3, seed=2, **options)
    assert abs(bowl([best])[0] - value) < 1e-12
    trace = search.search_trace(history).orderBy("gen").collect()
    runs = [r["best_so_far"] for r in trace]
    assert runs == sorted(runs, reverse=True) and abs(runs[-1] - value) < 1e-12
    assert all(r["count"] == 6 for r in history.groupBy("gen").count().collect())
    if rule != "pso2":
        out = history.filter((F.element_at("x", 1) < 20) | (F.element_at("x", 1) > 50) | (F.element_at("x", 2) < 0) | (F.element_at("x", 2) > 1))
        assert out.count() == 0


def test_scored_points_are_not_asked_again(spark):
    asked = []

    def spy(points):
        asked.extend(map(tuple, points))
        return bowl(points)

    search.population_search(spark, SPACE, spy, "ga", 5, 3, seed=1)
    assert len(asked) == len(set(asked))


def test_nan_fitness_is_never_the_best(spark):
    pop = spark.createDataFrame([(0, 0, i, [float(i)], f) for i, f in enumerate([float("nan"), 2.0, 1.0])],
                                "run_id long, gen int, cand_id long, x array<double>, fitness double")
    assert search.search_trace(pop).first()["best_x"] == [2.0]
    lead = search.step_gwo(pop, (search.Dim("uniform", 0, 1),), 0, 5, 1)
    assert lead.count() == 3


def test_missing_fitness_is_never_the_best(spark):
    def partly(points):
        return [None if i == 0 else v for i, v in enumerate(bowl(points))]

    best, value, history = search.population_search(spark, SPACE, partly, "gwo", 5, 2, seed=1)
    known = history.filter("NOT isnan(fitness)")
    assert value == known.agg(F.min("fitness")).first()[0] and history.filter("isnan(fitness)").count() > 0
