"""Population search. A population is a frame (run_id, gen, cand_id, x, fitness, ...), lower
fitness being better; any number of runs advance side by side in one job. Every step is column
expressions over it with keyed draws, so a step is repeatable. The costly part is the objective,
which is asked once per generation for all candidates that were never scored before.

Swarm and wolf steps need only the best candidates of a run, found by aggregation. The genetic,
firefly and salp steps need the whole population at hand and gather it as one array per run; its
length is the population size, a parameter of the search.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyflow.functions import clip, draw
from tallyflow.functions.columns import clip_array


@dataclass(frozen=True)
class Dim:
    """One coordinate: ``choice`` picks one of ``values``, ``int`` a whole number in [lo, hi],
    ``uniform`` a real number in [lo, hi] with three decimals."""
    kind: str
    lo: float = 0.0
    hi: float = 1.0
    values: tuple[float, ...] = ()

    @property
    def low(self) -> float:
        return float(min(self.values) if self.kind == "choice" else self.lo)

    @property
    def high(self) -> float:
        return float(max(self.values) if self.kind == "choice" else self.hi)

    def at(self, u: Column) -> Column:
        if self.kind == "choice":
            listed = F.array(*[F.lit(float(v)) for v in self.values])
            return F.element_at(listed, (F.floor(u * len(self.values)) + 1).cast("int"))
        if self.kind == "int":
            return F.floor(F.lit(float(self.lo)) + u * F.lit(float(self.hi - self.lo + 1))).cast("double")
        return F.round(F.lit(float(self.lo)) + u * F.lit(float(self.hi - self.lo)), 3)


# The ranges searched for (units, spectral radius, connectivity, input scaling).
RESERVOIR_SPACE = (Dim("int", 20, 50), Dim("uniform", 0, 1), Dim("uniform", 0, 1), Dim("uniform", 0, 1))


def _bounds(space: Sequence[Dim]) -> tuple[list[float], list[float]]:
    return [d.low for d in space], [d.high for d in space]


def sample_space(space: Sequence[Dim], seed, *keys) -> Column:
    """A random point as array<double>, drawn from the given keys."""
    return F.array(*[d.at(draw(seed, *keys, i, 0)) for i, d in enumerate(space)])


def init_population(spark: SparkSession, space: Sequence[Dim], pop: int, seed, run_id: int = 0) -> DataFrame:
    """``pop`` different random candidates. Surplus draws replace duplicates."""
    pool = spark.range(pop * 8).select(F.col("id"), sample_space(space, seed, 0, F.lit(run_id), F.col("id")).alias("x"))
    first = pool.groupBy("x").agg(F.min("id").alias("id")).orderBy("id").limit(pop)
    w = Window.partitionBy("run_id").orderBy("id")
    out = first.withColumn("run_id", F.lit(run_id).cast("bigint")).withColumn("cand_id", F.row_number().over(w) - 1)
    found = out.count()
    if found < pop:
        raise ValueError(f"the space yielded only {found} different candidates of {pop}")
    return out.select("run_id", F.lit(0).alias("gen"), F.col("cand_id").cast("bigint").alias("cand_id"), "x",
                      F.lit(None).cast("double").alias("fitness"))


def _u(seed, gen, dim, k) -> Column:
    return draw(seed, F.lit(gen), F.col("run_id"), F.col("cand_id"), dim, k)


def _at(arr, i: Column) -> Column:
    return F.element_at(F.col(arr) if isinstance(arr, str) else arr, i + 1)


def _d(arr: str, i: int) -> Column:
    return F.element_at(arr, i + 1)


def _best(pop: DataFrame, x: str, f: str, name: str) -> DataFrame:
    """Best candidate per run, ties to the smaller id."""
    return pop.groupBy("run_id").agg(F.min(F.struct(F.col(f).alias("f"), "cand_id", F.col(x).alias("x"))).alias("_m")) \
        .select("run_id", F.col("_m.x").alias(name), F.col("_m.f").alias(f"{name}_f"))


def with_memory(pop: DataFrame) -> DataFrame:
    """Add a zero velocity and make the current point the own best."""
    return (pop.withColumn("v", F.transform("x", lambda _: F.lit(0.0)))
            .withColumn("pbest_x", F.col("x")).withColumn("pbest_f", F.col("fitness")))


def update_memory(pop: DataFrame) -> DataFrame:
    """Replace a candidate's own best where the current fitness is lower."""
    better = F.col("pbest_f").isNull() | (F.col("fitness") < F.col("pbest_f"))
    return pop.withColumn("pbest_x", F.when(better, F.col("x")).otherwise(F.col("pbest_x"))) \
        .withColumn("pbest_f", F.when(better, F.col("fitness")).otherwise(F.col("pbest_f")))


def _advance(df: DataFrame, gen: int, x: Column, **more: Column) -> DataFrame:
    return df.select("run_id", F.lit(gen + 1).alias("gen"), "cand_id", x.alias("x"),
                     F.lit(None).cast("double").alias("fitness"), *[c.alias(n) for n, c in more.items()])


def step_pso(pop: DataFrame, space: Sequence[Dim], gen: int, seed, omega: float = 0.5, phip: float = 0.5,
             phig: float = 0.5) -> DataFrame:
    """Particle swarm: inertia plus pulls to the own best and to the run's best."""
    led = pop.join(_best(pop, "pbest_x", "pbest_f", "gbest"), "run_id")
    led = led.withColumn("v", F.array(*[
        F.lit(omega) * _d("v", i) + F.lit(phip) * _u(seed, gen, i, 0) * (_d("pbest_x", i) - _d("x", i))
        + F.lit(phig) * _u(seed, gen, i, 1) * (_d("gbest", i) - _d("x", i)) for i in range(len(space))]))
    moved = [clip(_d("x", i) + _d("v", i), d.low, d.high) for i, d in enumerate(space)]
    return _advance(led, gen, F.array(*moved), v=F.col("v"), pbest_x=F.col("pbest_x"), pbest_f=F.col("pbest_f"))


def step_pso2(pop: DataFrame, whole: Sequence[bool], redraw: Sequence[bool], gen: int, seed, w: float = 1.7,
              c1: float = 2.5, c2: float = 2.0) -> DataFrame:
    """Swarm without bounds: the move is rounded (halves to even) on ``whole`` dimensions, the
    new value is made positive, and a zero on ``redraw`` dimensions is drawn anew from 5..49."""
    led = pop.join(_best(pop, "pbest_x", "pbest_f", "gbest"), "run_id")
    led = led.withColumn("v", F.array(*[
        F.lit(w) * _d("v", i) + F.lit(c1) * _u(seed, gen, i, 0) * (_d("pbest_x", i) - _d("x", i))
        + F.lit(c2) * _u(seed, gen, i, 1) * (_d("gbest", i) - _d("pbest_x", i)) for i in range(len(whole))]))
    points = []
    for i in range(len(whole)):
        move = F.element_at("v", i + 1)
        to = F.abs(F.element_at("x", i + 1) + (F.bround(move, 0) if whole[i] else move))
        if redraw[i]:
            again = F.floor(F.lit(5.0) + F.lit(45.0) * _u(seed, gen, i, 2)).cast("double")
            to = F.when(to == 0, again).otherwise(to)
        points.append(to)
    return _advance(led, gen, F.array(*points), v=F.col("v"), pbest_x=F.col("pbest_x"), pbest_f=F.col("pbest_f"))


def step_gwo(pop: DataFrame, space: Sequence[Dim], gen: int, gens: int, seed,
             history: DataFrame | None = None) -> DataFrame:
    """Grey wolf: the mean of three points placed around the three best, with a reach that
    shrinks linearly over the generations. The leaders are the best of ``history`` (by default of
    this population); a run with fewer than three repeats its last one."""
    seen = pop if history is None else history
    ranked = seen.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("fitness", "gen", "cand_id")))
    lead = ranked.filter(F.col("_r") <= 3).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("_r", "x"))).alias("_l"))
    led = pop.join(lead, "run_id")
    a = 2.0 - gen * (2.0 / gens)

    def pull(i, k):
        best = F.element_at(F.element_at("_l", F.least(F.lit(k + 1), F.size("_l")))["x"], i + 1)
        reach = F.lit(2.0 * a) * _u(seed, gen, i, 2 * k) - F.lit(a)
        sway = F.lit(2.0) * _u(seed, gen, i, 2 * k + 1)
        return best - reach * F.abs(sway * best - _d("x", i))

    x = [clip((pull(i, 0) + pull(i, 1) + pull(i, 2)) / F.lit(3.0), d.low, d.high) for i, d in enumerate(space)]
    return _advance(led, gen, F.array(*x))


def _gathered(pop: DataFrame) -> DataFrame:
    """One record per run: the population in candidate order."""
    return pop.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("cand_id", "fitness", "x"))).alias("p"))


def step_ffa(pop: DataFrame, space: Sequence[Dim], gen: int, seed, alpha: float = 0.5, gamma: float = 1.0) -> DataFrame:
    """Firefly: every candidate is drawn to all better ones of the same generation, more strongly
    the closer they are, with a random part as wide as the range. All move at once."""
    lo, hi = _bounds(space)
    span = F.array(*[F.lit(b - a) for a, b in zip(lo, hi)])

    def move(me):
        def add(total, other):
            d2 = F.aggregate(F.zip_with(me["x"], other["x"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            beta = F.exp(F.lit(-gamma) * d2)
            return F.transform(total, lambda s, i: s + beta * (_at(other["x"], i) - _at(me["x"], i)) + F.lit(alpha) * (
                draw(seed, F.lit(gen), F.col("run_id"), me["cand_id"], i, other["cand_id"]) - F.lit(0.5)) * _at(span, i))
        brighter = F.filter("p", lambda o: o["fitness"] < me["fitness"])
        return F.struct(me["cand_id"].alias("cand_id"), F.aggregate(brighter, me["x"], add).alias("x"))

    moved = _gathered(pop).select("run_id", F.inline(F.transform("p", move)))
    return _advance(moved, gen, clip_array("x", lo, hi))


def step_ssa(pop: DataFrame, space: Sequence[Dim], gen: int, gens: int, seed, food: DataFrame | None = None) -> DataFrame:
    """Salp chain: the first half (index <= n/2) moves around the food, each later one to the
    middle between itself and its already moved predecessor. ``food`` (run_id, food) is the best
    point so far; by default the best of this population."""
    lo, hi = _bounds(space)
    low, high = (F.array(*[F.lit(v) for v in b]) for b in (lo, hi))
    c1 = 2.0 * math.exp(-((4.0 * gen / gens) ** 2))
    if food is None:
        food = _best(pop, "x", "fitness", "food").select("run_id", "food")
    runs = _gathered(pop).join(food, "run_id")

    def chain(done, me):
        at = F.size(done)

        def leader(_, i):
            u2 = draw(seed, F.lit(gen), F.col("run_id"), me["cand_id"], i, 0)
            u3 = draw(seed, F.lit(gen), F.col("run_id"), me["cand_id"], i, 1)
            reach = F.lit(c1) * ((_at(high, i) - _at(low, i)) * u2 + _at(low, i))
            return _at("food", i) + F.when(u3 >= 0.5, reach).otherwise(-reach)

        def follower(v, i):
            return (_at(F.element_at(done, -1)["x"], i) + v) / F.lit(2.0)

        x = F.when(at <= F.size("p") / 2.0, F.transform(me["x"], leader)).otherwise(F.transform(me["x"], follower))
        return F.concat(done, F.array(F.struct(me["cand_id"].alias("cand_id"), clip_array(x, lo, hi).alias("x"))))

    # the chain starts from a typed empty list
    empty = F.slice(F.transform("p", lambda me: F.struct(me["cand_id"].alias("cand_id"), me["x"].alias("x"))), 1, 0)
    moved = runs.select("run_id", F.inline(F.aggregate("p", empty, chain)))
    return _advance(moved, gen, F.col("x"))


def step_ga(pop: DataFrame, space: Sequence[Dim], gen: int, seed, size: int, retain: float = 0.2,
            random_select: float = 0.05, mutate: float = 0.01) -> DataFrame:
    """Genetic step: keep the best share and a few others, mutate a gene now and then, fill up
    with one-point crossover children. When a pair picks the same parent, a fresh random point
    takes the second place."""
    keep, dims = max(1, int(size * retain)), len(space)
    draws = lambda tag, *key: draw(seed, F.lit(gen), F.col("run_id"), *key, tag)
    ordered = F.array_sort(F.transform("p", lambda m: F.struct(m["fitness"].alias("fitness"),
                                                               m["cand_id"].alias("cand_id"), m["x"].alias("x"))))
    runs = _gathered(pop).withColumn("o", ordered)
    chosen = F.filter("o", lambda m, i: (i < keep) | (draws("select", m["cand_id"]) < F.lit(random_select)))

    def mutated(m):
        pos = F.floor(draws("gene", m["cand_id"]) * dims).cast("int")
        fresh = F.array(*[d.at(draws("value", m["cand_id"])) for d in space])
        changed = F.transform(m["x"], lambda v, i: F.when(i == pos, _at(fresh, i)).otherwise(v))
        return F.when(draws("mutate", m["cand_id"]) < F.lit(mutate), changed).otherwise(m["x"])

    runs = runs.withColumn("parents", F.transform(chosen, mutated))

    def pair(c):
        n = F.size("parents")
        m = F.floor(draws("male", c) * n).cast("int")
        f = F.floor(draws("female", c) * n).cast("int")
        father = _at("parents", m)
        fresh = F.array(*[d.at(draws(f"fresh{i}", c)) for i, d in enumerate(space)])
        mother = F.when(_at("parents", f) == father, fresh).otherwise(_at("parents", f))
        cut = (F.lit(1) + F.floor(draws("cut", c) * (dims - 1))).cast("int")
        child = lambda a, b: F.concat(F.slice(a, F.lit(1), cut), F.slice(b, cut + 1, F.lit(dims)))
        return F.array(child(father, mother), child(mother, father))

    pairs = F.sequence(F.lit(0), F.lit((size + 1) // 2))
    children = F.flatten(F.transform(pairs, pair))
    filled = F.slice(F.concat("parents", children), 1, size)
    out = runs.select("run_id", F.posexplode(filled).alias("cand_id", "x")).withColumn("cand_id", F.col("cand_id").cast("bigint"))
    return _advance(out, gen, F.col("x"))


def unscored(pop: DataFrame, history: DataFrame) -> DataFrame:
    """Different points of ``pop`` that the history (x, fitness) does not hold yet."""
    return pop.select("x").distinct().join(history.select("x").distinct(), "x", "left_anti")


def with_fitness(pop: DataFrame, history: DataFrame) -> DataFrame:
    """Fill in the fitness from the history of scored points."""
    known = history.groupBy("x").agg(F.min("fitness").alias("_f"))
    return pop.join(known, "x", "left").withColumn("fitness", F.coalesce("_f", "fitness")).drop("_f")


def search_trace(history: DataFrame) -> DataFrame:
    """(run_id, gen, best_fitness, best_x, best_so_far): best per generation and running best."""
    per = history.groupBy("run_id", "gen").agg(
        F.min("fitness").alias("best_fitness"),
        F.min(F.struct("fitness", "cand_id", "x")).alias("_m"))
    w = Window.partitionBy("run_id").orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("run_id", "gen", "best_fitness", F.col("_m.x").alias("best_x"),
                      F.min("best_fitness").over(w).alias("best_so_far"))


def _settled(df: DataFrame) -> DataFrame:
    """A searched population as plain rows without lineage. Its size is the population size times
    the generations, both parameters of the search; the data being searched over never comes here."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


Objective = Callable[[list[list[float]]], list[float]]


def evaluate(pop: DataFrame, scored: DataFrame | None, objective: Objective) -> tuple[DataFrame, DataFrame]:
    """(population with fitness, table of scored points). New points go to the objective in one
    call; there are at most population-size many."""
    spark = pop.sparkSession
    kind = "x array<double>, fitness double"
    if scored is None:
        scored = spark.createDataFrame([], kind)
    fresh = [list(r["x"]) for r in unscored(pop, scored).collect()]
    if fresh:
        values = [math.nan if v is None else float(v) for v in objective(fresh)]   # a missing value is the worst, as NaN is
        scored = _settled(scored.unionByName(spark.createDataFrame(list(zip(fresh, values)), kind)))
    return _settled(with_fitness(pop, scored).select(*pop.columns)), scored


def _rank(fitness: float | None) -> float:
    """Fitness for comparison: null and NaN are the worst."""
    return math.inf if fitness is None or math.isnan(fitness) else fitness


def population_search(spark: SparkSession, space: Sequence[Dim], objective: Objective, rule: str, pop: int, gens: int,
                      seed=0, min_step: float = 1e-4, min_gain: float = 1e-4, **options) -> tuple[list[float], float, DataFrame]:
    """(best point, best fitness, history). ``rule``: ga, pso, pso2, ffa, gwo or ssa. The pso rule
    stops early once a new best is closer than ``min_step`` or better by less than ``min_gain``."""
    now, scored = evaluate(init_population(spark, space, pop, seed), None, objective)
    if rule in ("pso", "pso2"):
        now = _settled(with_memory(now))
    base = ["run_id", "gen", "cand_id", "x", "fitness"]
    history = _settled(now.select(*base))
    best = history.orderBy("fitness", "gen", "cand_id").first()
    for gen in range(gens):
        if rule == "pso":
            moved = step_pso(now, space, gen, seed, **options)
        elif rule == "pso2":
            given = dict(options)
            moved = step_pso2(now, given.pop("whole", [False] * len(space)), given.pop("redraw", [False] * len(space)), gen, seed, **given)
        elif rule == "gwo":
            moved = step_gwo(now, space, gen, gens, seed, history)
        elif rule == "ffa":
            moved = step_ffa(now, space, gen, seed, **options)
        elif rule == "ssa":
            food = spark.createDataFrame([(0, list(best["x"]))], "run_id bigint, food array<double>")
            moved = step_ssa(now, space, gen, gens, seed, food)
        elif rule == "ga":
            moved = step_ga(now, space, gen, seed, pop, **options)
        else:
            raise ValueError(f"unknown rule {rule!r}")
        now, scored = evaluate(_settled(moved), scored, objective)
        if rule in ("pso", "pso2"):
            now = _settled(update_memory(now))
        history = _settled(history.unionByName(now.select(*base)))
        top = now.orderBy("fitness", "cand_id").first()
        if _rank(top["fitness"]) < _rank(best["fitness"]):
            step = sum((a - b) ** 2 for a, b in zip(top["x"], best["x"])) ** 0.5
            gain, best = best["fitness"] - top["fitness"], top
            if rule == "pso" and (step <= min_step or gain <= min_gain):
                break
    return list(best["x"]), best["fitness"], history
