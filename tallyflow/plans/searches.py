"""Population search steps over many small populations derived from the orders table, and the
two searches with a Spark objective. Eight consecutive order keys form one population, so every
population has at most eight candidates whatever the table size."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import reservoir, search, votes
from tallyflow.plans.models import halves, vectors
from tallyflow.plans.registry import draw_sql, query, r6, table
from tallyflow.sources.storage import durable

SPACE = search.RESERVOIR_SPACE
GEN, GENS, POP = 1, 10, 8
_LO, _HI = [20, 0, 0, 0], [50, 1, 1, 1]


def populations(spark, sf):
    """Candidates drawn by key; the order price stands for the fitness. The rows are placed by
    population while they are still narrow, so a step needs no shuffle of its own."""
    df = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / POP).cast("bigint").alias("run_id"), (F.col("o_orderkey") % POP).alias("cand_id"),
        F.col("o_totalprice").alias("fitness")).repartition("run_id")
    x = search.sample_space(SPACE, 0, 0, F.col("run_id"), F.col("cand_id"))
    return df.select("run_id", F.lit(GEN).alias("gen"), "cand_id", x.alias("x"), "fitness")


def memories(spark, sf):
    """Populations with a velocity and an own best drawn by key."""
    keyed = lambda tag: F.array(*[search.draw(tag, F.col("run_id"), F.col("cand_id"), i) for i in range(4)])
    return populations(spark, sf).withColumn("v", keyed("v")).withColumn(
        "pbest_x", F.zip_with("x", keyed("p"), lambda a, b: a * b)).withColumn("pbest_f", F.col("fitness") * 0.5)


def spread(df, extra=()):
    """Array columns as one rounded column per dimension."""
    return df.select("run_id", F.col("cand_id").cast("bigint").alias("cand_id"),
                     *[r6(F.element_at(c, i + 1), f"{c}{i}") for c in ("x", *extra) for i in range(4)])


def _dim(i: int, u: str) -> str:
    return f"floor(20 + {u} * 31)::DOUBLE" if i == 0 else f"round({u}, 3)"


def _pop_sql() -> str:
    """Candidates as rows (run_id, cand_id, fitness, x0..x3)."""
    xs = ", ".join(f"{_dim(i, draw_sql(0, 0, 'r', 'c', i, 0))} AS x{i}" for i in range(4))
    return ("pop AS (SELECT r AS run_id, c AS cand_id, f AS fitness, " + xs +
            f" FROM (SELECT o_orderkey // {POP} AS r, o_orderkey % {POP} AS c, o_totalprice AS f FROM orders))")


def _mem_sql() -> str:
    cols = ", ".join([f"{draw_sql(chr(39) + 'v' + chr(39), 'run_id', 'cand_id', i)} AS v{i}" for i in range(4)]
                     + [f"x{i} * {draw_sql(chr(39) + 'p' + chr(39), 'run_id', 'cand_id', i)} AS b{i}" for i in range(4)])
    return (f"{_pop_sql()}, mem AS (SELECT *, fitness * 0.5::DOUBLE AS bf, {cols} FROM pop), "
            "led AS (SELECT *, " + ", ".join(f"first_value(b{i}) OVER w AS g{i}" for i in range(4)) +
            " FROM mem WINDOW w AS (PARTITION BY run_id ORDER BY bf, cand_id))")


def _step(dim, k, seed=0) -> str:
    return draw_sql(seed, GEN, "run_id", "cand_id", dim, k)


def _clip(i: int, e: str) -> str:
    return f"greatest({_LO[i]}::DOUBLE, least({_HI[i]}::DOUBLE, {e}))"


def _cols(exprs: dict[str, str]) -> str:
    return "run_id, cand_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in exprs.items())


@query("search_init", f"WITH {_pop_sql()} SELECT {_cols({f'x{i}': f'x{i}' for i in range(4)})} FROM pop")
def _(spark, sf):
    return spread(populations(spark, sf))


_PSO_V = {i: f"(0.5::DOUBLE * v{i} + 0.5::DOUBLE * {_step(i, 0)} * (b{i} - x{i}) + 0.5::DOUBLE * {_step(i, 1)} * (g{i} - x{i}))" for i in range(4)}


@query("search_pso_step", f"WITH {_mem_sql()} SELECT " + _cols(
    {**{f"x{i}": _clip(i, f"x{i} + {_PSO_V[i]}") for i in range(4)}, **{f"v{i}": _PSO_V[i] for i in range(4)}}) + " FROM led")
def _(spark, sf):
    return spread(search.step_pso(memories(spark, sf), SPACE, GEN, 0), ("v",))


_P2_V = {i: f"(1.7::DOUBLE * v{i} + 2.5::DOUBLE * {_step(i, 0)} * (b{i} - x{i}) + 2::DOUBLE * {_step(i, 1)} * (g{i} - b{i}))" for i in range(4)}


def _p2(i):
    if i == 3:
        return f"abs(x{i} + {_P2_V[i]})"
    to = f"abs(x{i} + round_even({_P2_V[i]}, 0))"
    return to if i else f"CASE WHEN {to} = 0 THEN floor(5 + 45 * {_step(i, 2)}) ELSE {to} END"


@query("search_pso2_step", f"WITH {_mem_sql()} SELECT " + _cols({f"x{i}": _p2(i) for i in range(4)}) + " FROM led")
def _(spark, sf):
    moved = search.step_pso2(memories(spark, sf), [True, True, True, False], [True, False, False, False], GEN, 0)
    return spread(moved)


_A = 2.0 - GEN * (2.0 / GENS)


def _pull(i, k):
    return (f"(l{k}_{i} - (2 * {_A}::DOUBLE * {_step(i, 2 * k)} - {_A}::DOUBLE) * abs(2 * {_step(i, 2 * k + 1)} * l{k}_{i} - x{i}))")


_LEAD = ", ".join(f"nth_value(x{i}, least({k + 1}, n)) OVER w AS l{k}_{i}" for k in range(3) for i in range(4))


@query("search_gwo_step", f"WITH {_pop_sql()}, cnt AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM pop), "
       f"led AS (SELECT *, {_LEAD} FROM cnt WINDOW w AS (PARTITION BY run_id ORDER BY fitness, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) "
       "SELECT " + _cols({f"x{i}": _clip(i, f"({_pull(i, 0)} + {_pull(i, 1)} + {_pull(i, 2)}) / 3") for i in range(4)}) + " FROM led")
def _(spark, sf):
    return spread(search.step_gwo(populations(spark, sf), SPACE, GEN, GENS, 0))


_FFA_U = [f"(('0x' || substr(md5(concat_ws('|', 0, {GEN}, a.run_id, a.cand_id, {i}, b.cand_id)), 1, 8))::UBIGINT / 4294967296::DOUBLE)" for i in range(4)]


@query("search_ffa_step", f"WITH {_pop_sql()}, att AS (SELECT a.run_id, a.cand_id, exp(-0.001::DOUBLE * ("
       + " + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(4)) + ")) AS beta, "
       + ", ".join(f"b.x{i} - a.x{i} AS d{i}, 0.5::DOUBLE * ({_FFA_U[i]} - 0.5::DOUBLE) * {_HI[i] - _LO[i]} AS n{i}" for i in range(4))
       + " FROM pop a JOIN pop b ON a.run_id = b.run_id AND b.fitness < a.fitness), "
       "sm AS (SELECT run_id, cand_id, " + ", ".join(f"sum(beta * d{i} + n{i}) AS s{i}" for i in range(4)) + " FROM att GROUP BY ALL) "
       "SELECT " + "p.run_id, p.cand_id, " + ", ".join(f"round({_clip(i, f'p.x{i} + coalesce(s{i}, 0)')}, 6) AS x{i}" for i in range(4))
       + " FROM pop p LEFT JOIN sm ON p.run_id = sm.run_id AND p.cand_id = sm.cand_id")
def _(spark, sf):
    return spread(search.step_ffa(populations(spark, sf), SPACE, GEN, 0, gamma=0.001))


_C1 = f"(2 * exp(-pow(4 * {GEN}::DOUBLE / {GENS}, 2)))"


def _leader(i):
    reach = f"{_C1} * ({_HI[i] - _LO[i]} * {_step(i, 0)} + {_LO[i]})"
    return _clip(i, f"f{i} + CASE WHEN {_step(i, 1)} >= 0.5::DOUBLE THEN {reach} ELSE -{reach} END")


def _ssa_sql():
    lead = ", ".join(f"first_value(x{i}) OVER (PARTITION BY run_id ORDER BY fitness, cand_id) AS f{i}" for i in range(4))
    return (f"WITH RECURSIVE {_pop_sql()}, led AS (SELECT *, {lead}, row_number() OVER (PARTITION BY run_id ORDER BY cand_id) - 1 AS i, "
            "count(*) OVER (PARTITION BY run_id) AS n FROM pop), "
            "moved AS (SELECT run_id, cand_id, i, n, " + ", ".join(f"CASE WHEN i <= n / 2::DOUBLE THEN {_leader(d)} END AS y{d}" for d in range(4))
            + ", " + ", ".join(f"x{d}" for d in range(4)) + " FROM led), "
            "chain AS (SELECT run_id, cand_id, i, " + ", ".join(f"y{d}" for d in range(4)) + " FROM moved WHERE i = 0 UNION ALL "
            "SELECT m.run_id, m.cand_id, m.i, " + ", ".join(f"CASE WHEN m.i <= m.n / 2::DOUBLE THEN m.y{d} ELSE {_clip(d, f'(c.y{d} + m.x{d}) / 2')} END" for d in range(4))
            + " FROM chain c JOIN moved m ON m.run_id = c.run_id AND m.i = c.i + 1) "
            "SELECT " + _cols({f"x{d}": f"y{d}" for d in range(4)}) + " FROM chain")


@query("search_ssa_step", _ssa_sql())
def _(spark, sf):
    return spread(search.step_ssa(populations(spark, sf), SPACE, GEN, GENS, 0))


def _ga_sql():
    def u(tag, *key):
        return draw_sql(0, GEN, "run_id", *key, f"'{tag}'")

    keep = max(1, int(POP * 0.2))
    gene = f"floor({u('gene', 'cand_id')} * 4)"
    mut = ", ".join(f"CASE WHEN {u('mutate', 'cand_id')} < 0.3::DOUBLE AND {gene} = {i} THEN {_dim(i, u('value', 'cand_id'))} ELSE x{i} END AS x{i}" for i in range(4))
    x = "[" + ", ".join(f"x{i}" for i in range(4)) + "]"
    fresh = "[" + ", ".join(_dim(i, draw_sql(0, GEN, "run_id", "c", f"'fresh{i}'")) for i in range(4)) + "]"
    cu = lambda tag: draw_sql(0, GEN, "run_id", "c", f"'{tag}'")
    return f"""WITH {_pop_sql()}, rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fitness, cand_id) AS rn FROM pop),
 ch AS (SELECT run_id, rn, {mut} FROM rk WHERE rn <= {keep} OR {u('select', 'cand_id')} < 0.05::DOUBLE),
 pa AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY rn) - 1 AS i, {x} AS x, count(*) OVER (PARTITION BY run_id) AS n FROM ch),
 pr AS (SELECT run_id, n, c, floor({cu('male')} * n) AS m, floor({cu('female')} * n) AS f, (1 + floor({cu('cut')} * 3))::INT AS cut
  FROM (SELECT DISTINCT run_id, n FROM pa) z, unnest(range(0, {(POP + 1) // 2 + 1})) AS g(c)),
 mt AS (SELECT pr.*, a.x AS fa, CASE WHEN b.x = a.x THEN {fresh.replace('run_id', 'pr.run_id').replace('(c)', '(pr.c)')} ELSE b.x END AS mo
  FROM pr JOIN pa a ON a.run_id = pr.run_id AND a.i = pr.m JOIN pa b ON b.run_id = pr.run_id AND b.i = pr.f),
 al AS (SELECT run_id, 0 AS kind, i AS o, 0 AS s, x FROM pa UNION ALL
  SELECT run_id, 1, c, 0, list_concat(fa[1:cut], mo[cut + 1:4]) FROM mt UNION ALL SELECT run_id, 1, c, 1, list_concat(mo[1:cut], fa[cut + 1:4]) FROM mt),
 fin AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY kind, o, s) - 1 AS cand_id, x FROM al)
 SELECT run_id, cand_id, {', '.join(f'round(x[{i + 1}], 6) AS x{i}' for i in range(4))} FROM fin WHERE cand_id < {POP}"""


@query("search_ga_step", _ga_sql())
def _(spark, sf):
    return spread(search.step_ga(populations(spark, sf), SPACE, GEN, 0, POP, mutate=0.3))


@query("search_memo", "SELECT DISTINCT p_size::DOUBLE AS x0, floor(p_retailprice / 10)::DOUBLE AS x1 FROM part WHERE (p_size, floor(p_retailprice / 10)) "
       "NOT IN (SELECT s_nationkey, floor(s_acctbal / 10) FROM supplier)")
def _(spark, sf):
    point = lambda a, b: F.array(F.col(a).cast("double"), F.floor(F.col(b) / 10).cast("double")).alias("x")
    pop = table(spark, sf, "part").select(point("p_size", "p_retailprice"))
    history = table(spark, sf, "supplier").select(point("s_nationkey", "s_acctbal"), F.lit(0.0).alias("fitness"))
    return search.unscored(pop, history).select(F.element_at("x", 1).alias("x0"), F.element_at("x", 2).alias("x1"))


@query("search_trace", """WITH h AS (SELECT o_custkey AS run_id, year(o_orderdate)::BIGINT AS gen, o_orderkey AS cand_id, o_totalprice AS fitness FROM orders),
 g AS (SELECT run_id, gen, min(fitness) AS best_fitness, arg_min(cand_id, fitness) AS best_id FROM h GROUP BY ALL)
 SELECT run_id, gen, best_fitness, best_id, min(best_fitness) OVER (PARTITION BY run_id ORDER BY gen) AS best_so_far FROM g""")
def _(spark, sf):
    h = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.year("o_orderdate").cast("bigint").alias("gen"), F.col("o_orderkey").alias("cand_id"),
        F.array("o_orderkey").alias("x"), F.col("o_totalprice").alias("fitness"))
    return search.search_trace(h).select("run_id", "gen", "best_fitness", F.element_at("best_x", 1).alias("best_id"), "best_so_far")


# ---- searches with an objective ---------------------------------------------------------------

def reservoir_objective(train, test, classes, k=5):
    """1 - accuracy of a reservoir classifier per (units, radius, connectivity, scaling); all
    candidates are fitted and scored in the same three passes."""
    def objective(points):
        made = {i: reservoir.Reservoir((reservoir.Layer(
            units=int(p[0]), rho=p[1], leak=0.6, density=p[2], scaling=p[3], noise=0.01, washout=5, seed=0),))
            for i, p in enumerate(points)}
        models = reservoir.fit_reservoirs(train, "vec", "y", "row_id", classes, made, k=k)
        scores = reservoir.score_reservoirs(test, "y", models)
        return [1.0 - scores[i] for i in range(len(points))]
    return objective


@query("search_reservoir")
def _(spark, sf):
    # stored once, spread by id: every generation makes three compute-heavy passes over these rows
    rows = vectors(spark, sf).select("row_id", "vec", "y", "is_test").repartition("row_id")
    train, test = halves(durable(rows))
    _, _, history = search.population_search(spark, SPACE, reservoir_objective(train, test, 10), "pso", 4, 2, seed=1)
    return search.search_trace(history)


# trees, SVM penalty, logistic penalty, logistic steps, neighbours; ranges, swarm and generations as in the searched ensemble
VOTE_SPACE = (search.Dim("int", 100, 499), search.Dim("uniform", 0.1, 7.0), search.Dim("uniform", 0.1, 7.0),
              search.Dim("int", 10, 999), search.Dim("int", 10, 99))
VOTE_POP, VOTE_GENS = 100, 20


def vote_objective(train, test, classes):
    """Log loss of the soft-voting ensemble per parameter set, all sets of a generation together."""
    made = votes.VoteSearch(train, test, "vec", "y", "row_id", classes)

    def setting(p):
        return votes.Setting(max(p[1], 1e-6), max(1, int(p[0])), max(p[2], 1e-3), max(1, int(p[3])), max(1, int(p[4])))

    return lambda points: made.losses([setting(p) for p in points])


@query("search_vote")
def _(spark, sf):
    """The whole swarm. Its particles keep no velocity, so nothing carries them ever further out."""
    train, test = halves(durable(vectors(spark, sf, classes=2)))
    _, _, history = search.population_search(spark, VOTE_SPACE, vote_objective(train, test, 2), "pso2", VOTE_POP, VOTE_GENS, seed=1,
                                             whole=[True, False, True, True, True], redraw=[False] * 4 + [True], w=0.0)
    return search.search_trace(history)
