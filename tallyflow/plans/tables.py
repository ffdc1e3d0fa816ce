"""Sources, projections, sampling, splits, combinations, counts and preparation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import (
    argmax, clip, draw, reverse_sequence, round_gt_half, round_half_even, space_transform,
)
from tallyflow.operators import combine, evaluate, prepare, project, sampling
from tallyflow.plans.registry import draw_sql, hash60_sql, md5_sql, query, r6, table
from tallyflow.sources import profile, read_flows, work_path

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRIORITY_SHARES = {"1-URGENT": 0.01, "2-HIGH": 0.1, "3-MEDIUM": 0.5, "5-LOW": 1.0}
LANG_SHARES = {"en": 0.006, "de": 0.2, "fr": 0.5}
TEST_SHARES = {"1-URGENT": 0.5, "2-HIGH": 0.5, "3-MEDIUM": 0.5, "4-NOT SPECIFIED": 0.5, "5-LOW": 0.2}


def _case(col: str, shares: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{c}' THEN {f}::DOUBLE" for c, f in shares.items()) + " END"


@query("csv_roundtrip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = work_path(spark, "orders-csv")
    df.write.csv(path, header=True)
    return read_flows(spark, path, schema=df.schema)


@query("csv_named_scan", "SELECT l_quantity AS q, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, "
       "l_returnflag AS class FROM lineitem")
def _(spark, sf):
    path = work_path(spark, "lineitem-csv")
    table(spark, sf, "lineitem").select(*LINE, "l_returnflag").write.csv(path, header=False)
    return read_flows(spark, path, names=["q", "price", "discount", "tax", "class"])


_PROFILE = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("profile_table", " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS position, '{c}' AS column_name, '{t}' AS data_type, count({c})::BIGINT AS n_values, "
    f"min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM orders" for i, (c, t) in enumerate(_PROFILE)))
def _(spark, sf):
    return profile(table(spark, sf, "orders"))


@query("numeric_select", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
       "FROM lineitem")
def _(spark, sf):
    return project.select_numeric(table(spark, sf, "lineitem"))


@query("positional_select", "SELECT p_partkey, p_type, p_size FROM part")
def _(spark, sf):
    without_last = project.select_positions(table(spark, sf, "part"), slice(None, -1))
    return project.select_positions(without_last, [0, -2, -1])


@query("label_filter", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders "
       "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return project.filter_label(df, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("to_sequence", "SELECT l_returnflag, 4::BIGINT AS steps, l_quantity AS s0, l_extendedprice AS s1, "
       "l_discount AS s2, l_tax AS s3 FROM lineitem")
def _(spark, sf):
    seq = project.to_sequence(table(spark, sf, "lineitem"), LINE, "seq")
    return seq.select("l_returnflag", F.size("seq").cast("bigint").alias("steps"),
                      *[F.element_at("seq", i + 1).alias(f"s{i}") for i in range(4)])


@query("argmax_row", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax("embedding").cast("bigint").alias("best"))


@query("round_half_even", "SELECT o_orderkey, round_even(o_custkey / 2::DOUBLE, 0)::BIGINT AS code FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", round_half_even(F.col("o_custkey") / 2.0).cast("bigint").alias("code"))


@query("round_gt_half", "SELECT event_id, (CASE WHEN value * 0.5::DOUBLE - trunc(value * 0.5::DOUBLE) > 0.5::DOUBLE "
       "THEN trunc(value * 0.5::DOUBLE) + 1 ELSE trunc(value * 0.5::DOUBLE) END)::BIGINT AS code FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", round_gt_half(F.col("value") * 0.5).cast("bigint").alias("code"))


@query("reverse_sequence", "SELECT vec_id, (65 - i)::BIGINT AS step, round(embedding[i]::DOUBLE, 6) AS v "
       "FROM embeddings, unnest(range(1, 65)) AS g(i)")
def _(spark, sf):
    rev = table(spark, sf, "embeddings").select("vec_id", reverse_sequence("embedding").alias("seq"))
    steps = rev.select("vec_id", F.posexplode("seq").alias("pos", "x"))
    return steps.select("vec_id", (F.col("pos") + 1).cast("bigint").alias("step"), r6(F.col("x").cast("double"), "v"))


@query("clip_bounds", "SELECT event_id, greatest(10::DOUBLE, least(100::DOUBLE, value)) AS clipped FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", clip("value", 10, 100).alias("clipped"))


_U = draw_sql("'space'", "o_orderkey")


@query("space_transforms", f"SELECT o_orderkey, trunc(5 + 45 * {_U})::BIGINT AS choice, round(0.1::DOUBLE + 6.9::DOUBLE * {_U}, 6) "
       f"AS uniform, round(pow(10::DOUBLE, -3 + 4 * {_U}), 6) AS log_uniform FROM orders")
def _(spark, sf):
    u = draw("space", F.col("o_orderkey"))
    return table(spark, sf, "orders").select(
        "o_orderkey", space_transform(5.0 + 45.0 * u, "choice").cast("bigint").alias("choice"),
        r6(space_transform(0.1 + 6.9 * u, "uniform"), "uniform"),
        r6(space_transform(-3.0 + 4.0 * u, "log_uniform"), "log_uniform"))


@query("scalar_math", "SELECT event_id, ceil(value)::BIGINT AS up, abs(value - 50) AS gap, round(tanh(value / 100::DOUBLE), 6) AS th, "
       "round(exp(-value / 100::DOUBLE), 6) AS ex, round(sqrt(value), 6) AS root, round(value * value, 6) AS sq FROM events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.ceil(v).cast("bigint").alias("up"), F.abs(v - 50).alias("gap"), r6(F.tanh(v / 100.0), "th"),
        r6(F.exp(-v / 100.0), "ex"), r6(F.sqrt(v), "root"), r6(F.pow(v, F.lit(2)), "sq"))


def _head_sql(tbl, key, label, shares, cols):
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {key}) AS rn, "
            f"count(*) OVER (PARTITION BY {label}) AS n, {_case(label, shares)} AS f FROM {tbl}) "
            "WHERE f IS NOT NULL AND rn <= floor(n * f)")


@query("rebalance_head", _head_sql("orders", "o_orderkey", "o_orderpriority", PRIORITY_SHARES,
                                   "o_orderkey, o_orderpriority, o_totalprice"))
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return sampling.rebalance_head(df, "o_orderpriority", PRIORITY_SHARES, ["o_orderkey"])


@query("rebalance_head_skewed", _head_sql("documents", "n_chars, doc_id", "lang", LANG_SHARES, "doc_id, lang, n_chars"))
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.rebalance_head(df, "lang", LANG_SHARES, ["n_chars", "doc_id"])


@query("holdout_head", "SELECT o_orderkey, o_orderpriority, rn <= floor(n * f) AS is_test FROM (SELECT *, row_number() OVER "
       "(PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n, "
       f"{_case('o_orderpriority', TEST_SHARES)} AS f FROM orders)")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    train, test = sampling.holdout_head(df, "o_orderpriority", TEST_SHARES, ["o_orderkey"])
    return combine.union_slices([train.withColumn("is_test", F.lit(False)), test.withColumn("is_test", F.lit(True))])


@query("sample_by_class", "SELECT o_orderkey, o_orderpriority FROM orders WHERE "
       f"{draw_sql(chr(39) + '11' + chr(39), 'o_orderkey')} < {_case('o_orderpriority', PRIORITY_SHARES)}")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.sample_by_class(df, "o_orderpriority", PRIORITY_SHARES, 11, "o_orderkey")


@query("sample_n", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash60_sql(5, 'o_orderkey')}, o_orderkey LIMIT 2000")
def _(spark, sf):
    return sampling.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 2000, 5, "o_orderkey")


@query("shuffle_rows", f"SELECT event_id, event_type FROM events ORDER BY {hash60_sql(3, 'event_id')}, event_id")
def _(spark, sf):
    return sampling.shuffle_rows(table(spark, sf, "events").select("event_id", "event_type"), 3, "event_id")


@query("split_hash", f"SELECT o_orderkey, o_orderpriority, substr({md5_sql(0, 'o_orderkey')}, 1, 8) < '80000000' AS is_test FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.split_hash(df, "o_orderkey", 0.5, 0)


@query("split_ordered", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) > "
       "floor((SELECT count(*) FROM events) * 0.8::DOUBLE) AS is_test FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return sampling.split_ordered(df, ["ts", "event_id"], 0.8).drop("ts")


@query("stratified_folds", "SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY "
       f"{md5_sql(7, 'o_orderkey')}, o_orderkey) - 1) % 10)::BIGINT AS fold FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_folds(df, "o_orderpriority", 10, 7, "o_orderkey").withColumn("fold", F.col("fold").cast("bigint"))


@query("contiguous_folds", "SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS fold FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return sampling.contiguous_folds(df, ["o_orderkey"], 7).withColumn("fold", F.col("fold").cast("bigint"))


@query("union_slices", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL "
       "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return combine.union_slices([project.filter_label(df, "o_orderstatus", [v]) for v in ("F", "O")])


@query("align_columns", "SELECT o.doc_id, n_chars, lang, quality, toxic FROM documents o JOIN labels l ON o.doc_id = l.doc_id")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return combine.align_columns(docs, table(spark, sf, "labels"), "doc_id")


@query("anti_index", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return combine.anti_rows(docs, table(spark, sf, "labels"), "doc_id")


_TEST = f"(substr({md5_sql(0, 'o_orderkey')}, 1, 8) < '80000000')"


@query("class_distribution", f"SELECT o_orderpriority, count(*) FILTER (NOT {_TEST})::BIGINT AS n_train, "
       f"count(*) FILTER ({_TEST})::BIGINT AS n_test FROM orders GROUP BY 1")
def class_distribution(spark, sf):
    split = sampling.split_hash(table(spark, sf, "orders"), "o_orderkey", 0.5, 0)
    return combine.class_distribution(split, "o_orderpriority", "is_test")


@query("outer_counts", "SELECT coalesce(a.s, b.s) AS status, coalesce(a.n, 0)::BIGINT AS n_train, coalesce(b.n, 0)::BIGINT AS n_test FROM "
       "(SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN "
       "(SELECT l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1) b ON a.s = b.s")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))
    b = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"))
    return combine.outer_counts(a, b, "status")


@query("label_sizes", "SELECT l_returnflag, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY 1")
def _(spark, sf):
    return combine.label_sizes(table(spark, sf, "lineitem"), "l_returnflag")


@query("label_map", "SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code FROM "
       "(SELECT DISTINCT c_mktsegment FROM customer)")
def _(spark, sf):
    return prepare.label_map(table(spark, sf, "customer"), "c_mktsegment").withColumn("code", F.col("code").cast("bigint"))


_SCALED = ", ".join(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE ({c} - min({c}) OVER ()) / "
                    f"(max({c}) OVER () - min({c}) OVER ()) END, 6) AS {c}" for c in LINE)


@query("minmax_scale", f"SELECT l_returnflag, {_SCALED} FROM lineitem")
def _(spark, sf):
    scaled = prepare.minmax_scale(table(spark, sf, "lineitem").select("l_returnflag", *LINE), LINE)
    return scaled.select("l_returnflag", *[r6(c, c) for c in LINE])


@query("label_encode", "SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS y FROM orders")
def _(spark, sf):
    return prepare.label_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("one_hot", "SELECT vec_id, " + ", ".join(f"(label = {i})::INT::DOUBLE AS c{i}" for i in range(10)) + " FROM embeddings")
def _(spark, sf):
    hot = prepare.one_hot(table(spark, sf, "embeddings"), "label", 10)
    return hot.select("vec_id", *[F.element_at("onehot", i + 1).alias(f"c{i}") for i in range(10)])


# ---- evaluation of a fixed rule ---------------------------------------------------------------

_RULE = "CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 330000 THEN 'O' ELSE 'P' END"


def _judged(spark, sf):
    price = F.col("o_totalprice")
    rule = F.when(price < 150000, "F").when(price < 330000, "O").otherwise("P")
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"), rule.alias("p"))


@query("accuracy", f"SELECT count(*) FILTER (o_orderstatus = {_RULE})::BIGINT AS n_correct, count(*)::BIGINT AS n_rows, "
       f"round(count(*) FILTER (o_orderstatus = {_RULE}) / count(*)::DOUBLE, 6) AS accuracy FROM orders")
def _(spark, sf):
    return evaluate.accuracy(_judged(spark, sf), "y", "p").withColumn("accuracy", F.round("accuracy", 6))


_YP = f"WITH j AS (SELECT o_orderstatus AS y, {_RULE} AS p FROM orders), k AS (SELECT y AS c FROM j UNION SELECT p FROM j) "


@query("confusion_matrix", _YP + "SELECT a.c AS truth, b.c AS predicted, (SELECT count(*) FROM j WHERE j.y = a.c AND j.p = b.c)"
       "::BIGINT AS n FROM k a CROSS JOIN k b")
def _(spark, sf):
    return evaluate.confusion_matrix(_judged(spark, sf), "y", "p")


@query("classification_report", _YP + """, s AS (SELECT c, (SELECT count(*) FROM j WHERE y = c) AS support,
  (SELECT count(*) FROM j WHERE p = c) AS claimed, (SELECT count(*) FROM j WHERE y = c AND p = c) AS hit FROM k),
 r AS (SELECT c, support, hit, CASE WHEN claimed > 0 THEN hit / claimed::DOUBLE ELSE 0 END AS pr,
  CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS rc FROM s),
 q AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM r)
 SELECT c AS class, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM q
 UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM q
 UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f), 6), sum(support)::BIGINT FROM q
 UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM q""")
def _(spark, sf):
    rep = evaluate.classification_report(_judged(spark, sf), "y", "p")
    return rep.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("log_loss", """WITH a AS (SELECT label, list_transform(embedding, lambda v: exp(2 * v::DOUBLE)) AS e FROM embeddings),
 b AS (SELECT e[label + 1] / list_sum(e) AS p FROM a)
 SELECT round(-avg(ln(greatest(1e-15::DOUBLE, least((1 - 1e-15)::DOUBLE, p)))), 6) AS log_loss FROM b""")
def _(spark, sf):
    e = F.transform("embedding", lambda v: F.exp(2.0 * v.cast("double")))
    df = table(spark, sf, "embeddings").select("label", e.alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    scored = df.withColumn("probability", F.transform("e", lambda v: v / total))
    return evaluate.log_loss(scored, "label", "probability").select(r6("log_loss", "log_loss"))


_DOC = "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return combine.align_columns(table(spark, sf, "labels"), docs, "doc_id")


@query("binary_log_loss", "SELECT round(-avg(CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM "
       f"(SELECT quality, n_chars / (n_chars + 1000)::DOUBLE AS p {_DOC})")
def _(spark, sf):
    df = _documents(spark, sf).withColumn("p", F.col("n_chars") / (F.col("n_chars") + 1000))
    return evaluate.binary_log_loss(df, "quality", "p").select(r6("log_loss", "log_loss"))


@query("binary_metrics", f"""WITH s AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 600) AS tp,
 count(*) FILTER (quality <> 1 AND n_chars > 600) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 600) AS fn,
 count(*) FILTER (quality <> 1 AND n_chars <= 600) AS tn {_DOC})
 SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
 round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1,
 round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM s""")
def _(spark, sf):
    df = _documents(spark, sf).withColumn("p", (F.col("n_chars") > 600).cast("int"))
    m = evaluate.binary_metrics(df, "quality", "p")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("roc_curve", f"""WITH s AS (SELECT n_chars AS threshold, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg
 {_DOC} GROUP BY 1), c AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
 FROM s WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
 SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round((tp / p)::DOUBLE, 6) AS tpr, round((fp / n)::DOUBLE, 6) AS fpr FROM c""")
def _(spark, sf):
    roc = evaluate.roc_curve(_documents(spark, sf), "quality", "n_chars")
    return roc.select("threshold", "tp", "fp", r6("tpr", "tpr"), r6("fpr", "fpr"))


@query("roc_auc", f"""WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2::DOUBLE AS rk {_DOC}),
 a AS (SELECT sum(rk) FILTER (quality = 1) AS s, count(*) FILTER (quality = 1)::DOUBLE AS p, count(*) FILTER (quality <> 1)::DOUBLE AS n FROM r)
 SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc FROM a""")
def _(spark, sf):
    return evaluate.roc_auc(_documents(spark, sf), "quality", "n_chars").select(r6("auc", "auc"))


@query("rmse", "SELECT round(sqrt(avg(pow(value - user_id / 2::DOUBLE, 2))), 6) AS rmse FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("hat", F.col("user_id") / 2.0)
    return evaluate.rmse(df, "value", "hat").select(r6("rmse", "rmse"))


@query("sorted_predictions", "SELECT event_id, value, event_type FROM events ORDER BY value DESC, event_id")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "event_type")
    return evaluate.sorted_predictions(df, "value", "event_id")
