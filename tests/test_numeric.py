import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.operators import classifiers, linear, neighbours, networks, noise, reservoir, series, sums
from tallyflow.streaming import continue_stream


def frame(spark, x, y=None, name="v"):
    y = np.zeros(len(x)) if y is None else y
    return spark.createDataFrame([(i, [float(t) for t in r], float(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 f"id long, {name} array<double>, y double")


def brute(q, t, k):
    d = np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    order = np.lexsort((np.broadcast_to(np.arange(len(t)), d.shape), d), axis=1)[:, :k]
    return {(i, int(j)): d[i, j] for i in range(len(q)) for j in order[i]}


@pytest.mark.parametrize("broadcast_bytes,piece", [(1 << 26, 20_000), (0, 50), (0, 7)])
def test_neighbours_are_exact_on_every_path(spark, broadcast_bytes, piece):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(400, 5))
    t[:150] = t[0] + rng.normal(size=(150, 5)) * 1e-3       # a crowded place
    t[10] = t[11]                                           # an exact tie
    q = np.vstack([rng.normal(size=(60, 5)), t[:30]])
    got = neighbours.knn_join(frame(spark, q), frame(spark, t), "v", "id", "id", 4, broadcast_bytes, piece).collect()
    want = brute(q, t, 4)
    assert {(r["query_id"], r["train_id"]) for r in got} == set(want)
    assert all(abs(r["distance"] - want[(r["query_id"], r["train_id"])]) < 1e-12 for r in got)


def test_rounds_rule_out_most_pieces(spark):
    rng = np.random.default_rng(11)
    t = np.concatenate([rng.normal(size=(60, 3)) * 0.1 + 10 * c for c in rng.normal(size=(20, 3))])
    t[:300] = t[0]                                          # a fifth of the rows is one point
    q = t[::25] + 0.01
    trace = []
    got = neighbours.knn_join(frame(spark, q), frame(spark, t), "v", "id", "id", 3, 0, 40, trace=trace).collect()
    want = brute(q, t, 3)
    assert {(r["query_id"], r["train_id"]) for r in got} == set(want)
    pieces = len(t) / 40
    assert len(trace) > 1 and sum(trace) < 0.35 * len(q) * pieces


def test_vectors_move_once_per_group_of_pieces(spark, monkeypatch):
    """Pairs of blocks and pieces reach the comparisons as numbers, a block's vectors once per group it meets."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))                          # no structure: every block meets every piece
    met = []
    compared = neighbours._compared

    def counted(visits, blocks, pieces, k):
        met.append(visits.agg(F.count(F.lit(1)), F.sum(F.size("pieces")), F.countDistinct("block"), F.countDistinct("pile")).first())
        return compared(visits, blocks, pieces, k)

    monkeypatch.setattr(neighbours, "_compared", counted)
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 1 << 14)
    got = neighbours.knn_join(frame(spark, x), frame(spark, x), "v", "id", "id", 3, 0, 10).collect()
    assert {(r["query_id"], r["train_id"]) for r in got} == set(brute(x, x, 3))
    rows, pairs, blocks, groups = met[-1]
    assert rows <= blocks * groups and pairs > 3 * rows


def test_buckets_shared_by_all_write_no_row_per_pair(spark):
    """Rows of one bucket: both paths give the exact neighbours within the radius, repeated rows once."""
    rng = np.random.default_rng(6)
    t, q = 50 + rng.normal(size=(300, 6)) * 0.3, 50 + rng.normal(size=(40, 6)) * 0.3
    t[7] = t[8]
    train = frame(spark, t, rng.integers(0, 3, 300))
    train = train.unionByName(train.filter("id < 50"))
    test = frame(spark, q)
    want = {p for p, d in brute(q, t, 5).items() if d < 0.6}
    assert 0 < len(want) < 200
    for limit in (1 << 26, 0):
        pairs = neighbours._lsh_pairs(train, test, "v", "y", "id", 5, 0.6, bucket=1000.0, broadcast_bytes=limit)
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = pairs.collect()
        assert len(got) == len(want) and {(r["query_id"], r["train_id"]) for r in got} == want


def test_fewer_train_rows_than_neighbours(spark):
    x = np.random.default_rng(0).normal(size=(3, 2))
    for limit in (1 << 26, 0):
        assert neighbours.knn_join(frame(spark, x), frame(spark, x), "v", "id", "id", 5, limit).count() == 9


def test_vote_ties_go_to_the_smallest_class(spark):
    train = frame(spark, [[0.0], [1.0], [2.0], [3.0]], [2, 2, 1, 1])
    got = neighbours.knn_classify(train, frame(spark, [[1.5]]), "v", "y", "id", 4).first()
    assert got["prediction"] == 1 and got["votes"] == 2


def test_ridge_and_components_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 6)) + 5, rng.integers(0, 3, 200)
    df = frame(spark, x, y).repartition(5)
    m = linear.ridge_classifier(df, "v", "y", 3, 2.0)
    t = np.eye(3)[y]
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(6), xc.T @ (t - t.mean(0)))
    assert np.allclose(m.weights, w) and np.allclose(m.bias, t.mean(0) - x.mean(0) @ w)
    p = linear.pca_fit(df, "v", 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(p.variance, values[::-1][:2])
    assert np.allclose(np.abs(np.sum(p.components * vectors[:, ::-1][:, :2], axis=0)), 1)
    z = np.array([r["projected"] for r in linear.pca_project(df, p).orderBy("id").collect()])
    assert np.allclose(z.mean(0), 0) and np.allclose(z, (x - x.mean(0)) @ p.components)


def test_discriminant_ignores_a_class_without_rows(spark):
    rng = np.random.default_rng(5)
    y = np.repeat([0, 2], 60)
    x = rng.normal(size=(120, 3)) * 0.2 + y[:, None]
    out = linear.discriminant_fit(frame(spark, x, y), "v", "y", 3).transform(frame(spark, x, y)).collect()
    assert all(r["prediction"] == r["y"] and abs(sum(r["probability"]) - 1) < 1e-9 for r in out)


def test_reservoir_recursion_by_hand():
    ring = reservoir.reservoir_weights(3, 0.8, ring=True)
    assert ring[1, 0] == ring[2, 1] == ring[0, 2] == 0.8 and np.count_nonzero(ring) == 3
    dense = reservoir.reservoir_weights(40, 0.6, 0.25, seed=1)
    assert np.isclose(np.abs(np.linalg.eigvals(dense)).max(), 0.6) and np.count_nonzero(dense) == 400
    assert set(np.abs(reservoir.input_weights(9, 2, 0.3)).ravel()) == {0.3}
    layer = reservoir.Layer(units=3, rho=0.8, leak=0.4, scaling=0.5, noise=0.0, ring=True, washout=1, seed=2)
    r = reservoir.Reservoir((layer,))
    x = np.array([[0.1, -0.2, 0.3]])
    w, w_in = r.weights[0]

    def by_hand(seq):
        s, out = np.zeros(3), []
        for v in seq:
            s = 0.6 * s + np.tanh(w @ s + w_in[:, 0] * v)
            out.append(s)
        return np.array(out[1:])

    got = r.states(x, np.array([0]))[0]
    assert np.allclose(got, np.hstack([by_hand(x[0]), by_hand(x[0][::-1])]))


def test_state_noise_depends_on_keys_only():
    a = noise.keyed_uniform(np.array([5, 6, 7]), 3, 8, 1)
    assert np.array_equal(a[1:], noise.keyed_uniform(np.array([6, 7]), 3, 8, 1))
    big = noise.keyed_uniform(np.arange(20_000), 0, 4, 0)
    assert 0 <= big.min() and big.max() < 1 and abs(big.mean() - 0.5) < 0.01


def test_next_state_ridge_against_normal_equations():
    rng = np.random.default_rng(6)
    h = rng.normal(size=(2, 12, 3))
    got = reservoir.next_state_ridge(h, 10.0)
    for i in range(2):
        x, y = h[i, :-1], h[i, 1:]
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ (y - y.mean(0)))
        assert np.allclose(got[i], np.concatenate([w.T.ravel(), y.mean(0) - x.mean(0) @ w]))


def test_reservoir_classifier_tells_shapes_apart(spark):
    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 20)
    rows = [np.sin(2 * np.pi * (2 + 3 * c) * t + rng.uniform(0, 6)) + rng.normal(size=20) * 0.05 for c in (0, 1) for _ in range(60)]
    df = frame(spark, np.array(rows), np.repeat([0, 1], 60)).repartition(4)
    layer = reservoir.Layer(units=20, rho=0.9, leak=None, scaling=0.5, noise=0.001, seed=1)
    model = reservoir.fit_reservoir(df, "v", "y", "id", 2, reservoir.Reservoir((layer,)), k=6, alpha=1.0)
    assert model.transform(df).filter("prediction = y").count() > 110
    assert reservoir.score_reservoirs(df, "y", {0: model})[0] > 110 / 120
    with pytest.raises(ValueError):
        reservoir.fit_reservoir(df, "v", "y", "id", 2, reservoir.Reservoir((layer,)), k=6, method="other")


def test_readout_without_a_matrix_equals_the_direct_one(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.normal(size=(60, 24)), np.arange(60) % 3).repartition(3)
    made = {i: reservoir.Reservoir((reservoir.Layer(units=12 + i, rho=0.8, leak=0.5, scaling=0.4, noise=0.001, seed=i),)) for i in (0, 4)}
    for code in (False, True):
        models = [reservoir.fit_reservoirs(df, "v", "y", "id", 3, made, k=20, alpha=1.0, code_target=code, method=m) for m in ("direct", "free")]
        for i in made:
            assert np.allclose(models[0][i].weights, models[1][i].weights, atol=1e-7) and np.allclose(models[0][i].bias, models[1][i].bias, atol=1e-7)


def test_readout_without_a_matrix_takes_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(21)
    turn = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    x = (rng.normal(size=(300, 120)) * np.logspace(2, -4, 120)) @ turn  # the spread of directions falls over six powers of ten
    df = frame(spark, x, np.arange(300) % 3).repartition(3)
    codes = lambda y: (np.asarray(y)[:, None] == np.arange(3)).astype(float)
    passes, summed = [], linear.matrix_sums
    monkeypatch.setattr(linear, "matrix_sums", lambda *a: passes.append(1) or summed(*a))
    w, b = linear.ridge_free(df, lambda batch: {0: sums.matrix_of(batch, "v")}, lambda batch: codes(sums.vector_of(batch, "y")), 1.0)[0]
    t, c = codes(np.arange(300) % 3), x - x.mean(0)
    exact = np.linalg.solve(c.T @ c + np.eye(120), c.T @ (t - t.mean(0)))
    assert np.allclose(x @ w + b, c @ exact + t.mean(0), atol=1e-5)
    assert len(passes) <= 40


def test_readout_without_a_matrix_of_constant_features(spark):
    df = frame(spark, np.ones((12, 6)), np.arange(12) % 2)
    w, b = linear.ridge_free(df, lambda batch: {0: sums.matrix_of(batch, "v")}, lambda batch: sums.vector_of(batch, "y")[:, None], 1.0)[0]
    assert not w.any() and np.allclose(b, 0.5)


@pytest.mark.parametrize("units,k", [(50, 75), (250, 100)])
def test_wide_embeddings(spark, units, k):
    rng = np.random.default_rng(9)
    df = frame(spark, rng.normal(size=(12, 64)), np.arange(12) % 2)
    r = reservoir.Reservoir((reservoir.Layer(units=units, rho=0.6, leak=0.6, density=0.1, scaling=0.1, noise=0.01, washout=5),))
    model = reservoir.fit_reservoir(df, "v", "y", "id", 2, r, k=k)
    x, ids = np.array([row["v"] for row in df.collect()]), np.arange(12)
    e = model.embedder.embed(x, ids)
    assert e.shape == (12, k * k + k)
    t, c = (np.arange(12)[:, None] % 2 == np.arange(2)).astype(float), e - e.mean(0)
    w = c.T @ np.linalg.solve(c @ c.T + 5 * np.eye(12), t - t.mean(0))
    assert np.allclose(model.weights, w, atol=1e-7)
    wide = model.embedder.transform(df, "v", "id").orderBy("id").collect()
    assert np.allclose([row["embedding"] for row in wide], e)


def test_ridge_over_steps_equals_ridge_over_components():
    h = np.random.default_rng(10).normal(size=(3, 9, 14))
    got = reservoir.next_state_ridge(h, 2.0)
    for i in range(3):
        x, y = h[i, :-1], h[i, 1:]
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + 2 * np.eye(14), xc.T @ (y - y.mean(0)))
        assert np.allclose(got[i], np.concatenate([w.T.ravel(), y.mean(0) - x.mean(0) @ w]))


SPEC = series.SeriesSpec(inputs=1, outputs=1, units=12, rho=0.7, noise=0.0, input_scaling=0.5, input_shift=0.1,
                         teacher_scaling=0.8, teacher_shift=-0.1, seed=5)


@pytest.fixture(scope="module")
def waves(spark):
    """One long series and two short ones, delivered shuffled."""
    rows = [(s, float(t), [float(np.sin(t / 5))], [float(np.cos(t / 5 + s))]) for s, n in ((1, 300), (2, 20), (3, 5)) for t in range(n)]
    order = np.random.default_rng(8).permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "s long, t double, x array<double>, y array<double>").repartition(5)


def one_series(spec, x, y):
    w, w_in, w_fb = spec.weights()
    xs, ys = x * spec.input_scaling + spec.input_shift, y * spec.teacher_scaling + spec.teacher_shift
    s = np.zeros((len(x), spec.units))
    for n in range(1, len(x)):
        s[n] = np.tanh(w @ s[n - 1] + w_in @ xs[n] + w_fb @ ys[n - 1])
    return np.hstack([s, xs]), ys, s[-1], ys[-1]


@pytest.mark.parametrize("segment", [10_000, 40])
def test_series_regression_equals_the_sequential_run(spark, waves, segment):
    model = series.series_reservoir_fit(waves, "s", "t", "x", "y", SPEC, rows_per_segment=segment)
    data = {s: sorted((r["t"], r["x"], r["y"]) for r in waves.filter(F.col("s") == s).collect()) for s in (1, 2, 3)}
    parts = {s: one_series(SPEC, np.array([r[1] for r in d]), np.array([r[2] for r in d])) for s, d in data.items()}
    ext, target = np.vstack([p[0] for p in parts.values()]), np.vstack([p[1] for p in parts.values()])
    fit = ext @ (np.linalg.pinv(ext) @ target)
    want = dict(zip([(s, r[0]) for s, d in data.items() for r in d], (fit[:, 0] + 0.1) / 0.8))
    got = {(r["series_id"], r["t"]): r["y_hat"][0] for r in model.fitted().collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-5
    last = {r["series_id"]: np.array(r["state"]) for r in model.last.collect()}
    assert all(np.allclose(last[s], parts[s][2], atol=1e-10) for s in parts)


@pytest.mark.parametrize("rho,segment,waits", [(0.3, 60, False), (0.99, 50, True)])
def test_no_segment_runs_more_than_twice(waves, rho, segment, waits):
    spec = series.SeriesSpec(inputs=1, outputs=1, units=12, rho=rho, noise=0.0, input_scaling=0.05, teacher_scaling=0.05, seed=5)
    whole, runs = series.series_reservoir_fit(waves, "s", "t", "x", "y", spec), []
    cut = series.series_reservoir_fit(waves, "s", "t", "x", "y", spec, rows_per_segment=segment, trace=runs)
    segments = cut.segments.count()
    assert segments > 6 and sum(runs) <= 2 * segments
    assert (runs[2:] == [1] * 5) == waits
    a, b = ({r["series_id"]: r["state"] for r in m.last.collect()} for m in (whole, cut))
    assert all(np.allclose(a[s], b[s], atol=1e-10) for s in (1, 2, 3))


def test_noise_does_not_depend_on_the_segments(waves):
    noisy = series.SeriesSpec(units=12, rho=0.7, noise=0.1, seed=5)
    runs = []
    for segment in (10_000, 40):
        model = series.series_reservoir_fit(waves, "s", "t", "x", "y", noisy, rows_per_segment=segment)
        runs.append({r["series_id"]: r["state"] for r in model.last.collect()})
    assert all(np.allclose(runs[0][s], runs[1][s], atol=1e-10) for s in (1, 2, 3))


def free_run(model, start, xs):
    w, w_in, w_fb = SPEC.weights()
    s, prev = start
    out = []
    for v in xs:
        u = np.array([v]) * SPEC.input_scaling + SPEC.input_shift
        s = np.tanh(w @ s + w_in @ u + w_fb @ prev)
        prev = np.concatenate([s, u]) @ model.readout
        out.append(((prev - SPEC.teacher_shift) / SPEC.teacher_scaling)[0])
    return out


def test_continuation_in_batch_and_stream(spark, waves, tmp_path):
    model = series.series_reservoir_fit(waves, "s", "t", "x", "y", SPEC)
    rows = [(s, float(t), [float(np.sin(t / 5))]) for s, a in ((1, 300), (2, 20), (9, 0)) for t in range(a, a + 30)]
    new = spark.createDataFrame(rows, "s long, t double, x array<double>")
    start = {r["series_id"]: (np.array(r["state"]), np.array(r["prev_y"])) for r in model.last.collect()}
    want = {}
    for s, a in ((1, 300), (2, 20), (9, 0)):
        ts = range(a, a + 30)
        run = free_run(model, start.get(s, (np.zeros(12), np.zeros(1))), [np.sin(t / 5) for t in ts])
        want.update({(s, float(t)): v for t, v in zip(ts, run)})
    for segment in (10_000, 8):
        got = {(r["series_id"], r["t"]): r["y_hat"][0]
               for r in series.series_continue(model, new, "s", "t", "x", rows_per_segment=segment).collect()}
        assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-8
    src = str(tmp_path / "in")
    for lo, hi in ((0, 10), (10, 30)):
        part = new.filter(F.col("t") - F.when(F.col("s") == 1, 300).when(F.col("s") == 2, 20).otherwise(0) >= lo) \
            .filter(F.col("t") - F.when(F.col("s") == 1, 300).when(F.col("s") == 2, 20).otherwise(0) < hi)
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = continue_stream(model, stream, "s", "t", "x").writeStream.outputMode("append").format("memory") \
        .option("checkpointLocation", str(tmp_path / "cp")).queryName("continued").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["series_id"], r["t"]): r["y_hat"][0] for r in spark.table("continued").collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_boltzmann_step_against_numpy(spark):
    rng = np.random.default_rng(9)
    v = rng.uniform(size=(40, 5))
    model = networks.rbm_fit(frame(spark, v).repartition(3), "v", "id", hidden=4, lr=0.5, iters=2, seed=1)
    sig = lambda z: 1 / (1 + np.exp(-z))
    w, a, b = np.random.default_rng(1).normal(0, 0.01, (5, 4)), np.zeros(5), np.zeros(4)
    for it in range(2):
        h = sig(v @ w + b)
        on = noise.keyed_uniform(np.arange(40), it, 4, 1) < h
        v2 = sig(on @ w.T + a)
        h2 = sig(v2 @ w + b)
        w, a, b = w + 0.5 * (v.T @ h - v2.T @ h2) / 40, a + 0.5 * (v - v2).mean(0), b + 0.5 * (h - h2).mean(0)
    assert np.allclose(model.weights, w) and np.allclose(model.hidden, b) and np.allclose(model.visible, a)


def test_convolution_column_equals_batch_form(spark):
    x = np.random.default_rng(10).normal(size=(6, 11))
    df = frame(spark, x)
    kernels = [(np.array([0.5, -1.0, 0.25])[:, None, None], np.array([0.01]))]
    bank = networks.conv_bank(df, "v", kernels).withColumn("c", networks.conv_features("v", [([0.5, -1.0, 0.25], 0.01)]))
    for r in bank.collect():
        assert np.allclose(r["maps"], r["c"]) and len(r["c"]) == 4
    two = networks.conv_bank(df, "v", networks.random_kernels([3, 2]))
    assert len(two.first()["maps"]) == 2 * 1


def test_series_are_run_in_bounded_parts(monkeypatch):
    """A part of a batch holds no more states than allowed, keeps long segments apart from short ones and makes no object per row."""
    rng = np.random.default_rng(11)
    spec = series.SeriesSpec(units=12)
    sizes = [3, 400, 1, 399] + [5] * 200
    rows = [[{"t": float(i), "x": [rng.normal()], "y": [rng.normal()]} for i in range(n)] for n in sizes]
    kind = pa.list_(pa.struct([("t", pa.float64()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(rows, kind)], names=["series_id", "rows"])
    monkeypatch.setattr(series, "_STATE_BYTES", 50_000)
    seen = {}
    for part in series._slices(batch, spec):
        x, y, n, times = series._unpack(part.column("rows"), spec, True)
        assert len(x) == 1 or x.shape[0] * x.shape[1] * 8 * 16 <= 50_000
        for i, s in enumerate(part.column("series_id").to_pylist()):
            seen[s] = x[i, :n[i], 0].tolist(), y[i, :n[i], 0].tolist(), times[i, :n[i]].tolist()
            assert not x[i, n[i]:].any() and not y[i, n[i]:].any()
    assert seen == {s: ([e["x"][0] for e in r], [e["y"][0] for e in r], [e["t"] for e in r]) for s, r in enumerate(rows)}


def test_sums_and_maps_take_wide_rows_in_parts(spark, monkeypatch):
    """A batch reaches ``per_batch`` and a feature map in parts of bounded size, with nothing lost or doubled."""
    x = np.random.default_rng(12).normal(size=(2_500, 3))
    batch = pa.RecordBatch.from_arrays([sums.arrow_lists(x), pa.array(np.arange(2_500.0))], names=["x", "y"])
    monkeypatch.setattr(sums, "_PART_BYTES", 4_000)
    parts = list(sums._parts(batch))
    assert len(parts) > 10 and all(p.nbytes <= 4_100 for p in parts)
    assert (np.vstack([sums.matrix_of(p, "x") for p in parts]) == x).all() and np.concatenate([sums.vector_of(p, "y") for p in parts]).tolist() == list(range(2_500))
    df = frame(spark, x).coalesce(1)
    rng = np.random.default_rng(4)
    w, b = rng.normal(scale=np.sqrt(1.0), size=(3, 8)), rng.uniform(0, 2 * np.pi, 8)
    got = {r["id"]: r["z"] for r in df.select("id", classifiers.fourier_map("v", 3, 8, 0.5, 4).alias("z")).collect()}
    want = np.sqrt(2.0 / 8) * np.cos(x @ w + b)
    assert len(got) == 2_500 and all(np.allclose(got[i], want[i], atol=1e-12) for i in got)
    assert classifiers._MAP_ROWS < 2_500


def test_a_null_input_leaves_nulls_behind(spark, waves):
    """What a missing number makes unknown is null in the results, in whole and in cut series, and no round waits for it to settle."""
    model = series.series_reservoir_fit(waves, "s", "t", "x", "y", SPEC)
    rows = [(1, float(t), [None if t == 305 else 0.5]) for t in range(300, 330)]
    new = spark.createDataFrame(rows, "s long, t double, x array<double>")
    for segment in (10_000, 8):
        got = {r["t"]: r["y_hat"] for r in series.series_continue(model, new, "s", "t", "x", rows_per_segment=segment).collect()}
        assert len(got) == 30 and all((v == [None]) == (t >= 305) for t, v in got.items())
