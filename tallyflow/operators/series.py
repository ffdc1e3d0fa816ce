"""Reservoir regression over many ordered series, with the target fed back into the reservoir,
and continuation from the last training state.

A series is cut into consecutive segments of bounded length, so one very long series does not
become one task. A segment needs the reservoir state at its start. All segments first run from
an empty start, and a few from a second one. If these forget their start, the end of each segment
becomes the start of the next one and the segments whose start changed run again together, until none
changes. If they do not, segment j runs once more when segment j - 1 is final: no segment runs more
than twice, in as many turns as the longest series has segments.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyflow.operators.noise import keyed_uniform
from tallyflow.operators.sums import matrix_sums, vector_of
from tallyflow.sources.storage import delete_work, durable, work_path

ROWS_PER_SEGMENT = 20_000
#: Bytes of states a Python worker holds at once, if more than one segment's.
_STATE_BYTES = 16 << 20


@dataclass(frozen=True)
class SeriesSpec:
    inputs: int = 1
    outputs: int = 1
    units: int = 200
    rho: float = 0.95
    sparsity: float = 0.0
    noise: float = 0.001
    input_scaling: float = 1.0
    input_shift: float = 0.0
    teacher_scaling: float = 1.0
    teacher_shift: float = 0.0
    teacher_forcing: bool = True
    seed: int = 0

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recurrent, input and feedback weights."""
        rng = np.random.default_rng([self.seed, 3])
        w = rng.uniform(-0.5, 0.5, (self.units, self.units))
        w[rng.uniform(size=w.shape) < self.sparsity] = 0.0
        radius = np.max(np.abs(np.linalg.eigvals(w)))
        w = w * (self.rho / radius) if radius > 1e-12 else w
        return (w, rng.uniform(-1, 1, (self.units, self.inputs)), rng.uniform(-1, 1, (self.units, self.outputs)))

    @property
    def transient(self) -> int:
        """Leading states of a series that the readout does not learn from."""
        return min(self.inputs // 10, 100)


def pack_segments(df: DataFrame, series_id: str, t: str, x: str, y: str | None = None,
                  rows_per_segment: int = ROWS_PER_SEGMENT) -> tuple[DataFrame, bool]:
    """(frame (series_id, seg, rows) of ordered runs of (t, x, y), whether any series was cut).
    Only series longer than a segment are cut, at quantiles of their own time axis; (series, t)
    must be unique."""
    target = F.col(y) if y is not None else F.lit(None).cast("array<double>")
    rows = df.select(F.col(series_id).cast("bigint").alias("series_id"), F.col(t).cast("double").alias("t"),
                     F.col(x).cast("array<double>").alias("x"), target.cast("array<double>").alias("y"))
    sizes = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    if longest <= rows_per_segment:
        cut = rows.withColumn("seg", F.lit(0))
    else:
        # equally spaced probes sized by the longest series; shorter long series get spare cuts
        pieces = math.ceil(longest / rows_per_segment)
        probes = [i / pieces for i in range(1, pieces)]
        long = sizes.filter(F.col("n") > rows_per_segment).select("series_id")
        cuts = (rows.join(long, "series_id", "left_semi").groupBy("series_id")
                .agg(F.array_distinct(F.percentile_approx("t", probes, max(10_000, 10 * pieces))).alias("cuts")))
        cuts = durable(cuts)   # sketches may differ when recomputed; every row must see the same cuts
        placed = rows.join(cuts, "series_id", "left")
        cut = placed.withColumn("seg", F.coalesce(
            F.size(F.filter("cuts", lambda c: c < F.col("t"))), F.lit(0))).drop("cuts")
        cut = cut.withColumn("seg", F.when(F.col("seg") < 0, 0).otherwise(F.col("seg")))
    return cut.groupBy("series_id", "seg").agg(
        F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("rows")), longest > rows_per_segment


def _slices(batch: pa.RecordBatch, spec: SeriesSpec):
    """Segments of similar length together, few enough for their states to fit in memory."""
    sizes = batch.column("rows").value_lengths().to_numpy()
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        step = max(1, _STATE_BYTES // (8 * int(sizes[order[at]]) * (spec.units + spec.inputs + 3 * spec.outputs)))
        yield batch.take(pa.array(order[at:at + step]))
        at += step


def _values(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as a matrix, without a Python object per row."""
    if lists.null_count or (len(lists) and (lists.value_lengths().to_numpy() != width).any()):
        raise ValueError(f"inputs and targets must hold {width} numbers")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as lists of numbers with nulls for NaN, which a null input or target makes."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64(), from_pandas=True))


def _unpack(rows: pa.ListArray, spec: SeriesSpec, taught: bool):
    """Padded (segments, steps, ...) inputs and targets, the segment lengths and the times."""
    n = rows.value_lengths().to_numpy()
    each = rows.flatten()
    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.arange(len(n)), n), step
    x = np.zeros((len(n), int(n.max()), spec.inputs))
    y = np.zeros((*x.shape[:2], spec.outputs))
    times = np.zeros(x.shape[:2])
    x[at] = _values(each.field("x"), spec.inputs)
    times[at] = each.field("t").to_numpy(zero_copy_only=False)
    if taught:
        y[at] = _values(each.field("y"), spec.outputs)
    return x, y, n, times


def noise_keys(ids: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Noise belongs to (series, time), whatever segment or micro-batch a row is in."""
    with np.errstate(over="ignore"):
        return np.asarray(ids).astype(np.int64) * np.int64(1_000_003) + np.asarray(times, dtype=np.float64).view(np.int64)


def _starts(batch: pa.RecordBatch, spec: SeriesSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State and output before every segment, and whether it is its series' first."""
    return _values(batch.column("state"), spec.units), _values(batch.column("prev_y"), spec.outputs), vector_of(batch, "place") == 0


def _run(x, y, n, ids, times, state, last_y, first, spec: SeriesSpec, readout=None, keep: bool = True):
    """States of padded segments (none without ``keep``). With ``readout`` the output feeds back instead of ``y``.
    A series' very first training row keeps the zero state."""
    w, w_in, w_fb = spec.weights()
    xs = x * spec.input_scaling + spec.input_shift
    ys = y * spec.teacher_scaling + spec.teacher_shift
    steps = x.shape[1]
    states = np.zeros((len(x), steps if keep else 0, spec.units))
    outputs = np.zeros_like(ys)
    s, prev = state.copy(), last_y.copy()
    for t in range(steps):
        pre = s @ w.T + xs[:, t] @ w_in.T
        if spec.teacher_forcing:
            pre += prev @ w_fb.T
        new = np.tanh(pre)
        if spec.noise:
            new += spec.noise * (keyed_uniform(noise_keys(ids, times[:, t]), 0, spec.units, spec.seed) - 0.5)
        if readout is None and t == 0:
            new = np.where(first[:, None], 0.0, new)
        live = (t < n)[:, None]
        s = np.where(live, new, s)
        out = ys[:, t] if readout is None else np.hstack([s, xs[:, t]]) @ readout
        prev = np.where(live, out, prev)
        outputs[:, t] = out
        if keep:
            states[:, t] = s
    return states, xs, ys, outputs, s, prev


def _settle(packed: DataFrame, cut: bool, spec: SeriesSpec, readout: np.ndarray | None, starts: DataFrame | None,
            tol: float, trace: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments with exact starts, last state and output per series). All segments run once from a guessed start. If segments
    forget their start, ends are passed on and what moved runs again, all together; if not, segment i waits until i - 1 is final,
    so that none runs more than twice. ``trace`` receives the number of segments run in every round."""
    taught = readout is None
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)

    def ends(batches):
        for part in (part for batch in batches for part in _slices(batch, spec)):
            x, y, n, times = _unpack(part.column("rows"), spec, taught)
            s, prev = _run(x, y, n, vector_of(part, "series_id"), times, *_starts(part, spec), spec, readout, keep=False)[4:]
            yield pa.RecordBatch.from_arrays([part.column("series_id"), part.column("seg"), _lists(s), _lists(prev)],
                                             names=["series_id", "seg", "end_s", "end_y"])

    schema = "series_id bigint, seg int, end_s array<double>, end_y array<double>"
    if not cut:
        whole = packed.withColumn("place", F.lit(0)).withColumn("state", zeros(spec.units)) \
            .withColumn("prev_y", zeros(spec.outputs))
        if starts is not None:
            known = starts.select("series_id", F.col("state").alias("s0"), F.col("prev_y").alias("y0"))
            whole = whole.join(known, "series_id", "left").withColumn("state", F.coalesce("s0", "state")) \
                .withColumn("prev_y", F.coalesce("y0", "prev_y")).drop("s0", "y0")
        if taught:
            whole = durable(whole)
        return whole, whole.mapInArrow(ends, schema).select(
            "series_id", F.col("end_s").alias("state"), F.col("end_y").alias("prev_y"))
    packed = durable(packed)
    order = Window.partitionBy("series_id").orderBy("seg")
    # numbering and chaining look at one record per segment, never at rows
    ids = packed.select("series_id", "seg").withColumn("place", F.row_number().over(order) - 1)
    if taught:
        ends_y = packed.select("series_id", "seg", F.element_at("rows", -1)["y"].alias("end_y"))
        ids = ids.join(ends_y, ["series_id", "seg"])
        scaled = F.transform(F.lag("end_y").over(order),
                             lambda v: v * F.lit(spec.teacher_scaling) + F.lit(spec.teacher_shift))
        ids = ids.withColumn("prev_y", F.coalesce(scaled, zeros(spec.outputs))).drop("end_y") \
            .withColumn("state", zeros(spec.units))
    else:
        ids = ids.withColumn("prev_y", zeros(spec.outputs)).withColumn("state", zeros(spec.units))
        if starts is not None:
            known = starts.select("series_id", F.col("state").alias("s0"), F.col("prev_y").alias("y0"))
            head = F.col("place") == 0
            ids = ids.join(known, "series_id", "left") \
                .withColumn("state", F.when(head, F.coalesce("s0", "state")).otherwise(F.col("state"))) \
                .withColumn("prev_y", F.when(head, F.coalesce("y0", "prev_y")).otherwise(F.col("prev_y"))) \
                .drop("s0", "y0")
    starts_now = durable(ids)
    gap_of = lambda: F.array_max(F.zip_with("state", "in_s", lambda a, b: F.abs(a - b))) if taught else F.greatest(
        F.array_max(F.zip_with("state", "in_s", lambda a, b: F.abs(a - b))), F.array_max(F.zip_with("prev_y", "in_y", lambda a, b: F.abs(a - b))))

    def run(some: DataFrame) -> DataFrame:
        done = durable(packed.join(some, ["series_id", "seg"]).mapInArrow(ends, schema))
        if trace is not None:
            trace.append(done.count())
        return done

    reached = run(starts_now)
    if not _forgets(starts_now, reached, run, taught, tol):
        starts_now, reached = _in_turn(packed, starts_now, reached, ends, schema, taught, trace)
        last = _last_ends(reached)
        return packed.join(starts_now, ["series_id", "seg"]), last
    while True:
        chained = starts_now.join(reached, ["series_id", "seg"]) \
            .withColumn("in_s", F.lag("end_s").over(order)).withColumn("in_y", F.lag("end_y").over(order))
        new_y = F.col("prev_y") if taught else F.coalesce("in_y", "prev_y")
        chained = chained.withColumn("moved", F.coalesce(gap_of() > tol, F.lit(False)))
        keep = lambda new, old: F.when(F.col("moved"), new).otherwise(F.col(old))
        starts_now = durable(chained.select("series_id", "seg", "place", keep(F.col("in_s"), "state").alias("state"),
                                            keep(new_y, "prev_y").alias("prev_y"), "moved"))
        pending = starts_now.filter("moved").drop("moved")
        starts_now = starts_now.drop("moved")
        if pending.isEmpty():
            break
        ran = run(pending)
        reached = durable(reached.join(ran.select("series_id", "seg"), ["series_id", "seg"], "left_anti").unionByName(ran))
    return packed.join(starts_now, ["series_id", "seg"]), _last_ends(reached)


def _last_ends(reached: DataFrame) -> DataFrame:
    return reached.groupBy("series_id").agg(F.max_by(F.struct("end_s", "end_y"), "seg").alias("e")) \
        .select("series_id", F.col("e.end_s").alias("state"), F.col("e.end_y").alias("prev_y"))


def _in_turn(packed: DataFrame, starts: DataFrame, reached: DataFrame, ends, schema: str, taught: bool, trace: list | None) -> tuple[DataFrame, DataFrame]:
    """(starts, ends) of all segments, the segments of one place in all series at a time, each from the end before it. Segments are
    written by place, so that a turn reads its own only; two turns' ends are all that passes between them."""
    spark = packed.sparkSession
    path = work_path(spark, "by-place")
    packed.join(starts, ["series_id", "seg"]).write.partitionBy("place").parquet(path)
    by_place = spark.read.parquet(path)
    before = durable(reached.join(starts.filter("place = 0"), ["series_id", "seg"]))
    done = before.select("series_id", "seg", "place", "state", "prev_y", "end_s", "end_y")
    turns = starts.agg(F.max("place")).first()[0]
    for place in range(1, turns + 1):
        passed = before.select("series_id", F.col("end_s").alias("in_s"), F.col("end_y").alias("in_y"))
        due = by_place.filter(F.col("place") == place).drop("state").join(passed, "series_id").withColumnRenamed("in_s", "state")
        due = due.drop("in_y") if taught else due.drop("prev_y").withColumnRenamed("in_y", "prev_y")
        ran = durable(due.mapInArrow(ends, schema)).join(passed, "series_id")
        known = starts.filter(F.col("place") == place).select("series_id", "seg", "place", "prev_y")
        before = durable(ran.join(known, ["series_id", "seg"]).select(
            "series_id", "seg", "place", F.col("in_s").alias("state"), (F.col("prev_y") if taught else F.col("in_y")).alias("prev_y"), "end_s", "end_y"))
        if trace is not None:
            trace.append(before.count())
        done = done.unionByName(before)
        if place % 32 == 0:
            done = durable(done)
    done = durable(done)
    delete_work(spark, path)
    return done.select("series_id", "seg", "place", "state", "prev_y"), done.select("series_id", "seg", "end_s", "end_y")


#: Segments that are run from a second start to see whether they forget it.
_PROBES = 32


def _forgets(starts: DataFrame, reached: DataFrame, run, taught: bool, tol: float) -> bool:
    """True when segments reach the same end from a start far from the first one, so that ends may be passed on before they are
    final. At most one segment a series is tried."""
    later = starts.filter("place > 0")
    series = later.select("series_id").distinct().count()
    if not series:
        return True
    away = lambda c: F.transform(c, lambda v: v + 0.5)
    probes = later.orderBy(F.xxhash64("series_id", "seg"), "series_id", "seg").limit(min(_PROBES, series))
    if not taught:
        probes = probes.withColumn("prev_y", away("prev_y"))
    other = run(probes.withColumn("state", away("state"))).select("series_id", "seg", F.col("end_s").alias("s2"), F.col("end_y").alias("y2"))
    far = F.greatest(*[F.array_max(F.zip_with(a, b, lambda v, w: F.abs(v - w))) for a, b in (("end_s", "s2"), ("end_y", "y2"))])
    gap = other.join(reached, ["series_id", "seg"]).agg(F.max(far)).first()[0]
    return gap is not None and gap <= tol


@dataclass
class SeriesModel:
    spec: SeriesSpec
    readout: np.ndarray
    last: DataFrame            # (series_id, state, prev_y)
    segments: DataFrame

    def fitted(self) -> DataFrame:
        """(series_id, t, y, y_hat) on the training rows."""
        return _predict(self.segments, self.spec, self.readout, taught=True)

    def transform(self, df: DataFrame, series_id: str, t: str, x: str, **options) -> DataFrame:
        return series_continue(self, df, series_id, t, x, **options)


def series_reservoir_fit(df: DataFrame, series_id: str, t: str, x: str, y: str, spec: SeriesSpec,
                         rows_per_segment: int = ROWS_PER_SEGMENT, tol: float = 1e-12, trace: list | None = None) -> SeriesModel:
    """One readout for all series, from the summed normal equations of (state, input) -> target."""
    packed, cut = pack_segments(df, series_id, t, x, y, rows_per_segment)
    segments, last = _settle(packed, cut, spec, None, None, tol, trace)

    def normal_equations(batch):
        total = 0.0
        for part in _slices(batch, spec):
            xx, yy, n, times = _unpack(part.column("rows"), spec, True)
            place = vector_of(part, "place")
            states, xs, ys, *_ = _run(xx, yy, n, vector_of(part, "series_id"), times, *_starts(part, spec), spec)
            steps = np.arange(xx.shape[1])
            used = (steps[None, :] < n[:, None]) & ((place > 0)[:, None] | (steps >= spec.transient)[None, :])
            a = np.concatenate([states, xs, ys], axis=2)[used]
            total = total + a.T @ a
        return {0: total}

    g = matrix_sums(segments, normal_equations)[0]
    d = spec.units + spec.inputs
    readout = np.linalg.pinv(g[:d, :d], rcond=1e-13, hermitian=True) @ g[:d, d:]
    return SeriesModel(spec, readout, durable(last), segments)


def _predict(segments: DataFrame, spec: SeriesSpec, readout: np.ndarray, taught: bool) -> DataFrame:
    def run(batches):
        for part in (part for batch in batches for part in _slices(batch, spec)):
            x, y, n, times = _unpack(part.column("rows"), spec, taught)
            states, xs, _, outputs, *_ = _run(x, y, n, vector_of(part, "series_id"), times, *_starts(part, spec), spec,
                                              None if taught else readout, keep=taught)
            hat = np.concatenate([states, xs], axis=2) @ readout if taught else outputs
            hat = (hat - spec.teacher_shift) / spec.teacher_scaling
            live = np.arange(x.shape[1]) < n[:, None]
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([part.column("series_id").take(of), pa.array(times[live], from_pandas=True),
                                              _lists(y[live]), _lists(hat[live])], names=["series_id", "t", "y", "y_hat"])

    out = segments.mapInArrow(run, "series_id bigint, t double, y array<double>, y_hat array<double>")
    return out if taught else out.drop("y")


def series_continue(model: SeriesModel, df: DataFrame, series_id: str, t: str, x: str,
                    continuation: bool = True, rows_per_segment: int = ROWS_PER_SEGMENT,
                    tol: float = 0.0, trace: list | None = None) -> DataFrame:
    """(series_id, t, y_hat) for new inputs. Each series starts from its last training state and
    output (or from zero) and its own output is fed back. A cut series is exact: with ``tol=0``
    rounds go on until every start equals the end before it."""
    packed, cut = pack_segments(df, series_id, t, x, None, rows_per_segment)
    segments, _ = _settle(packed, cut, model.spec, model.readout, model.last if continuation else None, tol, trace)
    return _predict(segments, model.spec, model.readout, taught=False)
