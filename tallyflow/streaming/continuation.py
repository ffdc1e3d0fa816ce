"""Continue reservoir series on a stream: state per series is the reservoir state and the last
output, kept in Spark's state store between micro-batches."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyflow.operators.noise import keyed_uniform
from tallyflow.operators.series import SeriesModel, noise_keys


def continue_stream(model: SeriesModel, stream: DataFrame, series_id: str, t: str, x: str) -> DataFrame:
    """(series_id, t, y_hat) for new inputs as they arrive. A series' first rows start from its
    last training state, or from zero when it was not trained on; rows of a micro-batch are
    processed in the order of ``t``. Late rows continue from the current state."""
    spec, readout = model.spec, model.readout
    w, w_in, w_fb = spec.weights()
    start = model.last.select("series_id", F.col("state").alias("s0"), F.col("prev_y").alias("y0"))
    rows = stream.select(F.col(series_id).cast("bigint").alias("series_id"), F.col(t).cast("double").alias("t"),
                         F.col(x).cast("array<double>").alias("x")).join(start, "series_id", "left")

    def run(key, frames, state):
        pdf = pd.concat(list(frames)).sort_values("t")
        if state.exists:
            s, prev = (np.array(v) for v in state.get)
        else:
            s0, y0 = pdf["s0"].iloc[0], pdf["y0"].iloc[0]
            s = np.array(s0) if s0 is not None else np.zeros(spec.units)
            prev = np.array(y0) if y0 is not None else np.zeros(spec.outputs)
        hats = []
        for at, value in zip(pdf["t"].to_numpy(), pdf["x"]):
            xs = np.asarray(value) * spec.input_scaling + spec.input_shift
            pre = w @ s + w_in @ xs + (w_fb @ prev if spec.teacher_forcing else 0.0)
            s = np.tanh(pre)
            if spec.noise:
                s = s + spec.noise * (keyed_uniform(noise_keys(np.array([key[0]]), np.array([at])), 0, spec.units, spec.seed)[0] - 0.5)
            prev = np.concatenate([s, xs]) @ readout
            hats.append(list((prev - spec.teacher_shift) / spec.teacher_scaling))
        state.update((list(map(float, s)), list(map(float, prev))))
        yield pd.DataFrame({"series_id": key[0], "t": pdf["t"].to_numpy(), "y_hat": hats})

    return rows.groupBy("series_id").applyInPandasWithState(
        run, "series_id bigint, t double, y_hat array<double>",
        "s array<double>, y array<double>", "append", GroupStateTimeout.NoTimeout)
