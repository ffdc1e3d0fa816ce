import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np
import pytest

from tallyflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="4", memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def planted(spark):
    """Three well separated Gaussian classes in four dimensions (means not on one line, which a linear
    indicator regression cannot tell apart), one constant column, one string
    column and a class label in mixed case."""
    rng = np.random.default_rng(0)
    names, rows = ["DNS", "lime", "x11"], []
    for i in range(300):
        c = i % 3
        x = rng.normal(size=4) * 0.3 + np.array([c, 2 * (c == 1), 2 * c, 0])
        rows.append((i, *map(float, x), 7.0, "text", names[c]))
    return spark.createDataFrame(rows, "row_id long, f0 double, f1 double, f2 double, f3 double, flat double, note string, label string")
