import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidefold.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tidefold-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Frame from rows and a schema, through pandas-free createDataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def series():
    """Two autoregressive series with a cycle, as a pandas frame of a panel."""
    rng = np.random.default_rng(5)
    out = []
    for name, n, phi in (("a", 150, 0.7), ("b", 131, 0.4)):
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = phi * y[t - 1] + np.sin(t / 3.0) + rng.normal(scale=0.5)
        out.append(pd.DataFrame({"series_id": name, "pos": np.arange(n), "value": y + 10}))
    return pd.concat(out, ignore_index=True)
