import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def walk(spark):
    """Seeded random-walk bars: two symbols, 700 bars each."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for sym in ("a", "b"):
        close = 100.0
        for i in range(700):
            open_ = close * (1 + rng.normal(0, 0.004))
            close = open_ * (1 + rng.normal(0, 0.012))
            high, low = max(open_, close) * (1 + abs(rng.normal(0, 0.006))), min(open_, close) * (1 - abs(rng.normal(0, 0.006)))
            vol = float(rng.integers(1, 100))
            rows.append((sym, i, i * 3600000, (i + 1) * 3600000, open_, high, low, close, vol, int(vol), vol / 2))
    schema = ("symbol string, bar_idx long, open_ms long, close_ms long, open double, high double, low double, close double, "
              "volume double, trades long, taker_base double")
    return spark.createDataFrame(rows, schema).cache()
