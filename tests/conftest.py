import math
import os
import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barometry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_bars(ticker: str, price: float, n: int = 300) -> pd.DataFrame:
    """Deterministic daily bars: a slow sine drift with a small weekly kick."""
    rows, day = [], datetime(2022, 1, 3)
    for i in range(n):
        price *= 1 + 0.001 * math.sin(i / 20) + (0.002 if i % 7 == 0 else -0.001)
        rows.append((day + timedelta(days=i), ticker, round(price * 0.999, 2), round(price * 1.005, 2),
                     round(price * 0.995, 2), round(price, 2), 80_000_000 + 100_000 * i))
    return pd.DataFrame(rows, columns=["time", "ticker", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="session")
def bars_pdf():
    return pd.concat([make_bars("SPY", 450.0), make_bars("QQQ", 380.0), make_bars("IWM", 200.0)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    schema = "time timestamp_ntz, ticker string, open double, high double, low double, close double, volume long"
    return spark.createDataFrame(bars_pdf, schema).cache()
