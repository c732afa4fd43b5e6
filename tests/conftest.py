import datetime
import math

import pytest

from seriesloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def months(n, start=(2000, 1)):
    y, m = start
    return [datetime.datetime(y + (m - 1 + k) // 12, (m - 1 + k) % 12 + 1, 1) for k in range(n)]


def panel_of(spark, series):
    rows = [(i, d, float(v) if v is not None else None) for i, vs in series.items() for d, v in zip(months(len(vs)), vs)]
    return spark.createDataFrame(rows, "id string, date timestamp_ntz, value double")


def seasonal(n, level=200.0, slope=1.0, swing=20.0):
    return [level + slope * t + swing * math.sin(2 * math.pi * t / 12) for t in range(1, n + 1)]


@pytest.fixture(scope="session")
def panel(spark):
    return panel_of(spark, {"a": seasonal(84), "b": seasonal(72, 500, -0.5, 50)}).cache()
