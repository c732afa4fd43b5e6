"""No caps, no lost rows, no silent local folder."""

import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import session
from seriesloom.functions import periods
from seriesloom.operators import panel as P, reshape as R, stats
from seriesloom.operators.intervals import add_conformal


def test_cluster_without_shared_folder_is_refused():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                            sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(spark)
    spark.conf.get = lambda *_: "hdfs:///shared"
    assert session.shared_folder(spark) == "hdfs:///shared"


def test_weekends_count_for_the_friday_before(spark):
    days = [(datetime.datetime(2024, 3, 1) + datetime.timedelta(k), float(k + 1)) for k in range(14)]
    raw = spark.createDataFrame([("a", d, v) for d, v in days], "id string, ts timestamp_ntz, v double")
    series = P.build_series(raw, "id", "ts", "v", "business_day")
    rows = P.regular_grid(series, "business_day").orderBy("date").collect()
    assert sum(r.value for r in rows) == sum(v for _, v in days)
    assert all(r.date.weekday() < 5 for r in rows) and rows[0].value == 1 + 2 + 3


def test_grid_keeps_rows_off_the_grain(spark):
    days = [datetime.datetime(2024, 3, 1) + datetime.timedelta(k) for k in (0, 1, 4, 8)]
    rows = spark.createDataFrame([("a", d, 1.0) for d in days], "id string, date timestamp_ntz, value double")
    got = P.regular_grid(rows, "business_day").where("value IS NOT NULL").orderBy("date").collect()
    assert [r.date for r in got] == days
    assert spark.range(1).select(periods.truncate(F.lit(days[1]).cast("timestamp_ntz"), "business_day")).first()[0] == days[0]


def test_levels_keep_their_places(spark):
    got = [float(r.conf_lvl) for r in R.with_levels(spark.range(1), [0.8, 0.975, 0.995]).collect()]
    assert got == [0.8, 0.975, 0.995]


def test_bounds_need_enough_residuals(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", "m", run, day + datetime.timedelta(k + 30 * (run == "future")), True, 10.0 + k, 10.0)
            for run in ("test", "future") for k in range(9)]
    preds = spark.createDataFrame(rows, "id string, model_desc string, run string, date timestamp_ntz, ahead boolean, "
                                        "actual double, prediction double")
    got = add_conformal(preds, "future", [0.9, 0.95]).select("conf_lvl", "conf_lo", "conf_hi").distinct().collect()
    assert {float(r.conf_lvl): r.conf_hi for r in got} == {0.9: 18.0, 0.95: None}


def test_all_points_of_a_long_series_count(spark):
    n = 20000
    x = np.random.default_rng(0).gamma(2.0, size=n)
    day = datetime.datetime(1970, 1, 1)
    rows = spark.createDataFrame([("a", day + datetime.timedelta(k), float(v)) for k, v in enumerate(x)],
                                 "id string, date timestamp_ntz, value double")
    points = stats.sample(rows)
    assert points.count() == n
    e = x - x.mean()
    skew, kurt = (e**3).mean() / (e**2).mean() ** 1.5, (e**4).mean() / (e**2).mean() ** 2 - 3
    assert np.isclose(stats.jarque_bera(points).first()["statistic"], n / 6 * (skew**2 + kurt**2 / 4), rtol=1e-9)
    lags = int(4 * (n / 100) ** 0.25)
    spread = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))) / n
    assert lags > 10 and np.isclose(stats.kpss(points).first()["statistic"], (np.cumsum(e) ** 2).sum() / n**2 / spread)
    r = [(e[i:] @ e[:-i]) / (e @ e) for i in range(1, int((n - 1) ** (1 / 3)) + 1)]
    box = {row.test: row.statistic for row in stats.box_tests(points).collect()}
    assert np.isclose(box["Box-Pierce"], n * sum(a * a for a in r))
