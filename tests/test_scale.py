"""Work per task stays bounded as tables grow: parts by the number of rows, narrow ranks, few Python workers a task."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from seriesloom.operators import importance as IM
from seriesloom.operators import panel as P
from seriesloom.operators.features import append_future


def raw_rows(spark, ids=40, months=30):
    rows = [(i, datetime(2000 + k // 12, k % 12 + 1, 5), float((i * 7 + k * k) % 23)) for i in range(ids) for k in range(months)]
    return spark.createDataFrame(rows, "key int, at timestamp_ntz, x double")


def test_parts_grow_with_rows(spark, monkeypatch):
    """A large panel is spread by id into parts of bounded size, and stays so in the operators behind it."""
    monkeypatch.setattr(P, "ROWS_A_TASK", 20)
    raw = raw_rows(spark)
    wide = P.build_series(raw, "key", "at", "x", "month", decimals=2, rows=raw.count())
    plain = P.build_series(raw, "key", "at", "x", "month", decimals=2)
    assert wide.rdd.getNumPartitions() == 60
    assert append_future(wide, 3, "month").rdd.getNumPartitions() == 60
    assert P.regular_grid(wide, "month").rdd.getNumPartitions() == 60
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, plain.collect()))
    assert plain.schema["id"].metadata == {}


def test_shipments_know_their_rows(spark, tmp_path, monkeypatch):
    from seriesloom.catalog.registry import ship_monthly

    monkeypatch.setattr(P, "ROWS_A_TASK", 20)
    raw = raw_rows(spark).selectExpr("key l_partkey", "at l_shipdate", "x l_quantity")
    raw.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert ship_monthly(spark, str(tmp_path)).rdd.getNumPartitions() == 60


def test_ranks_do_not_multiply_rows(spark):
    """Rank correlation sorts rows once a column; no copy of the rows for each feature goes through the windows."""
    panel = P.build_series(raw_rows(spark, 3), "key", "at", "x", "month", decimals=2)
    rows = panel.withColumns({"month": F.month("date"), "trend": F.row_number().over(P.by_date())})
    scores = IM.correlations(rows, ["month", "trend"])
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan[plan.index("Window"):]
    data = rows.toPandas()
    for r in scores.collect():
        part = data[data["id"] == r["id"]]
        expected = np.corrcoef(part["value"].rank(), part[r["variable"]].rank())[0, 1]
        assert abs(r["importance"] - expected) < 1e-12
    assert scores.count() == 6


def test_hinges_keep_one_python_worker_a_task(spark):
    """All looks at the knots of a series are one call: each node of the plan has a worker of its own in every task."""
    from seriesloom.constants import default_params
    from seriesloom.operators import frames as M
    from seriesloom.operators.models import regression

    panel = P.build_series(raw_rows(spark, 2), "key", "at", "x", "month", decimals=2)
    frame = M.model_frame(panel, M.standard_runs(4, 0)).withColumn("trend", F.col("t").cast("double"))
    for degree in (1, 2):
        fit = regression.hinge_fit(frame, ["trend"], default_params("MARS", {"prod_degree": degree}))
        assert fit._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        found = fit.collect()
        assert len(found) == 4 and all(len(r["knots"][0]) == regression.TENTHS + 2 * regression.AROUND + 1 for r in found)
        assert all(bool(r["pairs"]) == (degree == 2) for r in found)


def test_values_of_arrays_are_worked_out_before_the_generator(spark):
    """Generators do not compile their expressions; and a fixed ARIMA needs one Python worker a task."""
    from seriesloom.constants import default_params
    from seriesloom.operators import frames as M
    from seriesloom.operators.models import arima, smoothing

    panel = P.build_series(raw_rows(spark, 2), "key", "at", "x", "month", decimals=2)
    frame = M.model_frame(append_future(panel, 3, "month"), M.standard_runs(3, 3))
    fixed = default_params("SARIMA", {"auto_arima": False, "non_seasonal_ar": 1, "non_seasonal_differences": 1})
    for out in (smoothing.theta(frame, M.Context(12), {}), arima.sarima(frame, M.Context(1), fixed)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        last = next(line for line in plan.split("\n") if "Generate" in line)
        assert "lambdafunction" not in last
        assert out.where("ahead AND prediction IS NULL").count() == 0
    assert plan.count("ArrowEvalPython") == 1


def test_narrow_cross_products(spark):
    """Sums of narrow x are buffers of their own and equal those of vectors."""
    from seriesloom.operators.linear import cross_products, features_array

    rows = raw_rows(spark, 3).withColumn("y", F.when(F.col("x") > 2, F.col("x") * 2))
    x = features_array(["x"])
    wide = {r["key"]: (r["n"], list(r["gram"])) for r in cross_products(rows, ["key"], x, F.col("y")).collect()}
    sums = cross_products(rows, ["key"], x, F.col("y"), width=2)
    found = {r["key"]: (r["n"], list(r["gram"])) for r in sums.collect()}
    assert {k: n for k, (n, _) in found.items()} == {k: n for k, (n, _) in wide.items()}
    assert all(np.allclose(found[k][1], gram, rtol=1e-12, atol=0) for k, (_, gram) in wide.items())
    assert "summ" not in sums._jdf.queryExecution().optimizedPlan().toString().lower().replace("sum(", "")


def test_many_ensembles_combine_the_rows_ahead(spark, tmp_path):
    from seriesloom.catalog import QUERIES

    raw_rows(spark, 2).selectExpr("key l_partkey", "at l_shipdate", "x l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["ensembles_many_series"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
    assert out.count() == 2 * 2 * 6 * 2


def small_panel(spark, extra=()):
    panel = P.build_series(raw_rows(spark, 4), "key", "at", "x", "month", decimals=2)
    return panel.unionByName(spark.createDataFrame(list(extra), panel.schema)) if extra else panel


def whole_search(panel, params):
    """Features as they come when every column of every row is searched."""
    from seriesloom.operators import features as X
    from seriesloom.operators import reshape as R

    df = X.feature_frame(panel, params, 12, "month")
    return df.drop(*R.constant_columns(df, R.feature_columns(df)))


def whole_plan(df):
    """Optimised plan with all fields of wide nodes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


def test_features_of_a_date_are_worked_out_once(spark):
    """Calendar and holidays come from a table of dates and are not carried through the windows of the series."""
    from seriesloom.catalog.features import full_params
    from seriesloom.operators import features as X

    panel = small_panel(spark, [("9", None, 4.0), ("9", datetime(2001, 1, 1), 2.0), (None, datetime(2001, 2, 1), 3.0)])
    out = X.generate_features(panel, full_params(), 12, "month")
    plan = whole_plan(out)
    assert "dayofyear" not in plan and "Join LeftOuter" in plan
    plain = whole_plan(X.feature_frame(panel, full_params(), 12, "month"))
    assert plain.rindex("dayofyear") < plain.index("Window")
    expected = whole_search(panel, full_params())
    assert out.dtypes == expected.dtypes
    assert sorted(map(repr, out.collect())) == sorted(map(repr, expected.collect()))


def test_look_at_few_series_drops_nothing(spark, monkeypatch):
    """Whatever the look sees or misses, a column goes only if it is constant in all rows."""
    from seriesloom.operators import features as X

    params = X.FeatureParams(fourier_periods=[12], lags=[3], rolls=[2], interactions=["month * wday.lbl"])
    panel = small_panel(spark)
    seen = [r["id"] for r in panel.select("id").distinct().where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).collect()]
    assert 0 < len(seen) < 4
    level = panel.withColumn("value", F.when(F.col("id").isin(seen), 1.0).otherwise(F.col("value")))
    flat = panel.withColumn("value", F.lit(1.0))
    for look, data, kept in ((2, level, True), (2, flat, False), (10**9, level, True)):
        monkeypatch.setattr(X, "LOOK", look)
        names = X.generate_features(data, params, 12, "month").columns
        assert ("lag3" in names) == kept and "day" not in names and "month" in names
    assert names == whole_search(level, params).columns


def test_features_without_dates_or_rows(spark, monkeypatch):
    from seriesloom.operators import features as X

    panel = small_panel(spark)
    bare = X.FeatureParams(calendar=False, lags=[3])
    assert X.generate_features(panel, bare, 2, "month").columns == ["id", "date", "value", "is_future", "lag3"]
    none = panel.where("value > 1e9")
    assert X.generate_features(none, X.FeatureParams(lags=[3]), 12, "month").columns == whole_search(none, X.FeatureParams(lags=[3])).columns
    assert "sin365.25_K1" in X.feature_frame(panel, X.FeatureParams(fourier_periods=[365.25]), 2, "month").columns
    own = panel.withColumns({"month": F.lit(-1), "month_lbl": F.lit("x"), "lag3": F.lit(0)})
    expected = whole_search(own, X.FeatureParams(lags=[3]))
    for most in (90_000, 0):
        monkeypatch.setattr(X, "MOST_DAYS", most)
        out = X.generate_features(own, X.FeatureParams(lags=[3]), 12, "month")
        assert out.columns == expected.columns
        assert sorted(map(repr, out.collect())) == sorted(map(repr, expected.collect()))
