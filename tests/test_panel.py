import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import frames as M
from seriesloom.operators import panel as P
from seriesloom.operators import reshape as R
from seriesloom.operators.features import append_future
from seriesloom.operators.ranks import exact_quantiles
from seriesloom.sources import tables as S
from tests.conftest import months, panel_of


def test_build_series_with_a_hot_id(spark):
    raw = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(cast(id % 400 as int))")).alias("ts"),
        F.lit(0.1).alias("v"))
    out = P.build_series(raw, "k", "ts", "v", "month", decimals=2)
    assert out.groupBy("id", "date").count().where("count > 1").count() == 0
    total = out.agg(F.sum("value")).first()[0]
    assert abs(total - 3000) < 1e-6
    assert out.where("id = 'hot'").agg(F.sum("value")).first()[0] == pytest.approx(1000)


def test_median_of_a_hot_group_is_exact(spark):
    raw = spark.range(9001).select(F.when(F.col("id") < 8000, "hot").otherwise("cold").alias("k"),
                                   (F.col("id") * 7 % 1000).cast("double").alias("v"))
    got = {r["k"]: r["m"] for r in exact_quantiles(raw, ["k"], "v", {"m": 0.5}).collect()}
    want = {r["k"]: r["m"] for r in raw.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == want


@pytest.mark.parametrize("grain,n", [("year", 2), ("quarter", 3), ("week", 4), ("day", 5), ("hour", 6),
                                     ("half_hour", 4), ("business_day", 7), ("semester", 2)])
def test_future_rows_follow_the_grain(spark, grain, n):
    start = datetime.datetime(2021, 1, 1)  # a Friday
    base = spark.createDataFrame([("a", start, 1.0)], "id string, date timestamp_ntz, value double")
    rows = append_future(base, n, grain).orderBy("date").collect()
    assert len(rows) == n + 1 and not rows[0]["is_future"] and all(r["is_future"] for r in rows[1:])
    other = P.add_future(base, n, grain).orderBy("date").collect()
    assert [r["date"] for r in rows] == [r["date"] for r in other]
    if grain == "business_day":
        assert all(r["date"].weekday() < 5 for r in rows)


def test_grid_fills_gaps(spark):
    dates = months(10)
    rows = [("a", dates[i], float(i)) for i in (0, 1, 4, 9)]
    df = spark.createDataFrame(rows, "id string, date timestamp_ntz, value double")
    out = P.regular_grid(df, "month").orderBy("date").collect()
    assert [r["date"] for r in out] == dates
    assert [r["value"] for r in out if r["value"] is not None] == [0.0, 1.0, 4.0, 9.0]


def test_folds_are_disjoint_and_move_back(panel):
    folds = P.time_folds(panel, 20, 5)
    both = folds.groupBy("id", "fold", "date").agg(F.count_distinct("role").alias("n")).where("n > 1")
    assert both.count() == 0
    tests = folds.where("role = 'test'").groupBy("id", "fold").count().collect()
    assert {r["count"] for r in tests} == {4}
    rolling = P.time_folds(panel, 20, 5, expanding=False).where("role = 'train'").groupBy("id", "fold").count()
    assert {(r["id"], r["count"]) for r in rolling.collect()} == {("a", 64), ("b", 52)}


def test_frame_matches_each_run(panel):
    frame = M.model_frame(append_future(panel, 6, "month"), M.standard_runs(12, 6) + M.fold_runs(12, 3))
    counts = {(r["id"], r["run"], r["ahead"]): r["count"] for r in frame.groupBy("id", "run", "ahead").count().collect()}
    assert counts["a", "test", True] == 12 and counts["a", "test", False] == 72
    assert counts["a", "future", True] == 6 and counts["a", "future", False] == 84
    assert counts["a", "fold1", True] == 4 and counts["a", "fold1", False] == 84 - 12 - 4
    assert frame.where("ahead AND y IS NOT NULL").count() == 0


def test_rolling_and_random_folds(panel):
    frame = M.model_frame(panel, M.fold_runs(12, 3, rolling=True))
    sizes = frame.where("NOT ahead").groupBy("id", "run").count().collect()
    assert {(r["id"], r["count"]) for r in sizes} == {("a", 84 - 24), ("b", 72 - 24)}
    folds = M.random_fold_frame(panel, 12, 4)
    held = folds.where("ahead").groupBy("id").count().collect()
    assert {(r["id"], r["count"]) for r in held} == {("a", 72), ("b", 60)}
    assert folds.where("ahead = (y IS NOT NULL)").count() == 0


def test_csv_round_trip_and_names(spark, tmp_path):
    df = panel_of(spark, {"a b": [1.0, None, 3.0]})
    path = str(tmp_path / "x.csv")
    S.write_table(df.select("date", "id", "value"), path, "csv")
    back = S.read_series_csv(spark, path).orderBy("date").collect()
    assert [r["value"] for r in back] == [1.0, None, 3.0]
    assert [S.clean_name(n) for n in ("N. Methods", "totalValue", "Delta PP (%)")] == [
        "n_methods", "total_value", "delta_pp_percent"]
    other = tmp_path / "other.csv"
    other.write_text("Value,ID,Date\n1.5,x,2020-01-01\nNA,x,2020-02-01\noops,,2020-03-01\n")
    rows = S.read_series_csv(spark, str(other)).orderBy("date").collect()
    assert [(r["id"], r["value"]) for r in rows] == [("x", 1.5), ("x", None), (None, None)]
    with pytest.raises(ValueError):
        S.read_csv(spark, str(other), "price double")
    with pytest.raises(ValueError):
        S.read_csv(spark, "data.xlsx")
    with pytest.raises(ValueError):
        S.require_columns(df, ["price"])


def test_levels_and_reshape(spark):
    assert len(R.levels_of(0.05, 0.99)) == 20
    assert R.levels_of(0.8, 0.95) == [0.8, 0.85, 0.9, 0.95]
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 5.0)], "k int, a double, b double")
    assert R.constant_columns(df, ["a", "b"]) == ["b"]
    assert R.drop_constant(df, ["a", "b"]).columns == ["k", "a"]
