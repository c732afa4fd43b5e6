"""Hinges off the tenths, products of hinges, and Fourier orders above three."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.constants import default_params
from seriesloom.operators import frames as M
from seriesloom.operators.features import append_future
from seriesloom.operators.models import regression as R
from seriesloom.operators.models.registry import fit_predict
from tests.conftest import panel_of


def frame_of(spark, series, ahead=12):
    df = M.model_frame(append_future(panel_of(spark, series), ahead, "month"), [M.Run("future", 0, ahead)])
    return df.withColumn("trend", F.col("t").cast("double"))


@pytest.mark.parametrize("n, at", [(100, 37), (100, 93), (400, 146)])
def test_break_between_the_tenths(spark, n, at):
    y = [10 + 0.5 * min(t, at) - 2.0 * max(t - at, 0) for t in range(1, n + 1)]
    got = fit_predict(frame_of(spark, {"a": y}), "MARS", M.Context(12, ("trend",))).orderBy("date").collect()
    want = y + [10 + 0.5 * at - 2.0 * (t - at) for t in range(n + 1, n + 13)]
    error = np.array([r.prediction for r in got]) - want
    assert np.abs(error).max() < 0.6 and np.abs(error).mean() < 0.1


def test_products_of_hinges(spark):
    """The second feature matters only beyond a value of the first."""
    r = np.random.default_rng(0)
    a, b = r.uniform(0, 10, 300), r.uniform(0, 10, 300)
    y = 5 + 3 * np.maximum(a - 6, 0) * np.maximum(b - 3, 0)
    frame = frame_of(spark, {"a": y.tolist()})
    table = spark.createDataFrame([(i + 1, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "t int, p double, q double")
    frame = frame.join(table, "t", "left")
    errors = []
    for degree in (1, 2):
        rows = fit_predict(frame, "MARS", M.Context(12, ("p", "q")), {"prod_degree": degree}).where("NOT ahead").collect()
        errors.append(np.sqrt(np.mean([(x.prediction - x.actual) ** 2 for x in rows])))
    assert errors[1] < 0.75 * errors[0]


def test_odd_series(spark):
    frame = frame_of(spark, {"flat": [5.0] * 30, "one": [3.0], "two": [1.0, 4.0]})
    for degree in (1, 2):
        rows = fit_predict(frame, "MARS", M.Context(12, ("trend",)), {"prod_degree": degree}).collect()
        assert len(rows) == 33 + 36
        assert all(abs(r.prediction - 5) < 1e-6 for r in rows if r.id == "flat")


def test_sharp_season_takes_its_orders(spark):
    """One high value in 48 cannot be drawn by three waves."""
    y = [100.0 + 80 * (t % 48 == 7) for t in range(48 * 6)]
    frame = frame_of(spark, {"a": y}, 48)
    rows = fit_predict(frame, "TBATS", M.Context(48)).where("ahead").orderBy("date").collect()
    values = [r.prediction for r in rows]
    assert int(np.argmax(values)) == 7 and max(values) > 130
    assert R.MOST_WAVES > 3 and len(R.season_terms(M.Context(48), default_params("TBATS"))[1]) > 20


def trend_of(spark, series):
    frame = frame_of(spark, series)
    params = default_params("Prophet", {"seasonality_yearly": False})
    df = frame.withColumn("_u", F.col("t") / F.max(F.when(~F.col("ahead"), F.col("t"))).over(R.whole(*M.RUN_KEYS)))
    df, x, options = R.trend_terms(df, M.Context(12), params)
    solver = options.pop("solver")
    sums = R.fit_series(df.withColumn("x", x), M.RUN_KEYS, F.col("x"), F.col("y") / 100, ["t"], solver=solver, **options)
    return {r.id: r for r in sums.collect()}, frame, params


def test_flat_and_straight_series_have_no_break(spark):
    r = np.random.default_rng(0)
    series = {"flat": [80.0] * 120, "line": [10 + 0.5 * t for t in range(120)], "noise": (80 + r.normal(0, 0.5, 120)).tolist(),
              "broken": [50.0 if t < 48 else 50.0 + 0.6 * (t - 48) for t in range(120)]}
    got, frame, params = trend_of(spark, series)
    count = int(params["changepoint_num"])
    for key in ("flat", "line", "noise"):
        assert (np.array(got[key].beta)[2:2 + count] == 0).all(), key
    bent = np.array(got["broken"].beta)[2:2 + count]
    assert 0 < (bent != 0).sum() <= 8 and bent.sum() > 0.4
    assert all(x.rounds < 200 for x in got.values())
    ahead = fit_predict(frame, "Prophet", M.Context(12), {"seasonality_yearly": False}).where("ahead AND id = 'broken'")
    error = [x.prediction - (50 + 0.6 * (120 + x.h - 1 - 48)) for x in ahead.collect()]
    assert np.abs(error).max() < 4


def test_sparse_solver_against_its_conditions(spark):
    """At the optimum the gradient balances the penalty in every column."""
    from seriesloom.operators.linear import cross_products, features_array, sparse_least_squares

    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(80), r.normal(size=(80, 3))])
    y = x @ [1.0, 2.0, 0.0, -0.5] + r.normal(0, 0.1, 80)
    df = spark.createDataFrame([("a", *map(float, row[1:]), float(v)) for row, v in zip(x, y)], "id string, a double, b double, c double, y double")
    l1, l2 = [0.0, 5.0, 5.0, 5.0], [0.0, 0.5, 0.5, 0.5]
    beta = np.array(sparse_least_squares(cross_products(df, ["id"], features_array(["a", "b", "c"]), F.col("y")), l1, l2).first().beta)
    slope = x.T @ (x @ beta - y) + np.array(l2) * beta
    for j in range(4):
        if beta[j]:
            assert abs(slope[j] + l1[j] * np.sign(beta[j])) < 1e-4
        else:
            assert abs(slope[j]) <= l1[j] + 1e-6
    assert beta[2] == 0
