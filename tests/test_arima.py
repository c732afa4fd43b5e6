"""Seasonal ARIMA: long first regression, order search, root check, all horizons."""

import numpy as np
import pytest

from seriesloom.constants import default_params
from seriesloom.operators import frames as M
from seriesloom.operators.models import arima
from tests.conftest import panel_of

RUNS = [M.Run("future", 0, 6)]


def noise(n, seed=1):
    return np.random.default_rng(seed).normal(0, 1, n)


def seasonal_ma(n, theta=0.6, ar=0.0, m=12, seed=1):
    e = noise(n + 200, seed)
    z = e.copy()
    for t in range(m, len(e)):
        z[t] = e[t] + theta * e[t - m] + ar * z[t - 1]
    return (50 + z[-n:]).tolist()


def with_future(spark, series):
    from seriesloom.operators.features import append_future

    return M.model_frame(append_future(panel_of(spark, series), 6, "month"), RUNS)


def fixed(**orders):
    return default_params("SARIMA", {"auto_arima": False, **orders})


def test_seasonal_moving_average_is_recovered(spark):
    frame = with_future(spark, {"a": seasonal_ma(600), "b": seasonal_ma(600, -0.5, seed=2), "c": seasonal_ma(600, 0.5, 0.6, seed=3)})
    got = {r.id: r for r in arima.sarima_parameters(frame, M.Context(12), fixed(non_seasonal_ar=1, seasonal_ma=1)).collect()}
    for key, theta, ar in (("a", 0.6, 0.0), ("b", -0.5, 0.0), ("c", 0.5, 0.6)):
        assert abs(got[key].coefficients["es1"] - theta) < 0.12 and abs(got[key].coefficients["z1"] - ar) < 0.1


def test_search(spark):
    r = noise(400, 5)
    walk = np.cumsum(np.cumsum(r))
    ar3 = np.zeros(400)
    for t in range(3, 400):
        ar3[t] = 0.2 * ar3[t - 1] + 0.45 * ar3[t - 3] + r[t]
    frame = with_future(spark, {"ma": seasonal_ma(480), "walk": walk.tolist(), "ar3": (ar3 + 20).tolist(), "flat": [5.0] * 60,
                                "short": [1.0, 2.0, 4.0]})
    got = {x.id: x for x in arima.sarima_parameters(frame, M.Context(12), default_params("SARIMA")).collect()}
    assert got["ma"].seasonal_d == got["ma"].d == 0  # what a shock leaves after a season, by either kind of term
    assert abs(got["ma"].coefficients["es1"] + got["ma"].coefficients["zs1"] - 0.6) < 0.15
    assert got["walk"].d == 2 and got["flat"].d == 0
    assert abs(got["ar3"].coefficients["z3"] - 0.45) < 0.15, got["ar3"]
    rows = arima.sarima(frame, M.Context(12), default_params("SARIMA")).where("ahead").collect()
    by = {}
    for x in rows:
        by.setdefault(x.id, []).append(x.prediction)
    assert all(abs(v - 5.0) < 1e-6 for v in by["flat"]) and all(v is not None and np.isfinite(v) for v in by["short"])
    assert abs(by["walk"][5] - (walk[-1] + 6 * (walk[-1] - walk[-2]))) < 40


def test_all_horizons_of_fixed_orders(spark):
    """ARIMA(2,1,1)(1,0,0) by hand from its own coefficients."""
    y = np.cumsum(seasonal_ma(120, 0.3)) - 50 * np.arange(120)
    frame = with_future(spark, {"a": y.tolist()})
    params = fixed(non_seasonal_ar=2, non_seasonal_differences=1, non_seasonal_ma=1, seasonal_ar=1)
    fit, names = arima.arima_fit(frame, 12, params)
    fit = fit.first()
    z = [r["z"] for r in fit.rows if not r["ahead"]]
    e = [r["e"] for r in fit.rows if not r["ahead"]]
    b = dict(zip(["constant", *names], fit.beta))
    level, want = y[-1], []
    for _ in range(6):
        z.append(b["constant"] + b["z1"] * z[-1] + b["z2"] * z[-2] + b["zs1"] * z[-12] + b["e1"] * e[-1])
        e.append(0.0)
        level += z[-1]
        want.append(level)
    got = arima.sarima(frame, M.Context(12), params).where("ahead").orderBy("h").collect()
    assert np.allclose([r.prediction for r in got], want)


@pytest.mark.parametrize("weights, stable", [
    ([], True), ([0.5], True), ([1.0], False), ([-1.2], False), ([1.2, -0.3], True), ([0.5, 0.6], False), ([0.0] * 11 + [0.9], True),
    ([0.0] * 11 + [1.01], False), ([0.0, 0.0], True)])
def test_roots(weights, stable):
    assert arima.is_stable(np.array(weights)) == stable
    if weights and any(weights):
        roots = np.roots([1, *[-w for w in weights]])
        assert (np.abs(roots).max() < 0.9995) == stable


def test_long_lags():
    lags, nested = arima.long_lags(1, 0, 1, 1, 12)
    assert lags[:12] == list(range(1, 13)) and {24, 36, 48}.issubset(lags) and nested[0] == [0, 1, 2]
    assert nested[-1] == list(range(len(lags) + 1)) and all(len(a) < len(b) for a, b in zip(nested, nested[1:]))
    assert arima.long_lags(9, 0, 4, 0, 1)[0] == list(range(1, 16))
