"""Exponential smoothing: refined parameters, choice without room for AICc, state, long series."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.constants import default_params
from seriesloom.operators import frames as M
from seriesloom.operators.features import append_future
from seriesloom.operators.models import smoothing as S
from tests.conftest import panel_of, seasonal

AUTO = default_params("ETS")


def frame_of(spark, series, ahead=4):
    return M.model_frame(append_future(panel_of(spark, series), ahead, "month"), [M.Run("future", 0, ahead)])


def plain_sse(y, alpha):
    level, total = y[0], 0.0
    for t, x in enumerate(y):
        total += (x - level) ** 2
        level = alpha * x + (1 - alpha) * level
    return total


def test_alpha_is_refined():
    """Between the points of the grid, as near as a dense search comes."""
    r = np.random.default_rng(0)
    y = np.zeros((4, 200))
    for i, alpha in enumerate((0.05, 0.2, 0.45, 0.75)):
        level = 100.0
        for t in range(200):
            e = r.normal()
            y[i, t] = level + e
            level += alpha * e
    n = np.full(4, 200)
    got = S._solve_chunk(y, n, np.full(4, 3), ["none"], ["none"], "additive", False, 1, AUTO)
    for i in range(4):
        dense = min(plain_sse(y[i], a) for a in np.linspace(0.001, 0.999, 999))
        assert plain_sse(y[i], got.alpha[i]) <= dense * (1 + 1e-4)
        assert np.isclose(got.level[i], got["values"][i][-1])


def test_refinement_never_loses(spark):
    r = np.random.default_rng(3)
    y = np.array([np.array(seasonal(84)) + r.normal(0, 3, 84), np.cumsum(r.normal(1, 1, 84)) + 50,
                  np.array(seasonal(84, 500, 0, 100)) * np.linspace(1, 2, 84)])
    n, steps = np.full(3, 84), np.full(3, 12)
    forms = (["none", "additive", "multiplicative"], ["none", "additive", "damped"], "additive", False, 12)
    fine = S._solve_chunk(y, n, steps, *forms, AUTO)
    coarse = S._solve_chunk(y, n, steps, *forms, {**AUTO, "alphas": S.ALPHAS})
    assert (fine.aicc <= coarse.aicc).all() and (fine.aicc < coarse.aicc - 1).any()
    assert fine.season[0] == "additive" and fine.season[1] == "none" and fine.season[2] == "multiplicative"


def test_error_decides_without_room(spark):
    """Four points cannot carry a trend by AICc; a straight line still beats a level."""
    frame = frame_of(spark, {"line": [1.0, 2.0, 3.0, 4.0], "flat": [5.0, 5.0, 5.0], "one": [7.0]})
    rows = S.ets_parameters(frame, M.Context(12), AUTO).collect()
    by = {r.id: r for r in rows}
    assert by["line"].trended and by["one"].aicc is None
    ahead = S.ets(frame, M.Context(12), AUTO).where("ahead AND id = 'line' AND h = 1").first()
    assert abs(ahead.prediction - 5) < 0.5


@pytest.mark.parametrize("season", ["none", "additive"])
def test_segments_equal_steps(monkeypatch, season):
    r = np.random.default_rng(1)
    n = np.array([400, 131, 40])
    y = np.zeros((3, 400))
    for i, size in enumerate(n):
        y[i, :size] = 50 + np.cumsum(r.normal(0, 1, size)) + 5 * np.sin(np.arange(size) * 2 * np.pi / 12)
    grid = S._grid(["none", "additive", "damped"], season, AUTO)
    want_in, got_in = np.zeros_like(y), np.zeros_like(y)
    want = S._recursion(y, n, grid, season, 12, "additive", False, want_in)
    monkeypatch.setattr(S, "LONG", 10)
    got = S._recursion(y, n, grid, season, 12, "additive", False, got_in)
    for a, b in zip(want, got):
        assert np.allclose(a, b, rtol=1e-8, atol=1e-8)
    for i, size in enumerate(n):
        assert np.allclose(want_in[i, :size], got_in[i, :size])


def test_long_series(spark):
    """Half a million points of one id."""
    n = 500_000
    start = datetime.datetime(1970, 1, 1)
    panel = spark.range(n + 24).select(
        F.lit("a").alias("id"), F.timestamp_add("HOUR", F.col("id"), F.lit(start).cast("timestamp_ntz")).alias("date"),
        F.when(F.col("id") < n, 100 + F.col("id") * 1e-3 + 5 * F.sin(F.col("id") / 50.0)).alias("value"),
        (F.col("id") >= n).alias("is_future"))
    at = time.time()
    out = S.ets(M.model_frame(panel, [M.Run("future", 0, 24)]), M.Context(1), AUTO)
    got = out.where("ahead").agg(F.count("prediction"), F.min("prediction"), F.max("prediction")).first()
    assert got[0] == 24 and 550 < got[1] <= got[2] < 650 and time.time() - at < 120
