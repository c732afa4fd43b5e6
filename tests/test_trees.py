"""Trees against brute force, and every method and importance on one series whatever the others are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.constants import METHOD_DEFAULTS
from seriesloom.functions import trees as T
from seriesloom.operators import frames as M, importance as IM
from seriesloom.operators.features import append_future
from seriesloom.operators.models.registry import fit_predict
from seriesloom.operators.panel import by_date
from tests.conftest import panel_of, seasonal


def brute_stump(x, y, min_leaf):
    best = (0.0, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= cut
            if min(low.sum(), (~low).sum()) >= min_leaf:
                gain = ((y - y.mean()) ** 2).sum() - sum(((y[m] - y[m].mean()) ** 2).sum() for m in (low, ~low))
                if gain > best[0] + 1e-9:
                    best = (gain, np.where(low, y[low].mean(), y[~low].mean()))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_one_split_is_the_best_one(seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(0, 9, (40, 3)).astype(float), r.normal(size=40)
    tree = T.Tree(T.binned(x), y, np.arange(40), min_leaf=3, depth=1)
    gain, want = brute_stump(x, y, 3)
    assert np.allclose(tree.predict(T.binned(x)), want)


def test_limits_of_trees():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(200, 4)), r.normal(size=200)
    codes, rows = T.binned(x), np.arange(200)
    assert np.allclose(T.Tree(codes, y, rows).predict(codes), y)
    few = T.Tree(codes, y, rows, leaves=7)
    assert len(np.unique(few.leaf(codes))) == 7
    sizes = np.unique(T.Tree(codes, y, rows, min_leaf=20).leaf(codes), return_counts=True)[1]
    assert sizes.min() >= 20
    known = rows < 150
    assert np.allclose(T.boosted(codes, y, known, 400, 6, 0.3, 1, 4, 0.0, 1.0, 1)[known], y[known], atol=1e-3)
    line = x @ np.array([1.0, -2.0, 0.5, 0.0])
    assert np.abs(T.rules(x, codes, line, known, 1, 1, 0)[~known] - line[~known]).max() < 0.1
    assert len(np.unique(T.binned(r.normal(size=(5000, 1))))) <= T.BINS


QUICK = {"Random Forest": {"rf_trees": 20}, "Boosted Trees": {"boost_trees": 20}, "ARIMA-Boost": {"arima_boost_trees": 10},
         "Prophet-Boost": {"prophet_boost_trees": 10}, "Feed-Forward AR": {"ffar_num_networks": 2}}


@pytest.fixture(scope="module")
def frames(spark):
    def frame(series):
        df = append_future(panel_of(spark, series), 6, "month").withColumns({
            "trend": F.row_number().over(by_date()).cast("double"),
            "month": F.month("date").cast("double")})
        return M.model_frame(df, M.standard_runs(6, 6))

    a = [v + (7 * k) % 5 for k, v in enumerate(seasonal(60))]
    return frame({"a": a}), frame({"a": a, "b": [3 * v for v in seasonal(72, 900, -4, 200)], "c": seasonal(48, -50, 2, 5)})


@pytest.mark.parametrize("method", sorted(METHOD_DEFAULTS))
def test_other_series_change_nothing(frames, method):
    context = M.Context(12, ("trend", "month"))
    got = [{(r.run, r.date): r.prediction for r in fit_predict(f, method, context, QUICK.get(method)).where("id = 'a'")
            .collect()} for f in frames]
    assert got[0].keys() == got[1].keys() and any(v is not None for v in got[0].values())
    for k, v in got[0].items():
        assert (v is None) == (got[1][k] is None) and (v is None or np.isclose(v, got[1][k], rtol=1e-6, atol=1e-6)), (method, k)


@pytest.mark.parametrize("score", [IM.predictive_power, lambda df, f: IM.forest(df, f, trees=10, repeats=2)])
def test_other_series_change_no_importance(spark, score):
    one = panel_of(spark, {"a": seasonal(60)})
    two = panel_of(spark, {"a": seasonal(60), "b": seasonal(80, 5, 9, 1)})
    add = lambda df: df.withColumns({"month": F.month("date"), "year": F.year("date")})
    got = [sorted((r.variable, r.importance) for r in score(add(df), ["month", "year"]).where("id = 'a'").collect())
           for df in (one, two)]
    assert got[0] == got[1] and got[0]
