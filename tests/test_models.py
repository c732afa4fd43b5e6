import pytest
from pyspark.sql import functions as F

from seriesloom.constants import METHOD_DEFAULTS, default_params, method_family
from seriesloom.operators import features as X
from seriesloom.operators import frames as M
from seriesloom.operators import panel as P
from seriesloom.operators.accuracy import accuracy_table
from seriesloom.operators.models import regression, smoothing
from seriesloom.operators.models.registry import MODELS, fit_predict
from seriesloom.plans import forecast as FC
from seriesloom.plans import tuning as TU

FEATURES = ("time_trend", "sin12_K1", "cos12_K1", "lag12")

# largest mean absolute percentage error on a noise-free trend with a season
LIMITS = {
    "Naive": 20, "Seasonal Naive": 8, "Rolling Average": 20, "ETS": 6, "Theta": 8, "SARIMA": 3, "TBATS": 2,
    "STLM": 6, "Prophet": 6, "Linear Regression": 0.5, "Elastic Net": 5, "MARS": 3, "KNN": 10, "SVM": 6,
    "Random Forest": 12, "Boosted Trees": 12, "Cubist": 10, "Feed-Forward": 8, "Feed-Forward AR": 10,
    "ARIMA-Boost": 8, "Prophet-Boost": 10, "H2O AutoML": 8,
}
FAST = {
    "Random Forest": {"rf_trees": 10}, "Boosted Trees": {"boost_trees": 5, "boost_tree_depth": 3},
    "ARIMA-Boost": {"arima_boost_trees": 3, "arima_boost_tree_depth": 2},
    "Prophet-Boost": {"prophet_boost_trees": 3, "prophet_boost_tree_depth": 2},
    "Feed-Forward AR": {"ffar_num_networks": 3, "ffar_non_seasonal_ar": 2, "ffar_seasonal_ar": 1},
}


@pytest.fixture(scope="module")
def featured(panel):
    params = X.FeatureParams(calendar=False, fourier_periods=[12], lags=[12])
    df = X.feature_frame(panel, params, 12, "month")
    return df.withColumn("time_trend", F.row_number().over(P.by_date())).cache()


@pytest.fixture(scope="module")
def frame(featured):
    return M.model_frame(featured, M.standard_runs(12, 12)).cache()


@pytest.mark.parametrize("method", list(MODELS))
def test_method_on_a_clean_series(frame, method):
    preds = fit_predict(frame, method, M.Context(12, FEATURES), FAST.get(method))
    rows = preds.where("run = 'test' AND ahead")
    assert rows.count() == 24 and preds.where("run = 'future' AND ahead AND prediction IS NOT NULL").count() == 24
    scores = accuracy_table(rows, ["id"], ["mape"]).collect()
    assert all(r["mape"] < LIMITS[method] for r in scores), scores


def test_one_series_alone_gives_the_same(panel):
    def run(df):
        frame = M.model_frame(X.append_future(df, 6, "month"), M.standard_runs(12, 6))
        out = fit_predict(frame, "ETS", M.Context(12)).where("id = 'b' AND ahead").orderBy("run", "date")
        return [r["prediction"] for r in out.collect()]

    assert run(panel) == pytest.approx(run(panel.where("id = 'b'")), rel=1e-12)


def plain_holt_winters(ys, m, alpha, beta, gamma, phi, steps):
    level = sum(ys[:m]) / m
    slope = (sum(ys[m:2 * m]) / m - level) / m
    season = [y - level for y in ys[:m]]
    for t, y in enumerate(ys):
        base, s = level + phi * slope, season[t % m]
        new = alpha * (y - s) + (1 - alpha) * base
        slope = beta * (new - level) + (1 - beta) * phi * slope
        season[t % m] = gamma * (y - base) + (1 - gamma) * s
        level = new
    return [level + sum(phi**i for i in range(1, h + 1)) * slope + season[(len(ys) + h - 1) % m]
            for h in range(1, steps + 1)]


def test_fixed_holt_winters_equals_a_plain_loop(panel):
    params = default_params("ETS", {"auto_ets": False, "trend": "additive", "season": "additive", "damping": "damped",
                                    "smooth_level": 0.2, "smooth_trend": 0.1, "smooth_season": 0.3})
    frame = M.model_frame(X.append_future(panel, 12, "month"), [M.Run("future", 0, 12)])
    out = smoothing.ets(frame, M.Context(12), params).where("id = 'a' AND ahead").orderBy("date").collect()
    ys = [r["value"] for r in panel.where("id = 'a'").orderBy("date").collect()]
    want = plain_holt_winters(ys, 12, 0.2, 0.1, 0.3, 0.9, 12)
    assert [r["prediction"] for r in out] == pytest.approx(want, rel=1e-9)


def test_elastic_net_without_penalty_is_least_squares(frame):
    ctx = M.Context(12, FEATURES)
    a = regression.linear(frame, ctx, {}).select("id", "run", "date", F.col("prediction").alias("a"))
    b = regression.elastic(frame, ctx, {"penalty": 0.0, "mixture": 0.5}).select(
        "id", "run", "date", F.col("prediction").alias("b"))
    worst = a.join(b, ["id", "run", "date"]).where("a IS NOT NULL").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert worst < 1.0


def test_workflow_properties(featured):
    result = FC.forecast(featured, ["Naive", "Seasonal Naive", "ETS"], M.Context(12, FEATURES), 12, 12,
                         [0.8, 0.9, 0.95], ensembles=["Average", "Median", "Weighted Average"],
                         stacking=["Linear Regression"], n_folds=3, stage=True)
    rows = result.oos_forecast.where("key = 'prediction'")
    assert rows.where("conf_lo > value OR conf_hi < value").count() == 0
    assert rows.select("model_desc").distinct().count() == 7
    wide = rows.groupBy("id", "model_desc", "date").agg(
        F.max(F.when(F.col("conf_lvl") == 0.95, F.col("conf_hi") - F.col("conf_lo"))).alias("w95"),
        F.max(F.when(F.col("conf_lvl") == 0.8, F.col("conf_hi") - F.col("conf_lo"))).alias("w80"))
    assert wide.where("w95 < w80").count() == 0
    span = result.predictions.where("NOT model_desc LIKE 'Ens%' AND NOT model_desc LIKE 'Stk%'").groupBy(
        "id", "run", "date").agg(F.min("prediction").alias("lo"), F.max("prediction").alias("hi"))
    ens = result.predictions.where("model_desc LIKE 'Ens%' AND ahead").join(span, ["id", "run", "date"])
    assert ens.where("prediction < lo - 1e-9 OR prediction > hi + 1e-9").count() == 0
    only = FC.only_combinations(result)
    assert only.accuracy.where("NOT model_desc RLIKE '^(Ens|Stk) - '").count() == 0
    labels = {r["model_desc"]: r["model_id"] for r in result.models.collect()}
    assert labels["Naive"] == 1 and labels["Stk - Linear Regression"] == 7


def test_tuning_prefers_the_better_point(featured):
    tuned = TU.tune(featured, "Elastic Net", M.Context(12, FEATURES), 12, 3, 6).collect()
    assert len(tuned) == 2 and all(set(r["params"]) == {"penalty", "mixture"} for r in tuned)
    grid = TU.space_filling(["penalty", "neighbors"], 10)
    assert len({g["penalty"] for g in grid}) == 10 and all(1 <= g["neighbors"] <= 15 for g in grid)


def test_registry_and_parameters():
    assert set(MODELS) == set(METHOD_DEFAULTS)
    assert method_family("ETS") == "ts" and method_family("Cubist") == "ml"
    with pytest.raises(ValueError):
        default_params("ETS", {"alpha": 1})
    with pytest.raises(ValueError):
        default_params("Guess")


def test_neighbours_do_not_depend_on_the_parts(frame, monkeypatch):
    from seriesloom.operators.models import neighbours

    def run():
        out = neighbours.knn(frame, M.Context(12, FEATURES[:3]), {"neighbors": 4}).where("ahead")
        return [r["prediction"] for r in out.orderBy("id", "run", "date").collect()]

    whole = run()
    monkeypatch.setattr(neighbours, "PART", 7)
    assert run() == pytest.approx(whole, rel=1e-9) and len(whole) == 48


def test_explanations_add_up(frame):
    from seriesloom.operators import explain as E

    names = ["time_trend", "sin12_K1"]
    test = E.prepared(frame, names)
    predict = E.linear_model(E.prepared(frame, names, "train"), names)
    seen = test.groupBy("id").agg(F.max("date").alias("date")).join(test, ["id", "date"])
    steps = E.break_down(test, seen, names, predict)
    total = {r["id"]: r["s"] for r in steps.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    want = {r["id"]: r["prediction"] for r in predict(seen).collect()}
    assert total == pytest.approx(want, rel=1e-9)
    scores = E.permutation_importance(test, names, predict, 3)
    assert scores.where("importance > 0").count() == 4


def test_selection_keeps_useful_features(featured):
    from seriesloom.operators import importance as IM

    df = featured.withColumn("noise", F.pmod(F.xxhash64("date"), F.lit(1000)).cast("double")).drop("is_future")
    scores = IM.normalise(IM.importance(df, ["Correlation", "PPS"], ["time_trend", "noise", "lag12"]))
    out = IM.select_features(df, scores, {"Correlation": 0.6, "PPS": 0.6}, 12)
    assert "noise" not in out["data"].columns and "time_trend" in out["data"].columns
    assert out["future_data"].count() == 24 and out["data"].where("value IS NULL").count() == 0
