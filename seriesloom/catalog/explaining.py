"""Explaining models on the hold-out rows."""

from pyspark.sql import functions as F

from seriesloom.catalog.models import feature_model_frame, run_sql
from seriesloom.catalog.registry import ORDERS_M, query, with_sql
from seriesloom.operators import explain as X
from seriesloom.operators import reshape as R
from seriesloom.operators.frames import Context
from seriesloom.operators.models.store import fit_models, load_models, predictor, save_models
from seriesloom.session import scratch_path

FEATURES = ["time_trend", "month", "lag12"]
OBSERVED = "2001-02-01"


def parts(spark, sf):
    """Test rows, training rows and a linear model per id fitted on the training rows."""
    frame = feature_model_frame(spark, sf)
    test, train = X.prepared(frame, FEATURES), X.prepared(frame, FEATURES, "train")
    return frame, test, X.linear_model(train.na.drop(), FEATURES)


@query("explain_rows", "O-138", with_sql(*run_sql(ORDERS_M, 12, 12), """
SELECT id, date, actual, CAST(t AS INTEGER) AS time_trend, CAST(month(date) AS INTEGER) AS month FROM fr
WHERE run = 'test' AND ahead"""))
def explain_rows(spark, sf):
    return X.prepared(feature_model_frame(spark, sf), ["time_trend", "month"])


@query("explain_observation", "O-139", with_sql(*run_sql(ORDERS_M, 12, 12), f"""
SELECT id, date, actual, CAST(t AS INTEGER) AS time_trend, CAST(month(date) AS INTEGER) AS month FROM fr
WHERE run = 'test' AND ahead AND date = TIMESTAMP '{OBSERVED}'"""))
def explain_observation(spark, sf):
    return X.observation(feature_model_frame(spark, sf), OBSERVED, ["time_trend", "month"])


@query("explain_importance", "O-134")
def explain_importance(spark, sf):
    _, test, predict = parts(spark, sf)
    return X.permutation_importance(test, FEATURES, predict)


# One-feature model: value on the position in the series, so that SQL can follow.
TREND_SQL = """
r AS (SELECT id, regr_slope(actual, t) AS b, regr_intercept(actual, t) AS a FROM fr WHERE run = 'test' AND NOT ahead
  GROUP BY id)"""


def trend_parts(spark, sf):
    frame = feature_model_frame(spark, sf)
    train = X.prepared(frame, ["time_trend"], "train")
    return X.prepared(frame, ["time_trend"]), X.linear_model(train, ["time_trend"]), frame


@query("explain_response", "O-135", with_sql(*run_sql(ORDERS_M, 12, 12), TREND_SQL, """
g AS (SELECT id, min(t) AS lo, max(t) AS hi FROM fr WHERE run = 'test' AND ahead GROUP BY id)""", """
SELECT g.id, CAST(k AS INTEGER) AS point, 'time_trend' AS variable, round(lo + (hi - lo) * k / 10.0::DOUBLE, 6) AS x,
  round(a + b * (lo + (hi - lo) * k / 10.0::DOUBLE), 1) AS prediction
FROM g JOIN r ON g.id = r.id, (SELECT unnest(range(0, 11)) AS k)"""))
def explain_response(spark, sf):
    test, predict, _ = trend_parts(spark, sf)
    out = X.partial_dependence(test, "time_trend", ["time_trend"], predict, 11)
    return out.select("id", "point", "variable", F.round("x", 6).alias("x"),
                      F.round("prediction", 1).alias("prediction"))


@query("explain_response_all", "O-135")
def explain_response_all(spark, sf):
    _, test, predict = parts(spark, sf)
    return R.stack(*[X.partial_dependence(test, f, FEATURES, predict, 21) for f in FEATURES])


@query("explain_break_down", "O-136")
def explain_break_down(spark, sf):
    frame, test, predict = parts(spark, sf)
    return X.break_down(test, X.observation(frame, OBSERVED, FEATURES), FEATURES, predict)


@query("explain_break_down_trend", "O-136", with_sql(*run_sql(ORDERS_M, 12, 12), TREND_SQL, f"""
m AS (SELECT fr.id, avg(a + b * t) AS base, max(CASE WHEN date = TIMESTAMP '{OBSERVED}' THEN a + b * t END) AS full_value
  FROM fr JOIN r ON fr.id = r.id WHERE run = 'test' AND ahead GROUP BY fr.id)""", """
SELECT id, 0 AS step, 'intercept' AS variable, round(base, 1) AS contribution, round(base, 1) AS cumulative FROM m
UNION ALL SELECT id, 1, 'time_trend', round(full_value - base, 1), round(full_value, 1) FROM m"""))
def explain_break_down_trend(spark, sf):
    test, predict, frame = trend_parts(spark, sf)
    return R.round_numeric(X.break_down(test, X.observation(frame, OBSERVED, ["time_trend"]), ["time_trend"], predict), 1)


@query("explain_stability", "O-137")
def explain_stability(spark, sf):
    frame, test, predict = parts(spark, sf)
    return X.local_stability(test, X.observation(frame, OBSERVED, FEATURES), FEATURES, predict)


@query("explain_neighbour_profiles", "O-137")
def explain_neighbour_profiles(spark, sf):
    frame, test, predict = parts(spark, sf)
    return X.neighbour_profiles(test, X.observation(frame, OBSERVED, FEATURES), "month", FEATURES, predict)


# Methods by name, from their stored form.
NAMED = ["Elastic Net", "MARS", "KNN", "Feed-Forward"]


def stored(spark, sf, methods, features):
    """Test rows, and a prediction function for each method, read from models that were fitted on the training rows."""
    frame = feature_model_frame(spark, sf)
    folder = scratch_path(spark, "models")
    save_models(fit_models(frame, methods, Context(12, tuple(features)), {"Elastic Net": {"penalty": 0.1}}, run="test"), folder)
    return X.prepared(frame, features), {m: predictor(load_models(spark, folder, [m]), m) for m in methods}, frame


@query("explain_importance_by_name", "O-134 O-138 O-126")
def explain_importance_by_name(spark, sf):
    test, named, _ = stored(spark, sf, NAMED, FEATURES)
    return R.stack(*[X.permutation_importance(test, FEATURES, p).withColumn("method", F.lit(m)) for m, p in named.items()])


@query("explain_break_down_by_name", "O-136 O-126")
def explain_break_down_by_name(spark, sf):
    test, named, frame = stored(spark, sf, NAMED, FEATURES)
    chosen = X.observation(frame, OBSERVED, FEATURES)
    return R.stack(*[X.break_down(test, chosen, FEATURES, p).withColumn("method", F.lit(m)) for m, p in named.items()])


@query("explain_response_by_name", "O-135 O-126", with_sql(*run_sql(ORDERS_M, 12, 12), TREND_SQL, """
g AS (SELECT id, min(t) AS lo, max(t) AS hi FROM fr WHERE run = 'test' AND ahead GROUP BY id)""", """
SELECT g.id, CAST(k AS INTEGER) AS point, 'time_trend' AS variable, round(lo + (hi - lo) * k / 10.0::DOUBLE, 6) AS x,
  round(a + b * (lo + (hi - lo) * k / 10.0::DOUBLE), 3) AS prediction
FROM g JOIN r ON g.id = r.id, (SELECT unnest(range(0, 11)) AS k)"""))
def explain_response_by_name(spark, sf):
    """A stored regression on the position alone, which SQL can follow."""
    test, named, _ = stored(spark, sf, ["Linear Regression"], ["time_trend"])
    out = X.partial_dependence(test, "time_trend", ["time_trend"], named["Linear Regression"], 11)
    return out.withColumn("x", F.round("x", 6)).withColumn("prediction", F.round("prediction", 3))


@query("explain_stability_by_name", "O-137 O-126")
def explain_stability_by_name(spark, sf):
    """The 50 training rows nearest to the observation (the operator's own number)."""
    _, named, frame = stored(spark, sf, ["Elastic Net", "MARS"], FEATURES)
    train = X.prepared(frame, FEATURES, "train").na.drop()
    chosen = X.observation(frame, OBSERVED, FEATURES)
    return R.stack(*[X.local_stability(train, chosen, FEATURES, p).withColumn("method", F.lit(m)) for m, p in named.items()])
