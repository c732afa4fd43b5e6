"""Feature importance and selection."""

from pyspark.sql import functions as F

from seriesloom.catalog.models import FEATURES, feature_panel
from seriesloom.catalog.registry import ORDERS_M, SHIP_M, orders_monthly, query, ship_monthly, with_sql
from seriesloom.operators import importance as IM
from seriesloom.operators import panel as P
from seriesloom.operators import reshape as R


def simple_features(panel):
    return panel.withColumns({
        "month": F.month("date"), "time_trend": F.row_number().over(P.by_date()),
        "lag12": F.lag("value", 12).over(P.by_date())})


CORR_SQL = """
fe AS (SELECT id, date, value, CAST(month(date) AS DOUBLE) AS month,
  CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS DOUBLE) AS time_trend,
  lag(value, 12) OVER (PARTITION BY id ORDER BY date) AS lag12 FROM p),
lo AS (SELECT id, variable, value, x FROM (SELECT * FROM fe WHERE lag12 IS NOT NULL) UNPIVOT (x FOR variable IN
  (month, time_trend, lag12))),
rk AS (SELECT id, variable,
  rank() OVER (PARTITION BY id, variable ORDER BY x) + (count(*) OVER (PARTITION BY id, variable, x) - 1) / 2 AS a,
  rank() OVER (PARTITION BY id, variable ORDER BY value) + (count(*) OVER (PARTITION BY id, variable, value) - 1) / 2
  AS b FROM lo),
co AS (SELECT id, variable, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS importance FROM rk
  GROUP BY 1, 2 HAVING sqrt(var_pop(a) * var_pop(b)) > 0)"""


@query("rank_correlation", "O-96", with_sql(SHIP_M, CORR_SQL, """
SELECT id, variable, round(importance, 7) AS importance, 'Correlation' AS type FROM co
WHERE abs(importance) > 1e-12"""))
def rank_correlation(spark, sf):
    out = IM.correlations(simple_features(ship_monthly(spark, sf)), ["month", "time_trend", "lag12"])
    return R.round_numeric(out, 7)


@query("correlation_matrix", "O-96", with_sql(ORDERS_M, """
fe AS (SELECT id, value, CAST(month(date) AS DOUBLE) AS month, lag(value, 12) OVER (PARTITION BY id ORDER BY date) AS lag12
  FROM p)""", """
rk AS (SELECT id, rank() OVER (PARTITION BY id ORDER BY value) + (count(*) OVER (PARTITION BY id, value) - 1) / 2 AS value,
  rank() OVER (PARTITION BY id ORDER BY month) + (count(*) OVER (PARTITION BY id, month) - 1) / 2 AS month,
  rank() OVER (PARTITION BY id ORDER BY lag12) + (count(*) OVER (PARTITION BY id, lag12) - 1) / 2 AS lag12
  FROM fe WHERE lag12 IS NOT NULL)""", """
c AS (SELECT id, corr(value, month) AS vm, corr(value, lag12) AS vl, corr(month, lag12) AS ml FROM rk GROUP BY id)""",
"""
SELECT id, unnest(['value', 'value', 'value', 'month', 'month', 'month', 'lag12', 'lag12', 'lag12']) AS var_x,
  unnest(['value', 'month', 'lag12', 'value', 'month', 'lag12', 'value', 'month', 'lag12']) AS var_y,
  round(unnest([1.0::DOUBLE, vm, vl, vm, 1.0::DOUBLE, ml, vl, ml, 1.0::DOUBLE]), 7) AS corr FROM c"""))
def correlation_matrix(spark, sf):
    df = simple_features(orders_monthly(spark, sf))
    return R.round_numeric(IM.correlation_matrix(df, ["month", "lag12"]), 7)


def history(spark, sf):
    return feature_panel(spark, sf).where("NOT is_future").drop("is_future")


@query("predictive_power", "O-97")
def predictive_power(spark, sf):
    return IM.predictive_power(history(spark, sf), list(FEATURES))


@query("lasso_importance", "O-98")
def lasso_importance(spark, sf):
    return IM.lasso(history(spark, sf), list(FEATURES))


@query("lasso_single_feature", "O-98", with_sql(ORDERS_M, """
t AS (SELECT id, value, CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS DOUBLE) AS t FROM p)""", """
s AS (SELECT id, stddev_pop(value) AS sy, stddev_pop(t) AS st, corr(value, t) AS r FROM t GROUP BY id)""", """
SELECT id, 'time_trend' AS variable, round(sign(r) * greatest(abs(r) - 1000.0::DOUBLE / sy, 0) * sy / st, 2)
  AS importance, 'LASSO' AS type FROM s WHERE abs(r) > 1000.0::DOUBLE / sy"""))
def lasso_single_feature(spark, sf):
    df = orders_monthly(spark, sf).withColumn("time_trend", F.row_number().over(P.by_date()))
    return R.round_numeric(IM.lasso(df, ["time_trend"], penalty=1000.0), 2)


@query("forest_importance", "O-99")
def forest_importance(spark, sf):
    return IM.forest(history(spark, sf), list(FEATURES))


@query("combined_importance", "O-100")
def combined_importance(spark, sf):
    return IM.importance(history(spark, sf), ["Correlation", "PPS", "LASSO", "Random Forest"], list(FEATURES))


# Two importance types whose scores SQL can build: rank correlation, and ten times its absolute value as LASSO.
TWO_SQL = """
im AS (SELECT id, variable, importance, 'Correlation' AS type FROM co WHERE abs(importance) > 1e-12 UNION ALL
  SELECT id, variable, -10 * importance, 'LASSO' FROM co WHERE abs(importance) > 1e-12)"""
NORM_SQL = """
no AS (SELECT id, variable, CASE type WHEN 'Correlation' THEN abs(importance)
  ELSE abs(importance) / max(abs(importance)) OVER (PARTITION BY id, type) END AS importance, type FROM im)"""


def two_types(spark, sf):
    corr = IM.correlations(simple_features(ship_monthly(spark, sf)), ["month", "time_trend", "lag12"])
    other = corr.withColumn("importance", -10 * F.col("importance")).withColumn("type", F.lit("LASSO"))
    return corr.unionByName(other)


@query("normalised_importance", "O-101", with_sql(SHIP_M, CORR_SQL, TWO_SQL, NORM_SQL, """
SELECT id, variable, round(importance, 7) AS importance, type FROM no"""))
def normalised_importance(spark, sf):
    return R.round_numeric(IM.normalise(two_types(spark, sf)), 7)


LIMITS = {"Correlation": 0.3, "PPS": 0.1, "LASSO": 0.5, "Random Forest": 0.1}


@query("importance_filter", "O-14", with_sql(SHIP_M, CORR_SQL, TWO_SQL, NORM_SQL, """
SELECT id, variable, round(importance, 9) AS importance, type FROM no WHERE (type = 'Correlation'
  AND round(importance, 9) >= 0.3) OR (type = 'LASSO' AND round(importance, 9) >= 0.5)"""))
def importance_filter(spark, sf):
    scores = R.round_numeric(IM.normalise(two_types(spark, sf)), 9)
    return IM.keep_important(scores, LIMITS)


@query("selection_summary", "O-102 O-42", with_sql(SHIP_M, CORR_SQL, TWO_SQL, NORM_SQL, """
ke AS (SELECT id, variable, round(importance, 9) AS importance, type FROM no WHERE (type = 'Correlation'
  AND round(importance, 9) >= 0.3) OR (type = 'LASSO' AND round(importance, 9) >= 0.5))""", """
SELECT id, variable, count(*) AS n_methods, round(avg(importance), 6) AS average_importance,
  string_agg(type, ', ' ORDER BY type) AS methods FROM ke GROUP BY id, variable"""))
def selection_summary(spark, sf):
    scores = R.round_numeric(IM.normalise(two_types(spark, sf)), 9)
    return IM.selection_summary(IM.keep_important(scores, LIMITS), 6)


def chosen(spark, sf):
    df = feature_panel(spark, sf).drop("is_future")
    scores = IM.normalise(IM.importance(df, ["Correlation", "LASSO"], list(FEATURES)))
    return IM.select_features(df, scores, {"Correlation": 0.2, "LASSO": 0.2}, 12)


@query("selected_features", "O-102 O-40")
def selected_features(spark, sf):
    return chosen(spark, sf)["data"]


@query("selected_future_features", "O-102 O-40")
def selected_future_features(spark, sf):
    return chosen(spark, sf)["future_data"]
