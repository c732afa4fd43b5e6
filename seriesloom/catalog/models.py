"""Forecast models on whole panels."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import ORDERS_M, SHIP_M, orders_monthly, query, ship_monthly, table, with_sql
from seriesloom.constants import default_params
from seriesloom.operators import frames as M
from seriesloom.operators import panel as P
from seriesloom.operators import reshape as R
from seriesloom.operators.features import append_future
from seriesloom.operators.linear import features_array, grouped_ols
from seriesloom.operators.models import arima, simple, smoothing
from seriesloom.operators.models.registry import fit_predict, fitted_parameters
from seriesloom.operators.models.store import STATES, fit_models, load_models, save_models, score
from seriesloom.session import scratch_path

CTX = M.Context(12)


def frame_of(panel, n_assess=12, n_future=12, grain="month"):
    return M.model_frame(append_future(panel, n_future, grain), M.standard_runs(n_assess, n_future))


def run_sql(base, n_assess, n_future):
    """Test and future run of a monthly panel in SQL."""
    return [base, f"""
f AS (SELECT id, date, value, false AS fut FROM p UNION ALL SELECT id, unnest(generate_series(max(date)
  + INTERVAL 1 MONTH, max(date) + INTERVAL {n_future} MONTH, INTERVAL 1 MONTH)) AS date, NULL, true FROM p
  GROUP BY id)""", """
tt AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS t,
  count(*) FILTER (NOT fut) OVER (PARTITION BY id) AS n FROM f)""", f"""
fr AS (SELECT id, run, date, t, n - cut AS nf, t > n - cut AS ahead, greatest(t - (n - cut), 0) AS h,
  CASE WHEN t <= n - cut THEN value END AS y, value AS actual
  FROM tt, (VALUES ('test', {n_assess}, {n_assess}), ('future', 0, {n_future})) r(run, cut, len)
  WHERE t <= n - cut + len)"""]


def out(df, digits=4):
    return df.select("id", "run", "date", "ahead", F.round("prediction", digits).alias("prediction"))


@query("model_naive", "O-104", with_sql(*run_sql(SHIP_M, 6, 6), """
SELECT id, run, date, ahead, round(last_value(y IGNORE NULLS) OVER (PARTITION BY id, run ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS prediction FROM fr"""))
def model_naive(spark, sf):
    return out(simple.naive(frame_of(ship_monthly(spark, sf), 6, 6), CTX, {}))


@query("model_seasonal_naive", "O-105", with_sql(*run_sql(SHIP_M, 6, 6), """
w AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY id, run, t % 12 ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same, last_value(y IGNORE NULLS) OVER (PARTITION BY id, run
  ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fr)""", """
SELECT id, run, date, ahead, round(CASE WHEN ahead THEN coalesce(same, prev) ELSE same END, 4) AS prediction
FROM w"""))
def model_seasonal_naive(spark, sf):
    return out(simple.seasonal_naive(frame_of(ship_monthly(spark, sf), 6, 6), CTX, {}))


@query("model_rolling_average", "O-106", with_sql(*run_sql(SHIP_M, 6, 6), """
w AS (SELECT *, avg(y) OVER (PARTITION BY id, run ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS tr,
  avg(CASE WHEN t > nf - 12 THEN y END) OVER (PARTITION BY id, run) AS held FROM fr)""", """
SELECT id, run, date, ahead, round(CASE WHEN ahead THEN held ELSE tr END, 6) AS prediction FROM w"""))
def model_rolling_average(spark, sf):
    return out(simple.rolling_average(
        frame_of(ship_monthly(spark, sf), 6, 6), CTX, default_params("Rolling Average")), 6)


@query("model_exponential_smoothing", "O-107", with_sql(*run_sql(SHIP_M, 6, 6), """
l AS (SELECT id, run, list_reduce(list(y ORDER BY date) FILTER (y IS NOT NULL), lambda a, x: a) AS y1,
  list_reduce(list([y] ORDER BY date) FILTER (y IS NOT NULL), lambda a, x: list_append(a,
    a[len(a)] * 0.8::DOUBLE + x[1] * 0.2::DOUBLE)) AS ls FROM fr GROUP BY id, run HAVING count(y) >= 2)""", """
SELECT fr.id, fr.run, date, ahead, round(CASE WHEN ahead THEN ls[len(ls)] WHEN t = 1 THEN ls[1] ELSE ls[t - 1] END, 6)
  AS prediction FROM fr LEFT JOIN l ON fr.id = l.id AND fr.run = l.run"""))
def model_exponential_smoothing(spark, sf):
    params = default_params("ETS", {"auto_ets": False, "smooth_level": 0.2})
    return out(smoothing.ets(frame_of(ship_monthly(spark, sf), 6, 6), CTX, params), 6)


@query("model_holt_linear", "O-107", with_sql(*run_sql(ORDERS_M, 12, 12), """
l AS (SELECT id, run, list(y ORDER BY date) FILTER (y IS NOT NULL) AS ys FROM fr GROUP BY id, run)""", """
s AS (SELECT id, run, list_reduce(list_transform(ys, lambda y: [y, 0.0::DOUBLE]), lambda a, x: list_concat(a, [
  0.3::DOUBLE * x[1] + 0.7::DOUBLE * (a[len(a) - 1] + a[len(a)]),
  0.1::DOUBLE * (0.3::DOUBLE * x[1] + 0.7::DOUBLE * (a[len(a) - 1] + a[len(a)]) - a[len(a) - 1]) + 0.9::DOUBLE * a[len(a)]]),
  [ys[1], (ys[12] - ys[1]) / 11]) AS st FROM l)""", """
SELECT fr.id, fr.run, date, ahead, round(CASE WHEN ahead THEN st[len(st) - 1] + h * st[len(st)]
  ELSE st[2 * t - 1] + st[2 * t] END, 4) AS prediction
FROM fr JOIN s ON fr.id = s.id AND fr.run = s.run"""))
def model_holt_linear(spark, sf):
    params = default_params("ETS", {
        "auto_ets": False, "trend": "additive", "smooth_level": 0.3, "smooth_trend": 0.1})
    return out(smoothing.ets(frame_of(orders_monthly(spark, sf)), CTX, params))


@query("model_ets_auto", "O-107")
def model_ets_auto(spark, sf):
    return out(smoothing.ets(frame_of(ship_monthly(spark, sf)), CTX, default_params("ETS")))


@query("model_ets_multiplicative", "O-107")
def model_ets_multiplicative(spark, sf):
    params = default_params("ETS", {
        "auto_ets": False, "error": "multiplicative", "trend": "multiplicative", "season": "multiplicative",
        "damping": "damped", "smooth_level": 0.2, "smooth_trend": 0.05, "smooth_season": 0.1})
    return out(smoothing.ets(frame_of(orders_monthly(spark, sf)), CTX, params))


@query("model_theta", "O-108")
def model_theta(spark, sf):
    return out(smoothing.theta(frame_of(ship_monthly(spark, sf)), CTX, {}))


@query("model_arima_auto", "O-109")
def model_arima_auto(spark, sf):
    return out(arima.sarima(frame_of(orders_monthly(spark, sf)), CTX, default_params("SARIMA")))


@query("model_arima_fixed", "O-109", with_sql(*run_sql(SHIP_M, 6, 6), """
d AS (SELECT *, y - lag(y) OVER (PARTITION BY id, run ORDER BY date) AS z FROM fr)""", """
x AS (SELECT *, lag(z) OVER (PARTITION BY id, run ORDER BY date) AS z1, lag(y) OVER (PARTITION BY id, run ORDER BY date) AS y1
  FROM d)""", """
r AS (SELECT id, run, count(z1) AS k, coalesce(var_pop(z1), 0) AS v, avg(z) FILTER (z1 IS NOT NULL) AS mz, avg(z1) AS mz1,
  regr_slope(z, z1) AS slope, regr_intercept(z, z1) AS icept FROM x WHERE NOT ahead GROUP BY id, run)""", """
c AS (SELECT id, run, CASE WHEN k = 0 THEN 0 WHEN v > 0 THEN slope WHEN mz1 = 0 THEN 0 ELSE mz / (2 * mz1) END AS b,
  CASE WHEN k = 0 THEN 0 WHEN v > 0 THEN icept WHEN mz1 = 0 THEN mz ELSE mz / 2 END AS a FROM r)""", """
la AS (SELECT id, run, y AS y0, coalesce(z, 0) AS z0 FROM x WHERE NOT ahead QUALIFY row_number() OVER (PARTITION BY id, run
  ORDER BY date DESC) = 1)""", """
SELECT x.id, x.run, x.date, x.ahead, round(CASE WHEN NOT ahead THEN y1 + a + b * z1 ELSE y0 + list_sum(list_transform(
  range(1, h + 1), lambda j: pow(b, j) * z0 + a * CASE WHEN b = 1 THEN j ELSE (1 - pow(b, j)) / (1 - b) END)) END, 4)
  AS prediction
FROM x LEFT JOIN c ON x.id = c.id AND x.run = c.run LEFT JOIN la ON la.id = x.id AND la.run = x.run"""))
def model_arima_fixed(spark, sf):
    """Every horizon and every fitted row; series without enough rows get the shortest coefficients that fit."""
    params = default_params("SARIMA", {"auto_arima": False, "non_seasonal_ar": 1, "non_seasonal_differences": 1})
    return out(arima.sarima(frame_of(ship_monthly(spark, sf), 6, 6), M.Context(1), params))


@query("model_decompose_arima", "O-111")
def model_decompose_arima(spark, sf):
    params = default_params("STLM", {"trend_model": "ARIMA"})
    return out(smoothing.decompose_then(frame_of(orders_monthly(spark, sf)), CTX, params))


@query("parameters_ets", "O-127")
def parameters_ets(spark, sf):
    return smoothing.ets_parameters(frame_of(orders_monthly(spark, sf)), CTX, default_params("ETS"))


@query("parameters_arima", "O-127")
def parameters_arima(spark, sf):
    params = arima.sarima_parameters(frame_of(orders_monthly(spark, sf)), CTX, default_params("SARIMA"))
    return params.select("id", "run", "d", "seasonal_d", F.explode("coefficients").alias("term", "value"), "aicc")


# One row leaves a line open: the shortest coefficients in units of the columns split its value between both.
LINE_SQL = """
r AS (SELECT id, run, count(y) AS n, CASE WHEN count(y) = 1 THEN avg(y) / 2 / avg(t) ELSE regr_slope(y, t) END AS b,
  CASE WHEN count(y) = 1 THEN avg(y) / 2 ELSE regr_intercept(y, t) END AS a FROM fr WHERE NOT ahead GROUP BY id, run)"""


@query("parameters_linear", "O-127 O-113", with_sql(*run_sql(SHIP_M, 6, 6), LINE_SQL, """
SELECT id, run, round(a, 6) AS intercept, round(b, 6) AS slope, n FROM r WHERE n > 0"""))
def parameters_linear(spark, sf):
    frame = frame_of(ship_monthly(spark, sf), 6, 6).withColumn("trend", F.col("t").cast("double"))
    fit = grouped_ols(frame, M.RUN_KEYS, features_array(["trend"]), F.col("y"))
    return fit.select("id", "run", F.round(F.col("beta")[0], 6).alias("intercept"),
                      F.round(F.col("beta")[1], 6).alias("slope"), "n")


NET_SQL = """
s AS (SELECT id, run, avg(y) AS my, avg(t) AS mt, stddev_pop(y) AS sy, stddev_pop(t) AS st, corr(y, t) AS r FROM fr
  WHERE NOT ahead GROUP BY id, run),
b AS (SELECT *, sign(r) * greatest(abs(r) - 50000.0::DOUBLE / sy * 0.5, 0) / (1 + 50000.0::DOUBLE / sy * 0.5) * sy / st
  AS slope FROM s)"""


@query("model_elastic_net_trend", "O-114", with_sql(*run_sql(ORDERS_M, 12, 12), NET_SQL, """
SELECT fr.id, fr.run, date, ahead, round(my + slope * (t - mt), 0) AS prediction
FROM fr JOIN b ON fr.id = b.id AND fr.run = b.run"""))
def model_elastic_net_trend(spark, sf):
    frame = frame_of(orders_monthly(spark, sf)).withColumn("trend", F.col("t").cast("double"))
    return out(fit_predict(frame, "Elastic Net", M.Context(12, ("trend",)), {"penalty": 50000.0, "mixture": 0.5}), 0)


THETA_SQL = """
l AS (SELECT id, run, list(y ORDER BY date) FILTER (y IS NOT NULL) AS ys, regr_slope(y, t) AS slope FROM fr
  GROUP BY id, run),
g AS (SELECT id, run, ys, slope, k / 20.0::DOUBLE AS a FROM l, (SELECT unnest(range(1, 20)) AS k)),
fs AS (SELECT id, run, slope, a, list_reduce(list_transform(ys, lambda y: [y, 0.0::DOUBLE]), lambda s, x: [
  a * x[1] + (1 - a) * s[1], s[2] + (x[1] - s[1]) * (x[1] - s[1])]) AS st, ys FROM g),
be AS (SELECT *, list_reduce(list_transform(ys, lambda y: [y]), lambda s, x: list_append(s, a * x[1] + (1 - a) * s[len(s)]))
  AS ls FROM fs QUALIFY row_number() OVER (PARTITION BY id, run ORDER BY st[2]) = 1)"""


@query("model_theta_plain", "O-108", with_sql(*run_sql(ORDERS_M, 12, 12), THETA_SQL, """
SELECT fr.id, fr.run, date, ahead, round(CASE WHEN ahead THEN st[1] + slope / 2 * (h - 1 + 1 / a)
  WHEN t = 1 THEN ls[1] + slope / 2 ELSE ls[t - 1] + slope / 2 END, 3) AS prediction
FROM fr JOIN be ON fr.id = be.id AND fr.run = be.run"""))
def model_theta_plain(spark, sf):
    """Without a season the method is a fold and a slope, which SQL can follow."""
    return out(smoothing.theta(frame_of(orders_monthly(spark, sf)), M.Context(1), {}), 3)


def feature_panel(spark, sf, n_future=12):
    """Monthly orders with calendar, Fourier and lag features, future rows included."""
    from seriesloom.operators.features import FeatureParams, feature_frame

    params = FeatureParams(calendar=False, fourier_periods=[12], fourier_k=2, lags=[12])
    df = feature_frame(orders_monthly(spark, sf), params, n_future, "month")
    return df.withColumns({"time_trend": F.row_number().over(P.by_date()), "month": F.month("date")})


FEATURES = ("time_trend", "month", "sin12_K1", "cos12_K1", "sin12_K2", "cos12_K2", "lag12")
FCTX = M.Context(12, FEATURES)


def feature_model_frame(spark, sf):
    return M.model_frame(feature_panel(spark, sf), M.standard_runs(12, 12))


def _register(name, covers, method, params=None, sql=None):
    @query(name, covers, sql)
    def run(spark, sf):
        return out(fit_predict(feature_model_frame(spark, sf), method, FCTX, params))


KNN_SQL = with_sql(*run_sql(ORDERS_M, 12, 12), """
x AS (SELECT *, CAST(month(date) AS DOUBLE) AS m, CAST(t AS DOUBLE) AS tt FROM fr)""", """
s AS (SELECT *, (m - avg(CASE WHEN NOT ahead THEN m END) OVER w) / stddev_samp(CASE WHEN NOT ahead THEN m END) OVER w
  AS a, (tt - avg(CASE WHEN NOT ahead THEN tt END) OVER w) / stddev_samp(CASE WHEN NOT ahead THEN tt END) OVER w AS b
  FROM x WINDOW w AS (PARTITION BY id, run))""", """
d AS (SELECT p.id, p.run, p.date, k.y, round(sqrt((p.a - k.a) * (p.a - k.a) + (p.b - k.b) * (p.b - k.b)), 12) AS dist,
  row_number() OVER (PARTITION BY p.id, p.run, p.date ORDER BY round(sqrt((p.a - k.a) * (p.a - k.a)
    + (p.b - k.b) * (p.b - k.b)), 12), k.t) AS place
  FROM s p JOIN s k ON p.id = k.id AND p.run = k.run AND p.t <> k.t AND NOT k.ahead)""", """
g AS (SELECT id, run, date, sum(y / (dist + 1e-6::DOUBLE)) / sum(1 / (dist + 1e-6::DOUBLE)) AS v
  FROM d WHERE place <= 5 GROUP BY id, run, date)""", """
SELECT fr.id, fr.run, fr.date, fr.ahead, round(v, 3) AS prediction
FROM fr LEFT JOIN g ON fr.id = g.id AND fr.run = g.run AND fr.date = g.date""")


@query("model_neighbours", "O-116", KNN_SQL)
def model_neighbours(spark, sf):
    """Fitted rows by leaving each out, and the rows ahead."""
    return out(fit_predict(feature_model_frame(spark, sf), "KNN", M.Context(12, ("month", "time_trend"))), 3)


@query("model_linear_trend", "O-113 O-103", with_sql(*run_sql(SHIP_M, 6, 6), LINE_SQL, """
SELECT fr.id, fr.run, date, ahead, round(coalesce(a + b * t, 0), 5) AS prediction FROM fr LEFT JOIN r ON fr.id = r.id
  AND fr.run = r.run"""))
def model_linear_trend(spark, sf):
    """All series; without a known row the coefficients are zero."""
    frame = frame_of(ship_monthly(spark, sf), 6, 6).withColumn("trend", F.col("t").cast("double"))
    return out(fit_predict(frame, "Linear Regression", M.Context(12, ("trend",))), 5)


@query("grouped_least_squares", "O-103", """
SELECT l_returnflag AS id, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_slope(l_extendedprice, l_quantity), 5) AS slope FROM lineitem GROUP BY 1""")
def grouped_least_squares(spark, sf):
    df = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "id")
    fit = grouped_ols(df, ["id"], features_array(["l_quantity"]), F.col("l_extendedprice"))
    return fit.select("id", "n", F.round(F.col("beta")[0], 4).alias("intercept"),
                      F.round(F.col("beta")[1], 5).alias("slope"))


@query("parameters_by_method", "O-127")
def parameters_by_method(spark, sf):
    frame = feature_model_frame(spark, sf)
    """Every method that has a stored form, for every run."""
    parts = [fitted_parameters(frame, m, FCTX).withColumn("method", F.lit(m)) for m in STATES]
    return R.stack(*parts)


STORED = ("Naive", "Seasonal Naive", "Rolling Average", "Linear Regression")


@query("stored_models", "O-126 O-133 O-154", with_sql(*run_sql(SHIP_M, 6, 6), """
k AS (SELECT id, avg(y) AS my, avg(t) AS mt, count(y) AS k, CASE WHEN count(y) = 1 THEN avg(y) / 2 / avg(t)
    ELSE regr_slope(y, t) END AS b, arg_max(y, t) AS last, avg(y) FILTER (t > nf - 12) AS mean
  FROM fr WHERE run = 'future' AND NOT ahead GROUP BY id)""", """
c AS (SELECT *, CASE WHEN k = 1 THEN my / 2 ELSE my - b * mt END AS a FROM k)""", """
s AS (SELECT id, t % 12 AS phase, arg_max(y, t) AS same FROM fr WHERE run = 'future' AND NOT ahead GROUP BY 1, 2)""", """
u AS (SELECT fr.id, fr.date, fr.t, fr.h, c.*, s.same FROM fr JOIN c ON fr.id = c.id
  LEFT JOIN s ON fr.id = s.id AND fr.t % 12 = s.phase WHERE fr.run = 'future' AND fr.ahead)""", """
SELECT id, date, method, 'v1' AS version, CAST(t AS INTEGER) AS t, CAST(h AS INTEGER) AS h, round(prediction, 5) AS prediction
FROM (SELECT id, date, t, h, unnest(['Naive', 'Seasonal Naive', 'Rolling Average', 'Linear Regression']) AS method,
  unnest([last, coalesce(same, last), mean, a + b * t]) AS prediction FROM u)"""))
def stored_models(spark, sf):
    """Models are fitted on the known rows, saved, loaded again and scored on rows that they have not seen."""
    trend = ("trend",)
    panel = append_future(ship_monthly(spark, sf), 6, "month")
    frame = M.model_frame(panel, M.standard_runs(6, 6)[1:]).withColumn("trend", F.col("t").cast("double"))
    folder = scratch_path(spark, "models")
    models = fit_models(frame.where("NOT ahead"), list(STORED), M.Context(12, trend), version="v1")
    save_models(models, folder)
    rows = frame.where("run = 'future' AND ahead").select("id", "date", *trend)
    scored = score(load_models(spark, folder, version="v1"), rows).drop(*trend)
    return scored.withColumn("prediction", F.round("prediction", 5))


@query("stored_features", "O-126 O-133 O-27")
def stored_features(spark, sf):
    """Every stored method that looks at features or steps through time, scored from its saved form."""
    panel = feature_panel(spark, sf)
    folder = scratch_path(spark, "models")
    save_models(fit_models(M.model_frame(panel, M.standard_runs(12, 12)), list(STATES), FCTX), folder)
    return score(load_models(spark, folder), panel.where("is_future").select("id", "date", *FEATURES))


_register("model_automatic", "O-125", "H2O AutoML")
_register("model_linear_features", "O-113", "Linear Regression")
_register("model_elastic_net", "O-114", "Elastic Net")
_register("model_hinge_basis", "O-115", "MARS")
_register("model_support_vector", "O-117", "SVM")
_register("model_support_vector_radial", "O-117", "SVM", {"boundary": "Radial"})
_register("model_random_forest", "O-118", "Random Forest")
_register("model_boosted_trees", "O-119", "Boosted Trees")
_register("model_leaf_linear", "O-120", "Cubist", {"committees": 2})
_register("model_feed_forward", "O-121", "Feed-Forward")
_register("model_feed_forward_ar", "O-122", "Feed-Forward AR", {"ffar_non_seasonal_ar": 2, "ffar_seasonal_ar": 1})
_register("model_arima_boost", "O-123", "ARIMA-Boost")
_register("model_changepoint_boost", "O-124", "Prophet-Boost")
_register("model_several_seasons", "O-110", "TBATS")
_register("model_changepoints", "O-112", "Prophet")
_register("model_changepoints_logistic", "O-112", "Prophet", {"growth": "logistic"})
_register("model_changepoints_multiplicative", "O-112", "Prophet", {"prophet_season": "multiplicative"})
_register("model_arima_with_regressors", "O-109", "SARIMA")


@query("boosted_single_split", "O-119", with_sql(*run_sql(ORDERS_M, 12, 12), """
c AS (SELECT a.id, a.run, a.t AS cut, avg(b.y) FILTER (b.t <= a.t) AS l, avg(b.y) FILTER (b.t > a.t) AS r,
  count(*) FILTER (b.t <= a.t) AS nl, count(*) FILTER (b.t > a.t) AS nr
  FROM fr AS a JOIN fr AS b ON a.id = b.id AND a.run = b.run WHERE NOT a.ahead AND NOT b.ahead AND a.t < a.nf
  GROUP BY 1, 2, 3)""", """
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id, run
  ORDER BY (l - r) * (l - r) * nl * nr / (nl + nr) DESC, cut) = 1)""", """
SELECT fr.id, fr.run, date, ahead, round(CASE WHEN t <= cut THEN l ELSE r END, 0) AS prediction
FROM fr JOIN s ON fr.id = s.id AND fr.run = s.run"""))
def boosted_single_split(spark, sf):
    """One tree of one split at full rate: the best cut of the trend and the two means."""
    frame = frame_of(orders_monthly(spark, sf)).withColumn("trend", F.col("t").cast("double"))
    params = {"boost_trees": 1, "boost_tree_depth": 1, "boost_learn_rate": 1.0}
    return out(fit_predict(frame, "Boosted Trees", M.Context(12, ("trend",)), params), 0)
