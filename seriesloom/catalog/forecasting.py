"""Accuracy, intervals, ensembles, scenarios, tuning: the forecasting workflow on whole panels."""

from pyspark.sql import functions as F

from seriesloom.catalog.models import FCTX, feature_panel, frame_of, run_sql
from seriesloom.catalog.registry import ORDERS_M, SHIP_M, orders_monthly, query, ship_monthly, table, with_sql
from seriesloom.operators import accuracy as A
from seriesloom.operators import ensemble as E
from seriesloom.operators import frames as M
from seriesloom.operators import intervals as I
from seriesloom.operators import reshape as R
from seriesloom.operators import scenario as S
from seriesloom.operators.describe import autocorrelation
from seriesloom.operators.features import append_future
from seriesloom.operators.models.registry import fit_predict_all
from seriesloom.plans import forecast as FC
from seriesloom.plans import tuning as TU

SIMPLE = ["Naive", "Seasonal Naive", "Rolling Average"]
CTX = M.Context(12)


def simple_predictions(spark, sf, panel=orders_monthly, n=12):
    return fit_predict_all(frame_of(panel(spark, sf), n, n), SIMPLE, CTX)


def simple_sql(base, n=12):
    """CTE pr with the predictions of the three simple methods."""
    return run_sql(base, n, n) + ["""
w AS (SELECT *, last_value(y IGNORE NULLS) OVER prev AS nv, last_value(y IGNORE NULLS) OVER (PARTITION BY id, run,
  t % 12 ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same,
  avg(y) OVER (PARTITION BY id, run ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS tr,
  avg(CASE WHEN t > nf - 12 THEN y END) OVER (PARTITION BY id, run) AS held FROM fr
  WINDOW prev AS (PARTITION BY id, run ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", """
pr AS (SELECT id, run, date, h, ahead, actual, 'Naive' AS model_desc, nv AS prediction FROM w
  UNION ALL SELECT id, run, date, h, ahead, actual, 'Seasonal Naive', CASE WHEN ahead THEN coalesce(same, nv) ELSE same
  END FROM w UNION ALL SELECT id, run, date, h, ahead, actual, 'Rolling Average',
  CASE WHEN ahead THEN held ELSE tr END FROM w)"""]


ACC_SQL = """
aj AS (SELECT *, CASE WHEN ahead THEN 'Test' ELSE 'Train' END AS type FROM pr WHERE run = 'test'
  AND actual IS NOT NULL AND prediction IS NOT NULL),
st AS (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY id, model_desc, type ORDER BY date)) AS step FROM aj),
acc AS (SELECT id, model_desc, type, avg(prediction - actual) AS me, avg(abs(actual - prediction)) AS mae,
  avg(abs((actual - prediction) / nullif(actual, 0))) * 100 AS mape,
  avg(abs(actual - prediction)) / nullif(avg(step), 0) AS mase,
  avg(abs(prediction - actual) / nullif((abs(actual) + abs(prediction)) / 2, 0)) * 100 AS smape,
  sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse,
  sqrt(avg(pow((actual - prediction) / nullif(actual, 0), 2))) * 100 AS rmspe,
  CASE WHEN var_pop(actual) > 1e-12::DOUBLE * avg(actual * actual)
    AND var_pop(prediction) > 1e-12::DOUBLE * avg(prediction * prediction) THEN pow(corr(actual, prediction), 2) END AS rsq
  FROM st GROUP BY 1, 2, 3)"""


@query("accuracy_by_model", "O-84 O-85 O-86", with_sql(*simple_sql(ORDERS_M), ACC_SQL, """
SELECT id, model_desc, type, round(me, 1) AS me, round(mae, 1) AS mae, round(mape, 6) AS mape,
  round(mase, 6) AS mase, round(smape, 6) AS smape, round(rmse, 1) AS rmse, round(rmspe, 6) AS rmspe,
  round(rsq, 6) AS rsq FROM acc"""))
def accuracy_by_model(spark, sf):
    acc = FC.accuracy_of(simple_predictions(spark, sf))
    return acc.select("id", "model_desc", "type", *[F.round(m, 1 if m in ("me", "mae", "rmse") else 6).alias(m)
                                                    for m in A.ACCURACY])


@query("accuracy_many_series", "O-84", with_sql(*simple_sql(SHIP_M, 6), ACC_SQL, """
SELECT id, model_desc, type, round(me, 6) AS me, round(mae, 6) AS mae, round(mape, 6) AS mape,
  round(mase, 6) AS mase, round(smape, 6) AS smape, round(rmse, 6) AS rmse, round(rmspe, 6) AS rmspe, round(rsq, 6) AS rsq FROM acc"""))
def accuracy_many_series(spark, sf):
    return R.round_numeric(FC.accuracy_of(simple_predictions(spark, sf, ship_monthly, 6)), 6)


@query("metrics_by_name", "O-87", with_sql(*simple_sql(ORDERS_M), ACC_SQL, """
SELECT id, model_desc, round(mae, 1) AS mae, round(mape, 6) AS mape, round(mase, 6) AS mase, round(smape, 6) AS smape,
  round(rmse * rmse / 1e6, 1) AS mse, round(rmse, 1) AS rmse, round(rmspe, 6) AS rmspe FROM acc WHERE type = 'Test'"""))
def metrics_by_name(spark, sf):
    names = ["mae", "mape", "mase", "smape", "mse", "rmse", "rmspe"]
    every = A.accuracy_table(FC.calibration_of(simple_predictions(spark, sf)), ["id", "model_desc"], names)
    every = every.withColumn("mse", F.col("mse") / 1e6)
    return every.select("id", "model_desc", *[F.round(m, 1 if m in ("mae", "mse", "rmse") else 6).alias(m) for m in names])


@query("accuracy_report_single", "O-88 O-18", with_sql(*simple_sql(ORDERS_M), ACC_SQL, """
l AS (SELECT id, type, 'MAPE' AS m, round(mape, 2) AS v FROM acc WHERE model_desc = 'Seasonal Naive' UNION ALL
  SELECT id, type, 'SMAPE', round(smape, 2) FROM acc WHERE model_desc = 'Seasonal Naive' UNION ALL
  SELECT id, type, 'RMSPE', round(rmspe, 2) FROM acc WHERE model_desc = 'Seasonal Naive')""", """
SELECT id, 'Seasonal Naive' AS "Algorithm", m AS "Metric", max(v) FILTER (type = 'Train') AS "Train",
  max(v) FILTER (type = 'Test') AS "Test" FROM l GROUP BY id, m"""))
def accuracy_report_single(spark, sf):
    acc = FC.accuracy_of(simple_predictions(spark, sf).where("model_desc = 'Seasonal Naive'"),
                         metrics=["mape", "smape", "rmspe"])
    return A.accuracy_report(acc)


@query("accuracy_report_many", "O-88 O-149", with_sql(*simple_sql(ORDERS_M), ACC_SQL, """
SELECT id, model_desc AS "Algorithm", type AS "Type", round(mape, 2) AS "MAPE", round(smape, 2) AS "SMAPE"
FROM acc WHERE type = 'Test'"""))
def accuracy_report_many(spark, sf):
    acc = FC.accuracy_of(simple_predictions(spark, sf), metrics=["mape", "smape"])
    return A.accuracy_report(acc.where("type = 'Test'"), single_method=False)


@query("calibration_rows", "O-153", with_sql(*simple_sql(SHIP_M, 6), """
SELECT id, model_desc, date, actual, round(prediction, 6) AS prediction, round(actual - prediction, 6) AS residual
FROM pr WHERE run = 'test' AND ahead"""))
def calibration_rows(spark, sf):
    return R.round_numeric(FC.calibration_of(simple_predictions(spark, sf, ship_monthly, 6)), 6)


@query("residual_rows", "O-142", with_sql(*simple_sql(ORDERS_M), """
SELECT id, model_desc, date, CASE WHEN ahead THEN 'test' ELSE 'train' END AS split, actual,
  round(prediction, 3) AS prediction, round(actual - prediction, 3) AS residual FROM pr WHERE run = 'test'"""))
def residual_rows(spark, sf):
    out = FC.residuals_of(simple_predictions(spark, sf))
    return out.withColumn("prediction", F.round("prediction", 3)).withColumn("residual", F.round("residual", 3))


@query("residual_acf", "O-142 O-52")
def residual_acf(spark, sf):
    rows = FC.residuals_of(simple_predictions(spark, sf)).where("split = 'train'")
    return autocorrelation(rows, 24, "residual", ["id", "model_desc"])


@query("refit_all_rows", "O-154", with_sql(*simple_sql(SHIP_M, 6), """
SELECT id, model_desc, date, round(prediction, 6) AS prediction FROM pr WHERE run = 'future' AND ahead"""))
def refit_all_rows(spark, sf):
    preds = simple_predictions(spark, sf, ship_monthly, 6).where("run = 'future' AND ahead")
    return preds.select("id", "model_desc", "date", F.round("prediction", 6).alias("prediction"))


CONF_SQL = """
cw AS (SELECT id, model_desc, abs(actual - prediction) AS r, row_number() OVER (PARTITION BY id, model_desc
  ORDER BY abs(actual - prediction)) AS k, count(*) OVER (PARTITION BY id, model_desc) AS n FROM pr
  WHERE run = 'test' AND ahead AND prediction IS NOT NULL),
lv AS (SELECT unnest([0.8, 0.85, 0.9, 0.95])::DOUBLE AS conf_lvl),
hw AS (SELECT id, model_desc, conf_lvl, r AS half FROM cw JOIN lv
  ON k = greatest(1, ceil((n + 1) * conf_lvl - 1e-9::DOUBLE))),
fo AS (SELECT pr.id, pr.model_desc, 'prediction' AS key, pr.date, pr.h, prediction AS value, prediction - half AS conf_lo,
  prediction + half AS conf_hi, lv.conf_lvl FROM pr CROSS JOIN lv LEFT JOIN hw ON pr.id = hw.id
  AND pr.model_desc = hw.model_desc AND hw.conf_lvl = lv.conf_lvl WHERE run = 'future' AND ahead)"""


def simple_forecast(spark, sf, panel=orders_monthly, n=12, levels=(0.8, 0.85, 0.9, 0.95)):
    return FC.forecast(append_future(panel(spark, sf), n, "month"), SIMPLE, CTX, n, n, list(levels))


def shown(df, digits=1):
    return df.withColumn("conf_lvl", F.col("conf_lvl").cast("double")).withColumns(
        {c: F.round(c, digits) for c in ("value", "conf_lo", "conf_hi")})


@query("conformal_intervals", "O-140 O-32 O-141 O-133 O-126", with_sql(*simple_sql(ORDERS_M), CONF_SQL, """
SELECT id, model_desc, key, date, round(value, 4) AS value, round(conf_lo, 4) AS conf_lo,
  round(conf_hi, 4) AS conf_hi, conf_lvl FROM fo"""))
def conformal_intervals(spark, sf):
    rows = simple_forecast(spark, sf).oos_forecast.where("key = 'prediction'")
    return shown(rows.drop("model_id"), 4)


@query("conformal_many_series", "O-140", with_sql(*simple_sql(SHIP_M, 6), CONF_SQL, """
SELECT id, model_desc, key, date, round(value, 6) AS value, round(conf_lo, 6) AS conf_lo,
  round(conf_hi, 6) AS conf_hi, conf_lvl FROM fo"""))
def conformal_many_series(spark, sf):
    rows = simple_forecast(spark, sf, ship_monthly, 6).oos_forecast.where("key = 'prediction'")
    return shown(rows.drop("model_id"), 6)


@query("confidence_levels", "O-141", """
SELECT CAST(lv AS DOUBLE) AS conf_lvl, (SELECT count(*) FROM orders) AS n FROM
  (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9,
    0.95, 0.99]) AS lv)""")
def confidence_levels(spark, sf):
    total = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))
    return R.with_levels(total, R.levels_of(0.05, 0.99)).select(F.col("conf_lvl").cast("double").alias("conf_lvl"), "n")


ENS_SQL = """
rm AS (SELECT id, model_desc, sqrt(avg(pow(actual - prediction, 2))) AS rmse FROM pr WHERE run = 'test' AND ahead
  AND prediction IS NOT NULL AND actual IS NOT NULL GROUP BY 1, 2),
we AS (SELECT id, model_desc, CAST(rank() OVER (PARTITION BY id ORDER BY rmse DESC) AS DOUBLE) AS weight FROM rm),
en AS (SELECT pr.id, run, date, ahead, avg(prediction) AS a, median(prediction) AS m,
  sum(weight * prediction) / nullif(sum(CASE WHEN prediction IS NOT NULL THEN weight END), 0) AS wa
  FROM pr LEFT JOIN we ON pr.id = we.id AND pr.model_desc = we.model_desc GROUP BY 1, 2, 3, 4),
ens AS (SELECT id, run, date, ahead, 'Ens - Average' AS model_desc, a AS prediction FROM en UNION ALL
  SELECT id, run, date, ahead, 'Ens - Weighted Average', wa FROM en UNION ALL
  SELECT id, run, date, ahead, 'Ens - Median', m FROM en)"""

ENSEMBLES = ["Average", "Weighted Average", "Median"]


@query("ensemble_weights", "O-128", with_sql(*simple_sql(ORDERS_M), ENS_SQL, "SELECT * FROM we"))
def ensemble_weights(spark, sf):
    return E.rank_weights(simple_predictions(spark, sf))


@query("ensembles", "O-128", with_sql(*simple_sql(ORDERS_M), ENS_SQL, """
SELECT id, run, date, ahead, model_desc, round(prediction, 1) AS prediction FROM ens"""))
def ensembles(spark, sf):
    out = E.combine(simple_predictions(spark, sf), ENSEMBLES)
    return out.select("id", "run", "date", "ahead", "model_desc", F.round("prediction", 1).alias("prediction"))


@query("ensembles_many_series", "O-128", with_sql(*simple_sql(SHIP_M, 6), ENS_SQL, """
SELECT id, run, date, model_desc, round(prediction, 6) AS prediction FROM ens
WHERE ahead AND model_desc <> 'Ens - Weighted Average'"""))
def ensembles_many_series(spark, sf):
    ahead = simple_predictions(spark, sf, ship_monthly, 6).where("ahead")  # a row is combined on its own
    out = E.combine(ahead, ["Average", "Median"])
    return out.select("id", "run", "date", "model_desc", F.round("prediction", 6).alias("prediction"))


@query("ensembles_only", "O-147 O-15", with_sql(*simple_sql(ORDERS_M), ENS_SQL, """
SELECT id, model_desc, date, round(prediction, 1) AS value FROM ens WHERE run = 'future' AND ahead
UNION ALL SELECT id, 'ACTUAL', date, round(value, 1) FROM p"""))
def ensembles_only(spark, sf):
    panel = append_future(orders_monthly(spark, sf), 12, "month")
    result = FC.only_combinations(FC.forecast(panel, SIMPLE, CTX, 12, 12, [0.9], ensembles=ENSEMBLES))
    return result.oos_forecast.select("id", "model_desc", "date", F.round("value", 1).alias("value"))


@query("model_labels_filter", "O-15", with_sql(*simple_sql(ORDERS_M), """
SELECT id, date, model_desc, round(prediction, 1) AS prediction FROM pr
WHERE regexp_matches(model_desc, '^(Seasonal|Rolling) ') AND run = 'future' AND ahead"""))
def model_labels_filter(spark, sf):
    preds = R.keep_models(simple_predictions(spark, sf), "^(Seasonal|Rolling) ").where("run = 'future' AND ahead")
    return preds.select("id", "date", "model_desc", F.round("prediction", 1).alias("prediction"))


@query("candidate_models", "O-152", """
SELECT DISTINCT o_orderpriority AS id, CAST(i AS INTEGER) AS model_id, m AS model_desc FROM orders, (VALUES (1, 'Naive'),
  (2, 'Seasonal Naive'), (3, 'Rolling Average'), (4, 'Ens - Average'), (5, 'Ens - Median')) v(i, m)""")
def candidate_models(spark, sf):
    ids = priorities(spark, sf)
    return FC.merge_models(FC.model_table(ids, SIMPLE), FC.model_table(ids, ["Ens - Average", "Ens - Median"]))


@query("adjusted_forecast", "O-143", with_sql(*simple_sql(ORDERS_M), CONF_SQL, """
SELECT id, model_desc, key, date, round(value * 1.05, 4) AS value, round(conf_lo, 4) AS conf_lo,
  round(conf_hi, 4) AS conf_hi, conf_lvl FROM fo UNION ALL
SELECT id, 'ACTUAL', 'actual', date, round(value, 4), NULL, NULL, NULL FROM p"""))
def adjusted_forecast(spark, sf):
    return shown(S.adjust(simple_forecast(spark, sf).oos_forecast, 5.0).drop("model_id"), 4)


@query("widened_linear", "O-144", with_sql(*simple_sql(ORDERS_M), CONF_SQL, """
SELECT id, model_desc, key, date, round(value, 4) AS value, round(conf_lo - 1000.0 * (h - 1), 4) AS conf_lo,
  round(conf_hi + 1000.0 * (h - 1), 4) AS conf_hi, conf_lvl FROM fo"""))
def widened_linear(spark, sf):
    rows = I.widen(simple_forecast(spark, sf).oos_forecast.where("key = 'prediction'"), "linear", 1000.0)
    return shown(rows.drop("model_id"), 4)


@query("widened_exponential", "O-144", with_sql(*simple_sql(ORDERS_M), CONF_SQL, """
SELECT id, model_desc, key, date, round(value, 4) AS value, round(conf_lo - (pow(h, 4.5::DOUBLE) - 1), 4) AS conf_lo,
  round(conf_hi + pow(h, 4.5::DOUBLE) - 1, 4) AS conf_hi, conf_lvl FROM fo"""))
def widened_exponential(spark, sf):
    rows = I.widen(simple_forecast(spark, sf).oos_forecast.where("key = 'prediction'"), "exponential", 4.5)
    return shown(rows.drop("model_id"), 4)


def scenario_sql(fold, digits):
    return with_sql(*simple_sql(ORDERS_M), CONF_SQL, f"""
ah AS (SELECT id, model_desc, {fold}(value) AS mid, {fold}(conf_lo) AS lo, {fold}(conf_hi) AS hi,
  stddev_samp(value) AS sd FROM fo WHERE conf_lvl = 0.9 GROUP BY 1, 2)""", f"""
pv AS (SELECT id, {fold}(value) AS prev, stddev_samp(value) AS psd FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY date DESC) AS r FROM p) WHERE r <= 12 GROUP BY id)""", f"""
SELECT id, model_desc, CAST(line AS INTEGER) AS line, scenario, round(v, {digits}) AS value,
  round(s, 4) AS variability, round((CASE WHEN line > 1 THEN v END - prev) / prev * 100, 6) AS delta_pp FROM (
  SELECT ah.id, model_desc, prev, unnest([1, 2, 3, 4]) AS line,
    unnest(['Previous Period', 'Forecast', 'Worst Case', 'Best Case']) AS scenario,
    unnest([prev, mid, lo, hi]) AS v, unnest([psd, sd, sd, sd]) AS s FROM ah JOIN pv ON ah.id = pv.id)""")


def _scenario(how, digits=1):
    def run(spark, sf):
        out = S.aggregate(simple_forecast(spark, sf).oos_forecast, 12, 0.9, how)
        return out.withColumn("value", F.round("value", digits)).withColumn(
            "variability", F.round("variability", 4)).withColumn("delta_pp", F.round("delta_pp", 6))

    return run


query("scenario_aggregate", "O-145", scenario_sql("sum", 4))(_scenario("sum", 4))
query("scenario_mean", "O-145", scenario_sql("avg", 4))(_scenario("mean", 4))
query("scenario_median", "O-145", scenario_sql("median", 6))(_scenario("median", 6))


@query("scenario_values", "O-146", with_sql(*simple_sql(ORDERS_M), CONF_SQL, """
SELECT id, model_desc, date, round(conf_lo, 4) AS worst_case, round(value, 4) AS forecast,
  round(conf_hi, 4) AS best_case FROM fo WHERE conf_lvl = 0.9"""))
def scenario_values(spark, sf):
    return S.scenario_values(simple_forecast(spark, sf).oos_forecast, 0.9, 4)


# Workflows that SQL cannot express.


def priorities(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id")).distinct()


def features_with_future(spark, sf):
    return feature_panel(spark, sf)


@query("forecast_workflow", "O-133 O-126")
def forecast_workflow(spark, sf):
    result = FC.forecast(features_with_future(spark, sf), ["ETS", "Linear Regression", "Rolling Average"], FCTX, 24, 12,
                         [0.8, 0.9], ensembles=ENSEMBLES)
    return result.oos_forecast.select("id", "model_desc", "key", "date", "value", "conf_lo", "conf_hi", "conf_lvl")


@query("compare_methods", "O-149")
def compare_methods(spark, sf):
    result = FC.forecast(features_with_future(spark, sf), ["ETS", "SARIMA", "Elastic Net"], FCTX, 24, 12)
    return A.accuracy_report(result.accuracy.where("type = 'Test'"), single_method=False)


@query("stacked_models", "O-129")
def stacked_models(spark, sf):
    frame = M.model_frame(features_with_future(spark, sf), M.standard_runs(24, 12) + M.fold_runs(24, 5))
    members = ["Seasonal Naive", "Linear Regression", "KNN"]
    from seriesloom.operators.stacking import stack

    preds = fit_predict_all(frame, members, FCTX)
    out = stack(preds, members, ["Linear Regression", "Elastic Net"])
    return out.where("ahead").select("id", "run", "date", "model_desc", "prediction")


@query("stacked_single_member", "O-129", with_sql(*run_sql(ORDERS_M, 12, 12)[:-1], """
fr AS (SELECT id, run, date, t, n - cut AS nf, t > n - cut AS ahead, CASE WHEN t <= n - cut THEN value END AS y,
  value AS actual FROM tt, (VALUES ('test', 12, 12), ('future', 0, 12), ('fold1', 14, 2), ('fold2', 16, 2),
  ('fold3', 18, 2), ('fold4', 20, 2), ('fold5', 22, 2)) r(run, cut, len) WHERE t <= n - cut + len)""", """
w AS (SELECT *, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY id, run, t % 12 ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last_value(y IGNORE NULLS) OVER (PARTITION BY id, run
  ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS p1 FROM fr)""", """
r AS (SELECT id, regr_slope(actual, p1) AS b, regr_intercept(actual, p1) AS a FROM w
  WHERE run LIKE 'fold%' AND ahead GROUP BY id)""", """
SELECT w.id, run, date, 'Stk - Linear Regression' AS model_desc, round(a + b * p1, 0) AS prediction
FROM w JOIN r ON w.id = r.id WHERE ahead AND run NOT LIKE 'fold%'"""))
def stacked_single_member(spark, sf):
    from seriesloom.operators.stacking import stack

    panel = append_future(orders_monthly(spark, sf), 12, "month")
    frame = M.model_frame(panel, M.standard_runs(12, 12) + M.fold_runs(12, 5))
    out = stack(fit_predict_all(frame, ["Seasonal Naive"], CTX), ["Seasonal Naive"], ["Linear Regression"])
    return out.where("ahead").select("id", "run", "date", "model_desc", F.round("prediction", 0).alias("prediction"))


@query("stacked_boosted", "O-129")
def stacked_boosted(spark, sf):
    frame = M.model_frame(features_with_future(spark, sf), M.standard_runs(24, 12) + M.fold_runs(24, 5))
    from seriesloom.operators.stacking import stack

    members = ["Seasonal Naive", "Linear Regression"]
    return stack(fit_predict_all(frame, members, FCTX), members, ["Boosted Trees"]).where("ahead").select(
        "id", "run", "date", "model_desc", "prediction")


TRANSFORM_STEPS = ["Add 1", "Log"]


@query("back_transformed_forecast", "O-72 O-69", with_sql(*simple_sql(
    "SELECT id, date, ln(value + 1) AS value FROM (" + ORDERS_M + ")"), CONF_SQL, """
SELECT id, model_desc, key, date, round(exp(value) - 1, 0) AS value, round(exp(conf_lo) - 1, 0) AS conf_lo,
  round(exp(conf_hi) - 1, 0) AS conf_hi, conf_lvl FROM fo"""))
def back_transformed_forecast(spark, sf):
    from seriesloom.operators.transform import transform_panel

    moved, params = transform_panel(orders_monthly(spark, sf), TRANSFORM_STEPS)
    result = FC.forecast(append_future(moved, 12, "month"), SIMPLE, CTX, 12, 12, [0.8, 0.85, 0.9, 0.95])
    back = FC.back_transform(result, params, TRANSFORM_STEPS)
    return shown(back.oos_forecast.where("key = 'prediction'").drop("model_id"), 0)


@query("back_transformed_accuracy", "O-71", with_sql(*simple_sql(
    "SELECT id, date, ln(value + 1) AS value FROM (" + ORDERS_M + ")"), """
br AS (SELECT id, model_desc, CASE WHEN ahead THEN 'Test' ELSE 'Train' END AS type, exp(actual) - 1 AS a,
  exp(prediction) - 1 AS b FROM pr WHERE run = 'test' AND prediction IS NOT NULL)""", """
SELECT id, model_desc, type, round(avg(abs((a - b) / a)) * 100, 5) AS mape FROM br GROUP BY 1, 2, 3"""))
def back_transformed_accuracy(spark, sf):
    from seriesloom.operators.transform import transform_panel

    moved, params = transform_panel(orders_monthly(spark, sf), TRANSFORM_STEPS)
    result = FC.forecast(append_future(moved, 12, "month"), SIMPLE, CTX, 12, 12)
    back = FC.back_transform(result, params, TRANSFORM_STEPS)
    return back.accuracy.select("id", "model_desc", "type", F.round("mape", 5).alias("mape"))


@query("undifferenced_forecast", "O-70 O-72", with_sql(ORDERS_M, """
SELECT id, CAST(h AS INTEGER) AS h, round(value, 1) AS value FROM (SELECT id, value, unnest(range(1, 13)) AS h FROM p
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC) = 1)"""))
def undifferenced_forecast(spark, sf):
    """A forecast of zero change on the differenced scale restores the last level."""
    from pyspark.sql import Window

    from seriesloom.operators.transform import invert_forecast, transform_panel

    moved, params = transform_panel(orders_monthly(spark, sf), ["Differencing"])
    flat = append_future(moved, 12, "month").where("is_future").select(
        "id", "date", F.lit(0.0).alias("value"))
    back = invert_forecast(flat, params, ["Differencing"], ["id"])
    h = F.row_number().over(Window.partitionBy("id").orderBy("date"))
    return back.select("id", h.alias("h"), F.round("value", 1).alias("value"))


@query("undifferenced_holdout", "O-71 O-72", with_sql(ORDERS_M, """
a AS (SELECT id, date, value AS y, row_number() OVER w AS t, count(*) OVER (PARTITION BY id) AS n,
  value - lag(value) OVER w AS d FROM p WINDOW w AS (PARTITION BY id ORDER BY date))""", """
b AS (SELECT *, d - lag(d, 12) OVER w AS s, lag(y) OVER w AS y1, lag(y, 12) OVER w AS y12, lag(d, 12) OVER w AS d12 FROM a
  WINDOW w AS (PARTITION BY id ORDER BY date))""", """
c AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY date) AS s1 FROM b)""", """
h AS (SELECT c.*, e.y + c.y12 - e.y12 + (c.t - e.t) * e.s AS path FROM c JOIN c AS e ON c.id = e.id AND e.t = c.n - 12
  WHERE c.t > c.n - 12)""", """
SELECT id, date, 'fit' AS kind, round(y, 3) AS actual, round(s1 + d12 + y1, 3) AS prediction FROM c
  WHERE t BETWEEN 14 AND n - 12
UNION ALL SELECT id, date, 'ahead', round(y, 3), round(path, 3) FROM h
UNION ALL SELECT id, date, 'table', NULL, round(path, 3) FROM h"""))
def undifferenced_holdout(spark, sf):
    """Residuals and hold-out forecast of Naive on a series differenced twice, back on the scale of the data."""
    from seriesloom.operators.transform import transform_panel

    steps = ["Differencing", "Seasonal Differencing"]
    moved, params = transform_panel(orders_monthly(spark, sf), steps, 12)
    result = FC.forecast(append_future(moved, 12, "month"), ["Naive"], CTX, 12, 12, [0.8])
    back = FC.back_transform(result, params, steps)
    kind = F.when(F.col("split") == "train", "fit").otherwise("ahead").alias("kind")
    rows = back.residuals.select("id", "date", kind, F.round("actual", 3).alias("actual"),
                                 F.round("prediction", 3).alias("prediction"))
    held = back.test_forecast.where("key = 'prediction'").select(
        "id", "date", F.lit("table").alias("kind"), F.lit(None).cast("double").alias("actual"),
        F.round("value", 3).alias("prediction"))
    return rows.unionByName(held)


@query("tuning_setup", "O-130", """
SELECT DISTINCT o_orderpriority AS id, 'Random Forest' AS method, k AS parameter, v AS default, k = 'rf_mtry' AS tune
FROM orders, (VALUES ('rf_mtry', '5'), ('rf_trees', '1000'), ('rf_min_n', '5')) d(k, v)""")
def tuning_setup(spark, sf):
    return TU.tune_setup(priorities(spark, sf), "Random Forest", ["rf_mtry"])


@query("space_filling_grid", "O-131", """
SELECT DISTINCT o_orderpriority AS id, k AS parameter, CAST(s AS INTEGER) AS slice, CAST(1 AS BIGINT) AS n FROM orders,
  (VALUES ('mixture'), ('penalty')) d(k), (SELECT unnest(range(0, 10)) AS s)""")
def space_filling_grid(spark, sf):
    """Every tenth of the range of every parameter (on its scale) is hit exactly once."""
    grid = TU.grid_table(priorities(spark, sf), TU.space_filling(["penalty", "mixture"], 10))
    low, high = F.ln(F.lit(1e-4)), F.ln(F.lit(10.0))
    place = F.when(F.col("parameter") == "penalty", (F.ln("value") - low) / (high - low)).otherwise(F.col("value"))
    return grid.groupBy("id", "parameter", F.floor(place * 10).cast("int").alias("slice")).agg(
        F.count(F.lit(1)).alias("n"))


@query("tuned_elastic_net", "O-132 O-41 O-58")
def tuned_elastic_net(spark, sf):
    tuned = TU.tune(features_with_future(spark, sf), "Elastic Net", FCTX, 24, 5, 10, second_round=True)
    return tuned.select("id", "method", F.explode("params").alias("parameter", "value"), "score")


@query("tuned_random_folds", "O-132 O-58")
def tuned_random_folds(spark, sf):
    tuned = TU.tune(features_with_future(spark, sf), "Elastic Net", FCTX, 24, 5, 10, validation="K-Fold CV")
    return tuned.select("id", "method", F.explode("params").alias("parameter", "value"), "score")


@query("tuned_forest", "O-132")
def tuned_forest(spark, sf):
    """A method without a shared pass: one fit of every series per grid point and fold."""
    tuned = TU.tune(features_with_future(spark, sf), "Random Forest", FCTX, 24)
    return tuned.select("id", "method", F.explode("params").alias("parameter", "value"), "score")


@query("tuned_neighbours", "O-132 O-41")
def tuned_neighbours(spark, sf):
    tuned = TU.tune(features_with_future(spark, sf), "KNN", FCTX, 24, metric="mae")
    return tuned.select("id", "method", F.explode("params").alias("parameter", "value"), "score")


@query("tuned_by_halving", "O-132 O-58")
def tuned_by_halving(spark, sf):
    tuned = TU.tune_by_halving(features_with_future(spark, sf), "Elastic Net", FCTX, 24)
    return tuned.select("id", "method", F.explode("params").alias("parameter", "value"), "score", "folds", "fits")


@query("best_candidate", "O-41", with_sql(*simple_sql(SHIP_M, 6), """
sc AS (SELECT id, model_desc, sqrt(avg(pow(actual - prediction, 2))) AS rmse FROM pr WHERE run = 'test' AND ahead
  AND prediction IS NOT NULL GROUP BY 1, 2)""", """
SELECT id, arg_min(model_desc, (round(rmse, 6), model_desc)) AS model_desc, round(min(rmse), 6) AS rmse FROM sc
GROUP BY id"""))
def best_candidate(spark, sf):
    test = FC.calibration_of(simple_predictions(spark, sf, ship_monthly, 6))
    scores = A.accuracy_table(test, ["id", "model_desc"], ["rmse"])
    return scores.groupBy("id").agg(
        F.min_by("model_desc", F.struct(F.round("rmse", 6), "model_desc")).alias("model_desc"),
        F.round(F.min("rmse"), 6).alias("rmse"))


@query("automatic_leaderboard", "O-125 O-58")
def automatic_leaderboard(spark, sf):
    return TU.leaderboard(features_with_future(spark, sf), FCTX, 24)
