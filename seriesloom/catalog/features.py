"""Feature engineering."""

from pyspark.sql import functions as F

from seriesloom.catalog.panels import REGRESSORS, regressors
from seriesloom.catalog.registry import (
    ORDERS_D, ORDERS_M, SHIP_M, orders_daily, orders_monthly, query, ship_monthly, table, with_sql,
)
from seriesloom.functions.calendar import MONTHS, WEEKDAYS
from seriesloom.operators import features as X
from seriesloom.operators import panel as P
from seriesloom.operators import reshape as R

W = "OVER (PARTITION BY id ORDER BY date)"


@query("lag_features", "O-48", with_sql(SHIP_M, f"""
SELECT id, date, value, lag(value, 12) {W} AS lag12, lag(value, 24) {W} AS lag24 FROM p"""))
def lag_features(spark, sf):
    return X.add_lags(ship_monthly(spark, sf), [12, 24])


ROLL_SQL = ", ".join(
    f"CASE WHEN count(value) {w} = {p} THEN round(avg(value) {w}, 6) END AS roll_mean_{p}, "
    f"CASE WHEN count(value) {w} = {p} THEN round(stddev_samp(value) {w}, 6) END AS roll_sd_{p}"
    for p in (3, 6)
    for w in [f"OVER (PARTITION BY id ORDER BY date ROWS BETWEEN {11 + p} PRECEDING AND 12 PRECEDING)"])


@query("rolling_features", "O-49", with_sql(SHIP_M, f"SELECT id, date, value, {ROLL_SQL} FROM p"))
def rolling_features(spark, sf):
    return R.round_numeric(X.add_rolls(ship_monthly(spark, sf), 12, [3, 6]), 6)


MONTH_NAMES = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
DAY_NAMES = "[" + ", ".join(f"'{d}'" for d in WEEKDAYS) + "]"
CALENDAR_SQL = f"""
SELECT id, date, value, CAST(row_number() {W} AS INTEGER) AS time_trend, CAST(year(date) AS INTEGER) AS year,
  CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END AS half, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(month(date) AS INTEGER) AS month, {MONTH_NAMES}[month(date)] AS month_lbl,
  CAST(day(date) AS INTEGER) AS day, CAST(hour(date) AS INTEGER) AS hour, CAST(minute(date) AS INTEGER) AS minute,
  CAST(second(date) AS INTEGER) AS second, CAST((hour(date) + 11) % 12 + 1 AS INTEGER) AS hour12,
  CASE WHEN hour(date) < 12 THEN 1 ELSE 2 END AS am_pm, CAST(dayofweek(date) + 1 AS INTEGER) AS wday,
  {DAY_NAMES}[dayofweek(date) + 1] AS wday_lbl, CAST(day(date) AS INTEGER) AS mday,
  CAST(date_diff('day', date_trunc('quarter', date), date) + 1 AS INTEGER) AS qday,
  CAST(dayofyear(date) AS INTEGER) AS yday,
  CAST((day(date) + dayofweek(date_trunc('month', date)) + 1 - 2) // 7 + 1 AS INTEGER) AS mweek,
  CAST((dayofyear(date) - 1) // 7 + 1 AS INTEGER) AS week,
  CAST(((dayofyear(date) - 1) // 7 + 1) % 2 AS INTEGER) AS week2,
  CAST(((dayofyear(date) - 1) // 7 + 1) % 3 AS INTEGER) AS week3,
  CAST(((dayofyear(date) - 1) // 7 + 1) % 4 AS INTEGER) AS week4,
  CAST((day(date) - 1) // 7 + 1 AS INTEGER) AS mday7 FROM p"""


@query("calendar_features", "O-77", with_sql(ORDERS_D, CALENDAR_SQL))
def calendar_features(spark, sf):
    return X.add_calendar(orders_daily(spark, sf))


EASTER = """
y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e3),
ea AS (SELECT y, make_date(CAST(y AS INTEGER), CAST(n // 31 AS INTEGER), CAST(n % 31 + 1 AS INTEGER)) AS easter
  FROM e4)"""


@query("holiday_features", "O-78", with_sql(ORDERS_D, EASTER, """
h AS (SELECT id, date, month(date) AS m, day(date) AS d, dayofweek(date) AS w, easter FROM p
  JOIN ea ON year(date) = y)""", """
f AS (SELECT id, date, m = 1 AND d = 1 AS a, m = 1 AND w = 1 AND d BETWEEN 15 AND 21 AS b,
  m = 2 AND w = 1 AND d BETWEEN 15 AND 21 AS c, date = easter - 2 AS e, date = easter AS f,
  m = 5 AND w = 1 AND d >= 25 AS g, m = 7 AND d = 4 AS i, m = 9 AND w = 1 AND d <= 7 AS j,
  m = 10 AND w = 1 AND d BETWEEN 8 AND 14 AS k, m = 11 AND d = 11 AS l,
  m = 11 AND w = 4 AND d BETWEEN 22 AND 28 AS n, m = 12 AND d = 25 AS o FROM h)""", """
SELECT id, date, CAST(a AS INTEGER) AS holiday_new_years_day, CAST(b AS INTEGER) AS holiday_martin_luther_king_day,
  CAST(c AS INTEGER) AS holiday_presidents_day, CAST(e AS INTEGER) AS holiday_good_friday,
  CAST(f AS INTEGER) AS holiday_easter_sunday, CAST(g AS INTEGER) AS holiday_memorial_day,
  CAST(i AS INTEGER) AS holiday_independence_day, CAST(j AS INTEGER) AS holiday_labor_day,
  CAST(k AS INTEGER) AS holiday_columbus_day, CAST(l AS INTEGER) AS holiday_veterans_day,
  CAST(n AS INTEGER) AS holiday_thanksgiving_day, CAST(o AS INTEGER) AS holiday_christmas_day,
  CAST(a OR b OR c OR e OR f OR g OR i OR j OR k OR l OR n OR o AS INTEGER) AS holiday FROM f"""))
def holiday_features(spark, sf):
    return X.add_holidays(orders_daily(spark, sf)).drop("value")


FOURIER_SQL = ", ".join(
    f"round({f}(t * {2 * 3.141592653589793 * k / p}::DOUBLE), 9) AS {f}{p}_K{k}"
    for p in (6, 12) for k in (1, 2) for f in ("sin", "cos"))


@query("fourier_features", "O-79", with_sql(SHIP_M, f"""
t AS (SELECT id, date, row_number() {W} AS t FROM p)""", f"SELECT id, date, {FOURIER_SQL} FROM t"))
def fourier_features(spark, sf):
    return R.round_numeric(X.add_fourier(ship_monthly(spark, sf), [6, 12], 2).drop("value"), 9)


SPLINE_SQL = ", ".join(
    f"round({c}::DOUBLE * pow(u, {j}) * pow(1 - u, {d - j}), 9) AS spline_{j}_{d}"
    for d, cs in ((3, (3, 3, 1)), (6, (6, 15, 20, 15, 6, 1))) for j, c in enumerate(cs, 1))


@query("spline_features", "O-80", with_sql(ORDERS_M, """
f AS (SELECT id, date FROM p UNION ALL SELECT id, unnest(generate_series(max(date) + INTERVAL 1 MONTH,
  max(date) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS date FROM p GROUP BY id)""", """
u AS (SELECT id, date, (epoch(date) - min(epoch(date)) OVER (PARTITION BY id))
  / (max(epoch(date)) OVER (PARTITION BY id) - min(epoch(date)) OVER (PARTITION BY id)) AS u FROM f)""", f"""
SELECT id, date, {SPLINE_SQL} FROM u"""))
def spline_features(spark, sf):
    frame = X.append_future(orders_monthly(spark, sf), 12, "month")
    return R.round_numeric(X.add_splines(frame, [3, 6]).drop("value", "is_future"), 9)


@query("interaction_features", "O-81", with_sql(ORDERS_D, """
SELECT id, date, CAST(((dayofyear(date) - 1) // 7 + 1) % 2 * (dayofweek(date) + 1) AS DOUBLE) AS inter_1,
  CAST(((dayofyear(date) - 1) // 7 + 1) % 3 * (dayofweek(date) + 1) AS DOUBLE) AS inter_2 FROM p"""))
def interaction_features(spark, sf):
    df = X.add_calendar(orders_daily(spark, sf))
    terms = ["week2 * wday.lbl", "week3 * wday.lbl"]
    return X.add_interactions(df, terms).select("id", "date", "inter_1", "inter_2")


def full_params():
    """All feature families."""
    return X.FeatureParams(
        calendar=True, holiday=True, fourier_periods=[6, 12], fourier_k=1, spline_degrees=[3, 6], lags=[12, 24],
        rolls=[3, 6], interactions=["week2 * wday.lbl", "week3 * wday.lbl"])


FRAME_SQL = with_sql(SHIP_M, """
f AS (SELECT id, date, value, false AS is_future FROM p UNION ALL SELECT id, unnest(generate_series(max(date)
  + INTERVAL 1 MONTH, max(date) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS date, NULL, true FROM p GROUP BY id)""",
f"""
SELECT id, date, value, is_future, CAST(row_number() {W} AS INTEGER) AS time_trend,
  CAST(month(date) AS INTEGER) AS month, lag(value, 12) {W} AS lag12,
  round(sin(row_number() {W} * {2 * 3.141592653589793 / 12}::DOUBLE), 9) AS sin12_K1,
  CASE WHEN count(value) OVER r = 3 THEN round(avg(value) OVER r, 6) END AS roll_mean_3 FROM f
WINDOW r AS (PARTITION BY id ORDER BY date ROWS BETWEEN 26 PRECEDING AND 24 PRECEDING)""")


@query("feature_frame", "O-76", FRAME_SQL)
def feature_frame(spark, sf):
    params = X.FeatureParams(calendar=True, fourier_periods=[12], lags=[12, 24], rolls=[3])
    df = X.feature_frame(ship_monthly(spark, sf), params, 12, "month")
    return df.select("id", "date", "value", "is_future", "time_trend", "month", "lag12",
                     F.round("sin12_K1", 9).alias("sin12_K1"), F.round("roll_mean_3", 6).alias("roll_mean_3"))


@query("feature_set_complete", "O-76 O-21 O-24")
def feature_set_complete(spark, sf):
    return X.generate_features(ship_monthly(spark, sf), full_params(), 12, "month")


@query("feature_names", "O-25 O-82", """
SELECT * FROM (VALUES ('n_orders'), ('avg_price')) v(feature)""")
def feature_names(spark, sf):
    full = R.join_regressors(orders_monthly(spark, sf), regressors(spark, sf))
    names = R.feature_columns(full)
    # the same columns in long form, one row per feature
    return full.unpivot(["id", "date"], names, "feature", "x").select("feature").distinct()


@query("predictor_matrix", "O-26 O-82", with_sql(ORDERS_M, """
SELECT id, date, value, CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS DOUBLE) AS x1,
  CAST(month(date) AS DOUBLE) AS x2 FROM p"""))
def predictor_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = orders_monthly(spark, sf).withColumns({
        "time_trend": F.row_number().over(P.by_date()), "month": F.month("date")})
    columns = X.columns_for("Linear Regression", df.columns)
    x = vector_to_array("features")
    return R.predictor_matrix(df, columns).select("id", "date", "value", x[0].alias("x1"), x[1].alias("x2"))


@query("predictor_matrix_complete", "O-26 O-82")
def predictor_matrix_complete(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = X.generate_features(orders_monthly(spark, sf), full_params(), 12, "month").na.drop()
    columns = X.columns_for("MARS", df.columns)
    return R.predictor_matrix(df, columns).withColumn("features", vector_to_array("features"))


@query("feature_set_regression", "O-83", with_sql(ORDERS_M, f"""
t AS (SELECT id, date, value, CAST(row_number() {W} AS DOUBLE) AS t FROM p)""", """
r AS (SELECT id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM t GROUP BY id)""", """
SELECT t.id, date, value, round(a + b * t, 1) AS fitted FROM t JOIN r ON t.id = r.id"""))
def feature_set_regression(spark, sf):
    from seriesloom.operators.linear import fitted_by_formula

    df = orders_monthly(spark, sf).withColumn("time_trend", F.row_number().over(P.by_date()))
    return R.apply_to_columns(fitted_by_formula(df, "value ~ time_trend"), ["fitted"], lambda c: F.round(c, 1))


@query("feature_set_regression_complete", "O-83")
def feature_set_regression_complete(spark, sf):
    from seriesloom.operators.linear import fitted_by_formula

    df = X.generate_features(orders_monthly(spark, sf), X.FeatureParams(fourier_periods=[12]), 1, "month")
    return fitted_by_formula(df.where("value IS NOT NULL"), "value ~ time_trend + sin12_K1 + cos12_K1")
