"""Profiles, summaries, decomposition, autocorrelation."""

from pyspark.sql import functions as F

from seriesloom.catalog.panels import REGRESSORS, regressors
from seriesloom.catalog.registry import (
    EVENTS_H, FLAG_M, ORDERS_D, ORDERS_M, SHIP_M, events_hourly, flag_monthly, orders_daily, orders_monthly, query,
    ship_monthly, with_sql,
)
from seriesloom.operators import describe as D
from seriesloom.operators import panel as P
from seriesloom.operators import reshape as R


@query("data_summary", "O-33", with_sql(ORDERS_M, f"""
x AS (SELECT p.*, n_orders, avg_price FROM p JOIN ({REGRESSORS}) r ON p.id = r.id AND p.date = r.date)""", """
l AS (SELECT id, 'value' AS variable, value FROM x UNION ALL SELECT id, 'n_orders', n_orders FROM x
  UNION ALL SELECT id, 'avg_price', avg_price FROM x)""", """
SELECT id, variable, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_missing,
  1 - count(*) FILTER (value IS NULL) / count(*) AS complete_rate, round(avg(value), 3) AS mean,
  round(stddev_samp(value), 3) AS sd, round(min(value), 3) AS p0, round(quantile_cont(value, 0.25), 3) AS p25,
  round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.75), 3) AS p75,
  round(max(value), 3) AS p100, count(DISTINCT value) AS n_unique FROM l GROUP BY id, variable"""))
def data_summary(spark, sf):
    full = R.join_regressors(orders_monthly(spark, sf), regressors(spark, sf))
    return R.round_numeric(D.summarise(full, ["value", "n_orders", "avg_price"], ["id"]), 3)


PROFILE_SQL = """
st AS (SELECT id, date, epoch(date) - epoch(lag(date) OVER (PARTITION BY id ORDER BY date)) AS step FROM p),
ty AS (SELECT id, quantile_cont(step, 0.5) AS s FROM st GROUP BY id),
sc AS (SELECT id, CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 7 * 86400 THEN 'day'
  WHEN s < 28 * 86400 THEN 'week' WHEN s < 89 * 86400 THEN 'month' WHEN s < 360 * 86400 THEN 'quarter'
  ELSE 'year' END AS scale FROM ty),
bu AS (SELECT p.id, scale, CASE scale WHEN 'minute' THEN date_trunc('day', date) WHEN 'hour' THEN
  date_trunc('day', date) WHEN 'day' THEN date_trunc('week', date) WHEN 'week' THEN date_trunc('quarter', date)
  WHEN 'month' THEN date_trunc('year', date) WHEN 'quarter' THEN date_trunc('year', date) ELSE date END AS bucket
  FROM p JOIN sc ON p.id = sc.id),
co AS (SELECT id, scale, bucket, count(*) AS n FROM bu GROUP BY 1, 2, 3),
fr AS (SELECT id, scale, CAST(round(quantile_cont(n, 0.5)) AS INTEGER) AS frequency FROM co GROUP BY 1, 2)"""


for _name, _base, _panel in (("monthly", ORDERS_M, orders_monthly), ("daily", ORDERS_D, orders_daily),
                             ("hourly", EVENTS_H, events_hourly), ("parts", SHIP_M, ship_monthly)):
    query(f"infer_frequency_{_name}", "O-35", with_sql(_base, PROFILE_SQL, "SELECT * FROM fr"))(
        lambda spark, sf, _panel=_panel: D.infer_frequency(_panel(spark, sf)))


@query("series_profile", "O-34 O-37 O-38", with_sql(SHIP_M, PROFILE_SQL, """
k AS (SELECT id, frequency, CASE WHEN frequency <= 2 THEN frequency WHEN frequency <= 4 THEN 4
  WHEN frequency = 5 THEN 5 WHEN frequency <= 7 THEN 7 WHEN frequency <= 12 THEN 12 WHEN frequency <= 13 THEN 13
  WHEN frequency <= 24 THEN 24 WHEN frequency <= 48 THEN 48 ELSE 52 END AS f FROM fr)""", """
h AS (SELECT *, CASE f WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 4 THEN 8 WHEN 12 THEN 12 WHEN 13 THEN 13 WHEN 52 THEN 13
  WHEN 5 THEN 60 WHEN 7 THEN 90 WHEN 24 THEN 168 WHEN 48 THEN 336 END AS horizon,
  CASE f WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 12 THEN 4 WHEN 13 THEN 4 WHEN 52 THEN 4 ELSE 1 END AS mult
  FROM k)""", """
SELECT p.id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, h.frequency,
  CAST(horizon AS INTEGER) AS horizon, CAST(floor(count(*) * 0.2 + 0.5) AS INTEGER) AS n_assess,
  CAST(horizon * mult AS INTEGER) AS acf_lags
FROM p JOIN h ON p.id = h.id GROUP BY p.id, h.frequency, horizon, mult"""))
def series_profile(spark, sf):
    return D.series_profile(ship_monthly(spark, sf))


@query("sorted_summary", "O-39", with_sql(ORDERS_M, """
SELECT id, round(avg(value), 2) AS mean FROM p GROUP BY id ORDER BY mean DESC"""))
def sorted_summary(spark, sf):
    means = orders_monthly(spark, sf).groupBy("id").agg(F.round(F.avg("value"), 2).alias("mean"))
    return means.orderBy(F.col("mean").desc())


@query("value_histogram", "O-43", with_sql(SHIP_M, """
s AS (SELECT id, value, min(value) OVER (PARTITION BY id) AS lo, max(value) OVER (PARTITION BY id) AS hi FROM p),
b AS (SELECT id, lo, (hi - lo) / 20 AS w, least(coalesce(CAST(floor((value - lo) / nullif((hi - lo) / 20, 0))
  AS INTEGER), 0), 19) + 1 AS bin FROM s)""", """
SELECT id, bin, count(*) AS n, round(min(lo + w * (bin - 1)), 6) AS bin_start FROM b GROUP BY id, bin"""))
def value_histogram(spark, sf):
    return R.round_numeric(D.histogram(ship_monthly(spark, sf), 20), 6)


@query("value_density", "O-43", with_sql(EVENTS_H, """
s AS (SELECT id, count(*) AS n, least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))
  / 1.34) * pow(count(*), -0.2) * 0.9 AS h, min(value) AS lo, max(value) AS hi FROM p GROUP BY id)""", """
g AS (SELECT *, k + 1 AS point, lo - 3 * h + (hi - lo + 6 * h) / 63 * k AS x FROM s,
  (SELECT unnest(range(0, 64)) AS k))""", """
SELECT g.id, CAST(point AS INTEGER) AS point, round(x, 4) AS x,
  round(sum(exp(-0.5 * pow((x - value) / h, 2)) / (n * h * sqrt(2 * pi()))), 8) AS density
FROM g JOIN p ON g.id = p.id GROUP BY g.id, point, x"""))
def value_density(spark, sf):
    df = D.density(events_hourly(spark, sf))
    return df.withColumn("x", F.round("x", 4)).withColumn("density", F.round("density", 8))


@query("seasonal_profile", "O-44", with_sql(EVENTS_H, """
l AS (SELECT id, value, 'hour' AS unit, hour(date) AS level FROM p
  UNION ALL SELECT id, value, 'wday', dayofweek(date) + 1 FROM p
  UNION ALL SELECT id, value, 'month', month(date) FROM p)""", """
SELECT id, unit, CAST(level AS INTEGER) AS level, count(value) AS n, round(min(value), 4) AS low,
  round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS high FROM l GROUP BY id, unit, level"""))
def seasonal_profile(spark, sf):
    return R.round_numeric(D.seasonal_profile(events_hourly(spark, sf), ["hour", "wday", "month"]), 4)


def decompose_sql(period, source="p"):
    half = max(1, period // 2)
    return f"""
t1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS t, avg(value) OVER (PARTITION BY id
  ORDER BY date ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS trend FROM {source}),
t2 AS (SELECT *, avg(value - trend) OVER (PARTITION BY id, (t - 1) % {period}) AS raw FROM t1),
t3 AS (SELECT id, date, value, trend, raw - avg(raw) OVER (PARTITION BY id) AS season FROM t2),
dec AS (SELECT *, value - trend - season AS remainder FROM t3)"""


@query("decomposition", "O-50", with_sql(ORDERS_M, decompose_sql(12), """
SELECT id, date, round(value, 2) AS value, round(trend, 2) AS trend, round(season, 2) AS season,
  round(remainder, 2) AS remainder FROM dec"""))
def decomposition(spark, sf):
    return R.round_numeric(D.decompose(orders_monthly(spark, sf), 12), 2)


@query("decomposition_parts", "O-50", with_sql(SHIP_M, decompose_sql(12), """
SELECT id, date, round(value, 5) AS value, round(trend, 5) AS trend, round(season, 5) AS season,
  round(remainder, 5) AS remainder FROM dec"""))
def decomposition_parts(spark, sf):
    return R.round_numeric(D.decompose(ship_monthly(spark, sf), 12), 5)


@query("decomposition_robust", "O-50", with_sql(ORDERS_M, """
t1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS t, median(value) OVER (PARTITION BY id
  ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS trend FROM p),
t2 AS (SELECT *, avg(value - trend) OVER (PARTITION BY id, (t - 1) % 12) AS raw FROM t1)""", """
SELECT id, date, round(trend, 1) AS trend, round(raw - avg(raw) OVER (PARTITION BY id), 1) AS season FROM t2"""))
def decomposition_robust(spark, sf):
    parts = D.decompose(orders_monthly(spark, sf), 12, robust=True)
    return R.round_numeric(parts.select("id", "date", "trend", "season"), 1)


@query("smoother", "O-51", with_sql(FLAG_M, """
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS DOUBLE) AS t FROM p)""", """
s AS (SELECT *, regr_slope(value, t) OVER w AS b, regr_intercept(value, t) OVER w AS a FROM t
  WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))""", """
SELECT id, date, value, round(a + b * t, 1) AS smooth FROM s"""))
def smoother(spark, sf):
    return D.smooth(flag_monthly(spark, sf), 9).withColumn("smooth", F.round("smooth", 1))


def acf_sql(lags, source="p"):
    return f"""
d AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) AS t,
  value - avg(value) OVER (PARTITION BY id) AS d FROM {source}),
c0 AS (SELECT id, count(*) AS n, sum(d * d) AS c0 FROM d GROUP BY id),
lg AS (SELECT unnest(range(1, {lags + 1})) AS lag),
ck AS (SELECT a.id, lag, sum(a.d * b.d) AS ck FROM d a JOIN lg ON true JOIN d b ON a.id = b.id AND b.t = a.t - lag
  GROUP BY a.id, lag),
acf AS (SELECT c0.id, n, CAST(lg.lag AS INTEGER) AS lag, coalesce(ck, 0) / nullif(c0, 0) AS acf
  FROM c0 JOIN lg ON true LEFT JOIN ck ON ck.id = c0.id AND ck.lag = lg.lag)"""


@query("acf", "O-52", with_sql(ORDERS_M, acf_sql(24), """
SELECT id, lag, round(acf, 8) AS acf, round(1.96 / sqrt(n), 8) AS white_noise FROM acf"""))
def acf(spark, sf):
    return R.round_numeric(D.autocorrelation(orders_monthly(spark, sf), 24).drop("pacf"), 8)


@query("acf_parts", "O-52", with_sql(SHIP_M, acf_sql(12), """
SELECT id, lag, round(acf, 8) AS acf, round(1.96 / sqrt(n), 8) AS white_noise FROM acf"""))
def acf_parts(spark, sf):
    return R.round_numeric(D.autocorrelation(ship_monthly(spark, sf), 12).drop("pacf"), 8)


@query("pacf_first_lags", "O-52", with_sql(EVENTS_H, acf_sql(3), """
r AS (SELECT id, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2, max(acf) FILTER (lag = 3) AS r3
  FROM acf GROUP BY id)""", """
SELECT id, round(r1, 7) AS pacf1, round((r2 - r1 * r1) / (1 - r1 * r1), 7) AS pacf2,
  round((r3 - 2 * r1 * r2 + r1 * r1 * r1 + r1 * r2 * r2 - r1 * r1 * r3)
    / (1 - 2 * r1 * r1 - r2 * r2 + 2 * r1 * r1 * r2), 7) AS pacf3 FROM r"""))
def pacf_first_lags(spark, sf):
    p = D.autocorrelation(events_hourly(spark, sf), 24).where("lag <= 3").select(
        "id", F.concat(F.lit("pacf"), F.col("lag")).alias("name"), F.round("pacf", 7).alias("pacf"))
    return R.to_wide(p, ["id"], "name", "pacf", ["pacf1", "pacf2", "pacf3"])


@query("cross_correlation", "O-53", with_sql(ORDERS_M, f"""
x AS (SELECT p.*, n_orders, avg_price FROM p JOIN ({REGRESSORS}) r ON p.id = r.id AND p.date = r.date),
l AS (SELECT id, date, value, 'n_orders' AS variable, n_orders AS x FROM x UNION ALL
  SELECT id, date, value, 'avg_price', avg_price FROM x),
d AS (SELECT id, variable, row_number() OVER w AS t, value - avg(value) OVER (PARTITION BY id, variable) AS y,
  x - avg(x) OVER (PARTITION BY id, variable) AS x FROM l WINDOW w AS (PARTITION BY id, variable ORDER BY date)),
s AS (SELECT id, variable, sqrt(sum(x * x) * sum(y * y)) AS s FROM d GROUP BY 1, 2)""", """
SELECT a.id, a.variable, CAST(lag AS INTEGER) AS lag, round(sum(a.y * b.x) / max(s), 8) AS ccf
FROM d a JOIN (SELECT unnest(range(-12, 13)) AS lag) ON true
JOIN d b ON a.id = b.id AND a.variable = b.variable AND b.t = a.t - lag
JOIN s ON s.id = a.id AND s.variable = a.variable GROUP BY 1, 2, 3"""))
def cross_correlation(spark, sf):
    full = R.join_regressors(orders_monthly(spark, sf), regressors(spark, sf))
    return D.cross_correlation(full, ["n_orders", "avg_price"], 12).withColumn("ccf", F.round("ccf", 8))
