"""Filling, imputation and anomalies."""

from pyspark.sql import functions as F

from seriesloom.catalog.describing import decompose_sql
from seriesloom.catalog.registry import (
    EVENTS_H, ORDERS_D, ORDERS_M, SHIP_M, events_hourly, orders_daily, orders_monthly, query, ship_monthly, with_sql,
)
from seriesloom.operators import panel as P
from seriesloom.operators import quality as Q
from seriesloom.operators import reshape as R

GRID_D = """
g AS (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 {unit})) AS date FROM p GROUP BY id),
gp AS (SELECT g.id, g.date, p.value FROM g LEFT JOIN p ON g.id = p.id AND g.date = p.date)"""

LINE = """
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS t FROM {source}),
k2 AS (SELECT *, CASE WHEN {v} IS NOT NULL THEN t END AS kt FROM k),
k3 AS (SELECT *, last_value(kt IGNORE NULLS) OVER u AS ta, last_value({v} IGNORE NULLS) OVER u AS va,
  last_value(kt IGNORE NULLS) OVER d AS tb, last_value({v} IGNORE NULLS) OVER d AS vb FROM k2
  WINDOW u AS (PARTITION BY id ORDER BY date), d AS (PARTITION BY id ORDER BY date DESC)),
fl AS (SELECT *, coalesce({v}, va + (vb - va) * (CAST(t - ta AS DOUBLE) / nullif(tb - ta, 0)), va, vb) AS filled
  FROM k3)"""


@query("forward_fill", "O-151", with_sql(ORDERS_D, GRID_D.format(unit="DAY"), """
SELECT id, date, last_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY date) AS value FROM gp"""))
def forward_fill(spark, sf):
    return Q.forward_fill(P.regular_grid(orders_daily(spark, sf), "day"))


@query("interpolate_linear", "O-46", with_sql(
    ORDERS_D, GRID_D.format(unit="DAY"), LINE.format(source="gp", v="value"),
    "SELECT id, date, round(filled, 6) AS value FROM fl"))
def interpolate_linear(spark, sf):
    return R.round_numeric(Q.interpolate(P.regular_grid(orders_daily(spark, sf), "day")), 6)


def impute_sql(base, unit, period, digits):
    return with_sql(
        base, GRID_D.format(unit=unit),
        "gn AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM gp)",
        decompose_sql(period, "gp"),
        f"""ad AS (SELECT gn.id, gn.date, gn.value, CASE WHEN n >= {2 * period} THEN coalesce(season, 0) ELSE 0 END AS s
  FROM gn JOIN dec ON gn.id = dec.id AND gn.date = dec.date)""",
        "adj AS (SELECT id, date, value AS raw, s, value - s AS a FROM ad)",
        LINE.format(source="adj", v="a"),
        f"SELECT id, date, round(filled + s, {digits}) AS value, raw IS NULL AS imputed FROM fl")


@query("impute_daily", "O-46", impute_sql(ORDERS_D, "DAY", 7, 5))
def impute_daily(spark, sf):
    return R.round_numeric(Q.impute(orders_daily(spark, sf), "day", 7), 5)


@query("impute_parts", "O-46", impute_sql(SHIP_M, "MONTH", 12, 8))
def impute_parts(spark, sf):
    return R.round_numeric(Q.impute(ship_monthly(spark, sf), "month", 12), 8)


@query("impute_box_cox_scale", "O-46")
def impute_box_cox_scale(spark, sf):
    return Q.impute(orders_daily(spark, sf), "day", 7, box_cox=True)


def anomaly_sql(period, alpha, share):
    return decompose_sql(period) + f""",
q AS (SELECT id, quantile_cont(remainder, 0.25) AS q25, quantile_cont(remainder, 0.75) AS q75, count(*) AS n
  FROM dec GROUP BY id),
li AS (SELECT dec.*, n, q25 - {0.15 / alpha} * (q75 - q25) AS lo, q75 + {0.15 / alpha} * (q75 - q25) AS hi
  FROM dec JOIN q ON dec.id = q.id),
sc AS (SELECT *, abs(remainder - (lo + hi) / 2) AS score FROM li),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, date) AS place,
  (abs(trend) + abs(season)) * 1e-9 AS tol FROM sc),
an AS (SELECT *, (remainder < lo - tol OR remainder > hi + tol) AND place <= floor(n * {share}) AS flag FROM rk),
anom AS (SELECT id, date, value AS observed, season, trend, remainder, value - season AS seasadj,
  CASE WHEN flag THEN 'Yes' ELSE 'No' END AS anomaly,
  CASE WHEN NOT flag THEN 0 WHEN remainder < lo THEN -1 ELSE 1 END AS anomaly_direction, score AS anomaly_score,
  season + trend + lo AS recomposed_l1, season + trend + hi AS recomposed_l2,
  CASE WHEN flag THEN season + trend + 0.75 * CASE WHEN remainder < lo THEN lo ELSE hi END ELSE value END
  AS observed_clean FROM an)"""


@query("detect_anomalies", "O-54", with_sql(EVENTS_H, anomaly_sql(24, 0.05, 0.2), """
SELECT id, date, round(observed, 7) AS observed, round(season, 7) AS season, round(trend, 7) AS trend,
  round(remainder, 7) AS remainder, round(seasadj, 7) AS seasadj, anomaly, anomaly_direction,
  round(anomaly_score, 7) AS anomaly_score, round(recomposed_l1, 7) AS recomposed_l1,
  round(recomposed_l2, 7) AS recomposed_l2, round(observed_clean, 7) AS observed_clean FROM anom"""))
def detect_anomalies(spark, sf):
    return R.round_numeric(Q.detect_anomalies(events_hourly(spark, sf), 24, 0.05, 0.2), 7)


@query("anomaly_report", "O-16", with_sql(SHIP_M, anomaly_sql(12, 0.05, 0.2), """
SELECT id, date, round(observed, 4) AS observed, round(observed_clean, 4) AS cleaned, anomaly_direction
FROM anom WHERE anomaly = 'Yes'"""))
def anomaly_report(spark, sf):
    return Q.anomaly_report(Q.detect_anomalies(ship_monthly(spark, sf), 12, 0.05, 0.2), 4)


@query("clean_anomalies", "O-55 O-28", with_sql(ORDERS_M, anomaly_sql(12, 0.1, 0.2), """
SELECT p.id, p.date, round(coalesce(observed_clean, value), 1) AS value FROM p LEFT JOIN anom
ON p.id = anom.id AND p.date = anom.date"""))
def clean_anomalies(spark, sf):
    panel = orders_monthly(spark, sf)
    return R.round_numeric(Q.clean_anomalies(panel, Q.detect_anomalies(panel, 12, 0.1, 0.2)), 1)
