"""Transforms and their inverses."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import (
    FLAG_M, ORDERS_M, SHIP_M, flag_monthly, orders_monthly, query, ship_monthly, with_sql,
)
from seriesloom.operators import reshape as R
from seriesloom.operators import transform as T


def one_step(name, covers, step, sql, digits=6, base=SHIP_M, source=ship_monthly, period=12):
    """Register the forward transform of one step."""

    @query(f"transform_{name}", covers, with_sql(base, *sql) if isinstance(sql, tuple) else with_sql(base, sql))
    def run(spark, sf):
        out, _ = T.transform_panel(source(spark, sf), [step], period)
        return R.round_numeric(out, digits)


one_step("negate", "O-60", "Multiply by -1", "SELECT id, date, -value AS value FROM p")
one_step("add_one", "O-61", "Add 1", "SELECT id, date, value + 1 AS value FROM p")
one_step("log", "O-62", "Log", "SELECT id, date, round(ln(value), 6) AS value FROM p")
one_step("log_interval", "O-64", "Log-Interval", """
SELECT id, date, round(ln(value / (1.2::DOUBLE * max(value) OVER (PARTITION BY id) - value)), 6) AS value FROM p""")
one_step("min_max", "O-65", "Min-Max", """
SELECT id, date, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS value
FROM p WINDOW w AS (PARTITION BY id)""")
one_step("standardise", "O-66", "Standardization", """
SELECT id, date, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value
FROM p WINDOW w AS (PARTITION BY id)""")
one_step("difference", "O-67", "Differencing", """
SELECT id, date, value - lag(value) OVER w AS value FROM p WINDOW w AS (PARTITION BY id ORDER BY date)
QUALIFY row_number() OVER w > 1""")
one_step("seasonal_difference", "O-68", "Seasonal Differencing", """
SELECT id, date, value - lag(value, 12) OVER w AS value FROM p WINDOW w AS (PARTITION BY id ORDER BY date)
QUALIFY row_number() OVER w > 12""")

GUERRERO = ("""
b AS (SELECT id, value, (row_number() OVER (PARTITION BY id ORDER BY date DESC) - 1) // 12 AS block,
  count(*) OVER (PARTITION BY id) // 12 AS n_blocks FROM p)""", """
s AS (SELECT id, block, avg(value) AS m, stddev_samp(value) AS s FROM b WHERE block < n_blocks GROUP BY 1, 2)""", """
g AS (SELECT id, CAST(-1 + 0.05 * k AS DOUBLE) AS lam, s / pow(m, 1 - CAST(-1 + 0.05 * k AS DOUBLE)) AS r
  FROM s, (SELECT unnest(range(0, 61)) AS k))""", """
cv AS (SELECT id, lam, round(stddev_samp(r) / avg(r), 10) AS cv FROM g GROUP BY 1, 2)""", """
la AS (SELECT id, round(first(lam ORDER BY cv, lam), 2) AS lam FROM cv GROUP BY id)""")


@query("box_cox_lambda", "O-63", with_sql(ORDERS_M, *GUERRERO, "SELECT id, lam AS lambda FROM la"))
def box_cox_lambda(spark, sf):
    return T.guerrero_lambda(orders_monthly(spark, sf), 12)


one_step("box_cox", "O-63", "Box-Cox", GUERRERO + ("""
SELECT p.id, date, round(CASE WHEN lam = 0 THEN ln(value) ELSE (pow(value, lam) - 1) / nullif(lam, 0) END, 4) AS value
FROM p JOIN la ON p.id = la.id""",), 4, FLAG_M, flag_monthly)

CHAIN = ["Standardization", "Add 1", "Log", "Min-Max", "Multiply by -1"]
CHAIN_ORDER = ["Add 1", "Log", "Min-Max", "Standardization"]


@query("transform_chain", "O-59", with_sql(SHIP_M, """
a AS (SELECT id, date, ln(value + 1) AS v FROM p)""", """
b AS (SELECT id, date, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS v FROM a
  WINDOW w AS (PARTITION BY id))""", """
SELECT id, date, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) AS value FROM b
WINDOW w AS (PARTITION BY id)"""))
def transform_chain(spark, sf):
    return R.round_numeric(T.transform_panel(ship_monthly(spark, sf), CHAIN_ORDER[::-1])[0], 6)


@query("transform_parameters", "O-59", with_sql(SHIP_M, """
a AS (SELECT id, ln(value + 1) AS v FROM p)""", """
m AS (SELECT id, min(v) AS lo, max(v) AS hi FROM a GROUP BY id)""", """
b AS (SELECT a.id, (v - lo) / nullif(hi - lo, 0) AS v FROM a JOIN m ON a.id = m.id)""", """
z AS (SELECT id, avg(v) AS mean, stddev_samp(v) AS sd FROM b GROUP BY id)""", """
SELECT m.id, round(lo, 7) AS mm_low, round(hi, 7) AS mm_high, round(mean, 7) AS z_mean, round(sd, 7) AS z_sd
FROM m JOIN z ON m.id = z.id"""))
def transform_parameters(spark, sf):
    _, params = T.transform_panel(ship_monthly(spark, sf), CHAIN_ORDER)
    long = T.params_long(params)
    flat = long.select("id", F.explode("params").alias("name", "v"))
    return R.round_numeric(R.to_wide(flat, ["id"], "name", "v", ["mm_low", "mm_high", "z_mean", "z_sd"]), 7)


ALL_VALUE_STEPS = ["Add 1", "Log", "Box-Cox", "Log-Interval", "Min-Max", "Standardization"]


@query("transform_round_trip", "O-69", with_sql(FLAG_M, "SELECT id, date, round(value, 3) AS value FROM p"))
def transform_round_trip(spark, sf):
    out, params = T.transform_panel(flag_monthly(spark, sf), ALL_VALUE_STEPS, 12)
    return R.round_numeric(T.invert_panel(out, params, ALL_VALUE_STEPS), 3)


@query("difference_round_trip", "O-70 O-148", with_sql(SHIP_M, "SELECT id, date, value FROM p"))
def difference_round_trip(spark, sf):
    steps = ["Multiply by -1", "Differencing", "Seasonal Differencing"]
    out, params = T.transform_panel(ship_monthly(spark, sf), steps, 12)
    return R.round_numeric(T.invert_panel(out, params, steps), 6)


@query("difference_seed_rows", "O-148", with_sql(ORDERS_M, """
SELECT id, CAST(NULL AS INTEGER) AS model_id, 'ACTUAL' AS model_desc, 'actual' AS key, date, value,
  CAST(NULL AS DOUBLE) AS conf_lo, CAST(NULL AS DOUBLE) AS conf_hi FROM p
QUALIFY row_number() OVER (PARTITION BY id ORDER BY date) <= 12"""))
def difference_seed_rows(spark, sf):
    _, params = T.transform_panel(orders_monthly(spark, sf), ["Seasonal Differencing"], 12)
    return T.seed_rows(params, "sd").drop("conf_lvl")
