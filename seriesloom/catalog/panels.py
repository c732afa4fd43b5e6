"""Sources, sinks, series building, grids, splits and folds."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import (
    EVENTS_H, FLAG_M, ORDERS_D, ORDERS_M, SHIP_M, events_hourly, flag_monthly, orders_daily, orders_monthly, query,
    ship_monthly, table, with_sql,
)
from seriesloom.operators import panel as P
from seriesloom.session import scratch_path
from seriesloom.sources import tables as S


@query("csv_series_round_trip", "O-01 O-09", ORDERS_M)
def csv_series_round_trip(spark, sf):
    path = scratch_path(spark, "series") + ".csv"
    S.write_table(orders_monthly(spark, sf).select("date", "id", "value"), path, "csv")
    return S.read_series_csv(spark, path)


@query("csv_inferred_scan", "O-01 O-02", "SELECT id AS series_id, value AS total_value FROM (" + ORDERS_M + ")")
def csv_inferred_scan(spark, sf):
    path = scratch_path(spark, "inferred") + ".csv"
    df = orders_monthly(spark, sf).select(F.col("id").alias("Series ID"), F.col("value").alias("totalValue"))
    S.write_table(df, path, "csv")
    return S.read_csv(spark, path)


@query("clean_column_names", "O-02", """
SELECT c_mktsegment AS mkt_segment, count(*) AS n_customers, round(avg(c_acctbal), 4) AS avg_balance
FROM customer GROUP BY 1""")
def clean_column_names(spark, sf):
    df = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("Mkt Segment")).agg(
        F.count(F.lit(1)).alias("N. Customers"), F.round(F.avg("c_acctbal"), 4).alias("avgBalance"))
    return S.clean_names(df)


@query("panel_check", "O-03", with_sql(ORDERS_D, """
SELECT id, count(*) AS n_rows, count(*) FILTER (date IS NULL) AS n_null_dates,
  count(*) FILTER (value IS NULL) AS n_null_values,
  count(*) - count(*) FILTER (date IS NULL) - count(DISTINCT date) AS n_duplicates,
  date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS n_gaps
FROM p GROUP BY id"""))
def panel_check(spark, sf):
    return P.check_panel(orders_daily(spark, sf), "day")


@query("raw_rows_check", "O-03", """
SELECT CAST(l_partkey AS VARCHAR) AS id, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null_dates,
  CAST(0 AS BIGINT) AS n_null_values, count(*) - count(DISTINCT l_shipdate) AS n_duplicates,
  date_diff('day', min(l_shipdate), max(l_shipdate)) + 1 - count(DISTINCT l_shipdate) AS n_gaps
FROM lineitem GROUP BY l_partkey""")
def raw_rows_check(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("id"), F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("value"))
    return P.check_panel(raw, "day")


@query("series_named_entity", "O-04", """
SELECT o_orderpriority AS id, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS date,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1, 2""")
def series_named_entity(spark, sf):
    keep = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return P.build_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "quarter",
                          decimals=2, where=keep)


@query("series_orders_monthly", "O-04 O-05", ORDERS_M)
def series_orders_monthly(spark, sf):
    return orders_monthly(spark, sf)


@query("series_parts_monthly", "O-05", SHIP_M)
def series_parts_monthly(spark, sf):
    return ship_monthly(spark, sf)


@query("series_events_half_hourly", "O-05", """
SELECT event_type AS id, time_bucket(INTERVAL 30 MINUTE, ts) AS date, CAST(count(value) AS DOUBLE) AS value
FROM events GROUP BY 1, 2""")
def series_events_half_hourly(spark, sf):
    return P.build_series(table(spark, sf, "events"), "event_type", "ts", "value", "half_hour", "count")


@query("series_weekly_mean", "O-05", """
SELECT c_mktsegment AS id, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS date,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def series_weekly_mean(spark, sf):
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    weekly = P.build_series(orders, "c_mktsegment", "o_orderdate", "o_totalprice", "week", "mean", decimals=2)
    return weekly.withColumn("value", F.round("value", 4))


@query("series_semester_median", "O-05", """
SELECT o_orderstatus AS id,
  CAST(make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1) AS TIMESTAMP) AS date,
  round(quantile_cont(o_totalprice, 0.5), 4) AS value
FROM orders GROUP BY 1, 2""")
def series_semester_median(spark, sf):
    out = P.build_series(table(spark, sf, "orders"), "o_orderstatus", "o_orderdate", "o_totalprice", "semester",
                         "median")
    return out.withColumn("value", F.round("value", 4))


@query("series_tail", "O-06 O-40", with_sql(SHIP_M, """
SELECT id, date, value FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC) <= 12"""))
def series_tail(spark, sf):
    return P.last_rows(ship_monthly(spark, sf), 12)


@query("series_all_but_tail", "O-40", with_sql(SHIP_M, """
SELECT id, date, value FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC) > 12"""))
def series_all_but_tail(spark, sf):
    return P.all_but_last_rows(ship_monthly(spark, sf), 12)


@query("series_head", "O-40", with_sql(EVENTS_H, """
SELECT id, date, value FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY date) <= 24"""))
def series_head(spark, sf):
    return P.first_rows(events_hourly(spark, sf), 24)


@query("calendar_months", "O-07", """
SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
  INTERVAL 1 MONTH)) AS date FROM orders""")
def calendar_months(spark, sf):
    return P.calendar_of(table(spark, sf, "orders"), "o_orderdate", "month")


@query("calendar_business_days", "O-07", """
SELECT date FROM (SELECT unnest(generate_series(min(o_orderdate) - to_days(greatest(isodow(min(o_orderdate))::INTEGER - 5, 0)),
  max(o_orderdate), INTERVAL 1 DAY)) AS date FROM orders) WHERE dayofweek(date) NOT IN (0, 6)""")
def calendar_business_days(spark, sf):
    return P.calendar_of(table(spark, sf, "orders"), "o_orderdate", "business_day")


@query("business_day_grid", "O-45 O-05", """
WITH r AS (SELECT o_orderpriority AS id, date_trunc('day', o_orderdate) AS d, o_totalprice::DECIMAL(18, 2) AS v FROM orders),
s AS (SELECT id, d - to_days(greatest(isodow(d)::INTEGER - 5, 0)) AS date, sum(v)::DOUBLE AS value FROM r GROUP BY 1, 2),
g AS (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM s GROUP BY id)
SELECT g.id, g.date::TIMESTAMP AS date, round(value, 0) AS value FROM g LEFT JOIN s ON g.id = s.id AND g.date = s.date
WHERE isodow(g.date) <= 5""")
def business_day_grid(spark, sf):
    """Weekend orders count for the Friday before, so the sum over the grid is that of all orders."""
    series = P.build_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "business_day",
                            decimals=2)
    return P.regular_grid(series, "business_day").select("id", "date", F.round("value", 0).alias("value"))


REGRESSORS = """SELECT o_orderpriority AS id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date,
  CAST(count(*) AS DOUBLE) AS n_orders,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price
FROM orders GROUP BY 1, 2"""


def regressors(spark, sf):
    """External regressors of the monthly panel: number of orders and average price."""
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("id"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz").alias("date"),
    ).agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
          F.round(total / F.count(F.lit(1)), 4).alias("avg_price"))


@query("csv_regressors_round_trip", "O-08 O-09", REGRESSORS)
def csv_regressors_round_trip(spark, sf):
    path = scratch_path(spark, "regressors") + ".csv"
    columns = ["date", "id", "n_orders", "avg_price"]
    S.write_table(regressors(spark, sf).select(*columns), path, "csv")
    return S.read_regressors_csv(spark, path, ["n_orders", "avg_price"])


@query("parquet_export_by_id", "O-09", FLAG_M)
def parquet_export_by_id(spark, sf):
    path = scratch_path(spark, "export")
    S.write_table(flag_monthly(spark, sf), path, "parquet", ["id"])
    return spark.read.schema("date timestamp_ntz, value double, id string").parquet(path).select("id", "date", "value")


@query("grid_days", "O-45", with_sql(ORDERS_D, """
g AS (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM p GROUP BY id)""", """
SELECT g.id, g.date, p.value FROM g LEFT JOIN p ON g.id = p.id AND g.date = p.date"""))
def grid_days(spark, sf):
    return P.regular_grid(orders_daily(spark, sf), "day")


@query("grid_parts_monthly", "O-45", with_sql(SHIP_M, """
g AS (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS date FROM p GROUP BY id)""", """
SELECT g.id, g.date, p.value FROM g LEFT JOIN p ON g.id = p.id AND g.date = p.date"""))
def grid_parts_monthly(spark, sf):
    return P.regular_grid(ship_monthly(spark, sf), "month")


@query("future_rows", "O-47 O-29", with_sql(ORDERS_M, """
f AS (SELECT id, unnest(generate_series(max(date) + INTERVAL 1 MONTH, max(date) + INTERVAL 12 MONTH,
  INTERVAL 1 MONTH)) AS date FROM p GROUP BY id)""", """
SELECT id, date, value, false AS is_future FROM p UNION ALL
SELECT id, date, CAST(NULL AS DOUBLE) AS value, true AS is_future FROM f"""))
def future_rows(spark, sf):
    return P.add_future(orders_monthly(spark, sf), 12, "month")


@query("split_train_test", "O-56", with_sql(SHIP_M, """
SELECT id, date, value, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY date DESC) <= 6
  THEN 'test' ELSE 'train' END AS split FROM p"""))
def split_train_test(spark, sf):
    return P.split_last(ship_monthly(spark, sf), 6)


FOLDS_SQL = with_sql(ORDERS_M, """
r AS (SELECT id, date, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS r,
  count(*) OVER (PARTITION BY id) AS n FROM p)""", """
f AS (SELECT r.*, fold FROM r, (SELECT unnest(range(1, 6)) AS fold))""", """
SELECT id, CAST(fold AS BIGINT) AS fold, CASE WHEN r <= (fold - 1) * 4 + 4 THEN 'test' ELSE 'train' END AS role, date
FROM f WHERE r > (fold - 1) * 4 AND n >= (fold - 1) * 4 + 4 + {min_train}
  AND r <= (fold - 1) * 4 + 4 + {train}""")


@query("cv_slices_expanding", "O-57", FOLDS_SQL.format(min_train="1", train="n"))
def cv_slices_expanding(spark, sf):
    return P.time_folds(orders_monthly(spark, sf), 24, 5, True).withColumn("fold", F.col("fold").cast("bigint"))


@query("cv_slices_rolling", "O-57", FOLDS_SQL.format(min_train="n - 24", train="n - 24"))
def cv_slices_rolling(spark, sf):
    return P.time_folds(orders_monthly(spark, sf), 24, 5, False).withColumn("fold", F.col("fold").cast("bigint"))


@query("cv_random_folds", "O-58", with_sql(SHIP_M, """
SELECT id, date, value, (('0x' || substr(md5('1992|' || id || '|' || date::TIMESTAMP::VARCHAR), 1, 8))::BIGINT % 5 + 1)::INTEGER
  AS fold FROM p"""))
def cv_random_folds(spark, sf):
    return P.random_folds(ship_monthly(spark, sf), 5)
