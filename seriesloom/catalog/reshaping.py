"""Projection, filter, reshape, join, union and text queries."""

from pyspark.sql import functions as F

from seriesloom.catalog.panels import REGRESSORS, regressors
from seriesloom.catalog.registry import (
    ORDERS_D, ORDERS_M, SHIP_M, orders_daily, orders_monthly, query, ship_monthly, table, with_sql,
)
from seriesloom.constants import FREQUENCY_LABELS, default_params
from seriesloom.functions import text
from seriesloom.operators import panel as P
from seriesloom.operators import reshape as R


@query("pick_columns", "O-11", """
SELECT l_shipdate AS date, l_partkey AS part, l_quantity, l_extendedprice FROM lineitem""")
def pick_columns(spark, sf):
    return R.pick_columns(table(spark, sf, "lineitem"),
                          ["l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_tax", "not_there"],
                          "tax|discount", {"l_partkey": "part", "l_shipdate": "date"}, ["l_shipdate"])


@query("date_range", "O-12", with_sql(ORDERS_D, """
SELECT id, date, value FROM p WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'"""))
def date_range(spark, sf):
    return R.between_dates(orders_daily(spark, sf), "1996-01-01", "1997-12-31")


@query("drop_missing_rows", "O-13", with_sql(SHIP_M, """
SELECT id, date, value, lag(value, 12) OVER (PARTITION BY id ORDER BY date) AS lag12 FROM p
QUALIFY lag(value, 12) OVER (PARTITION BY id ORDER BY date) IS NOT NULL"""))
def drop_missing_rows(spark, sf):
    lagged = ship_monthly(spark, sf).withColumn("lag12", F.lag("value", 12).over(P.by_date()))
    return R.drop_missing(lagged)


@query("unpivot_regressors", "O-17", f"""
WITH x AS ({REGRESSORS}) SELECT id, date, 'n_orders' AS name, n_orders AS value FROM x
UNION ALL SELECT id, date, 'avg_price' AS name, avg_price AS value FROM x""")
def unpivot_regressors(spark, sf):
    return R.to_long(regressors(spark, sf), ["id", "date"], ["n_orders", "avg_price"])


@query("pivot_priorities", "O-18", with_sql(ORDERS_M, """
SELECT date, max(value) FILTER (id = '1-URGENT') AS urgent, max(value) FILTER (id = '2-HIGH') AS high,
  max(value) FILTER (id = '5-LOW') AS low FROM p GROUP BY date"""))
def pivot_priorities(spark, sf):
    wide = R.to_wide(orders_monthly(spark, sf), ["date"], "id", "value", ["1-URGENT", "2-HIGH", "5-LOW"])
    return R.pick_columns(wide, rename={"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query("apply_across_columns", "O-19 O-75", """
SELECT l_orderkey, l_linenumber, round(l_quantity / 10, 1) AS l_quantity,
  round(l_extendedprice / 10, 1) AS l_extendedprice FROM lineitem""")
def apply_across_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return R.apply_to_columns(df, ["l_quantity", "l_extendedprice"], lambda c: F.round(c / 10, 1))


@query("conditional_bands", "O-20", """
SELECT band, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000
  THEN 'medium' ELSE 'large' END AS band FROM orders) GROUP BY band""")
def conditional_bands(spark, sf):
    price = F.col("o_totalprice")
    band = F.when(price < 50000, "small").when(price < 200000, "medium").otherwise("large")
    return table(spark, sf, "orders").select(band.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("drop_constant_columns", "O-21", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def drop_constant_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             F.lit(1).alias("one"), F.lit("x").alias("label"))
    return R.drop_constant(df, ["l_quantity", "l_linenumber", "one", "label"])


NZV = "l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus".split()


@query("near_zero_variance", "O-22", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level FROM lineitem" for c in NZV) + """
  UNION ALL SELECT 'rare_flag', CASE WHEN l_quantity = 1 AND l_linenumber = 7 THEN 'y' ELSE 'n' END FROM lineitem),
c AS (SELECT variable, level, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC) AS place FROM c),
s AS (SELECT variable, coalesce(max(n) FILTER (place = 1) * 1.0 / max(n) FILTER (place = 2), 0) AS freq_ratio,
  count(*) * 100.0 / sum(n) AS percent_unique, count(*) = 1 AS zero_var FROM r GROUP BY variable)
SELECT variable, round(CAST(freq_ratio AS DOUBLE), 6) AS freq_ratio,
  round(CAST(percent_unique AS DOUBLE), 6) AS percent_unique, zero_var,
  zero_var OR (freq_ratio > 19 AND percent_unique <= 5) AS nzv FROM s""")
def near_zero_variance(spark, sf):
    rare = F.when((F.col("l_quantity") == 1) & (F.col("l_linenumber") == 7), "y").otherwise("n")
    df = table(spark, sf, "lineitem").withColumn("rare_flag", rare)
    return R.round_numeric(R.near_zero_variance(df, NZV + ["rare_flag"]), 6)


@query("constant_test", "O-23", """
SELECT 'l_quantity' AS variable, count(DISTINCT l_quantity) = 1 AS is_constant FROM lineitem
UNION ALL SELECT 'one', true UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) = 1 FROM lineitem""")
def constant_test(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("one", F.lit(1))
    return R.constant_report(df, ["l_quantity", "one", "l_tax"])


@query("one_hot_segments", "O-24", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_building,
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_furniture,
  CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_household,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_machinery FROM customer""")
def one_hot_segments(spark, sf):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return R.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", levels)


@query("join_external_regressors", "O-27", with_sql(ORDERS_M, f"x AS ({REGRESSORS})", """
SELECT p.id, p.date, p.value, x.n_orders, x.avg_price FROM p LEFT JOIN x ON p.id = x.id AND p.date = x.date"""))
def join_external_regressors(spark, sf):
    return R.join_regressors(orders_monthly(spark, sf), regressors(spark, sf))


@query("union_panels", "O-29", with_sql(ORDERS_M, """
SELECT id, date, value, CAST(NULL AS DOUBLE) AS n_orders FROM p UNION ALL
SELECT id, date, CAST(NULL AS DOUBLE), n_orders FROM (""" + REGRESSORS + ")"))
def union_panels(spark, sf):
    return R.stack(orders_monthly(spark, sf), regressors(spark, sf).drop("avg_price"))


@query("features_beside_data", "O-30", with_sql(SHIP_M, """
SELECT id, date, value, CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month,
  row_number() OVER (PARTITION BY id ORDER BY date) AS time_trend FROM p"""))
def features_beside_data(spark, sf):
    return ship_monthly(spark, sf).withColumns({
        "year": F.year("date").cast("bigint"), "month": F.month("date").cast("bigint"),
        "time_trend": F.row_number().over(P.by_date()).cast("bigint")})


@query("distinct_rows", "O-31", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("models_by_levels", "O-32 O-141", """
SELECT o_orderpriority AS id, CAST(lv AS DOUBLE) AS conf_lvl, count(*) AS n
FROM orders, (SELECT unnest([0.8, 0.85, 0.9, 0.95]) AS lv) GROUP BY 1, 2""")
def models_by_levels(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    return R.with_levels(counts, R.levels_of(0.8, 0.95)).withColumn("conf_lvl", F.col("conf_lvl").cast("double"))


@query("parse_text_lists", "O-73", """
SELECT c_mktsegment AS id, list_sum(list_transform(string_split(replace(settings, ' ', ''), ','),
  lambda x: CAST(x AS DOUBLE))) AS total, CAST(len(string_split(replace(settings, ' ', ''), ',')) AS BIGINT) AS n
FROM (SELECT c_mktsegment, count(*) || ', ' || max(c_nationkey) || ' ,12, 24' AS settings FROM customer GROUP BY 1)
""")
def parse_text_lists(spark, sf):
    settings = F.concat(F.count(F.lit(1)), F.lit(", "), F.max("c_nationkey"), F.lit(" ,12, 24"))
    df = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("id")).agg(settings.alias("settings"))
    numbers = text.parse_list(F.col("settings"))
    total = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)
    return df.select("id", total.alias("total"), F.size(numbers).cast("bigint").alias("n"))


@query("clean_strings", "O-74", """
SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS name, p_name AS raw,
  array_to_string(list_transform(string_split(replace(lower(replace(p_name, ' ', '_')), '_', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part""")
def clean_strings(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_name").alias("raw")).distinct()
    return df.withColumn("name", text.to_name(F.col("raw"))).withColumn("label", text.to_label(F.col("name")))


@query("edited_cells", "O-10", with_sql(ORDERS_M, """
e AS (SELECT id, date, round(value / 2, 4) AS edit FROM p WHERE month(date) = 12 AND year(date) = 1999)""", """
SELECT p.id, p.date, coalesce(e.edit, p.value) AS value, e.edit IS NOT NULL AS edited
FROM p LEFT JOIN e ON p.id = e.id AND p.date = e.date"""))
def edited_cells(spark, sf):
    from seriesloom.operators.quality import apply_edits

    panel = orders_monthly(spark, sf)
    chosen = (F.month("date") == 12) & (F.year("date") == 1999)
    edits = panel.where(chosen).select("id", "date", F.round(F.col("value") / 2, 4).alias("value"))
    return apply_edits(panel, edits)


PARSE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in FREQUENCY_LABELS.items() if v)


@query("frequency_labels", "O-36", f"""
SELECT label, CAST(CASE label {PARSE} END AS BIGINT) AS frequency, count(*) AS n FROM (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Month (12)' WHEN '2-HIGH' THEN 'Week (52)'
    WHEN '3-MEDIUM' THEN 'Half-hour (48)' WHEN '5-LOW' THEN 'Auto' ELSE 'Quarter (4)' END AS label FROM orders)
GROUP BY label""")
def frequency_labels(spark, sf):
    from seriesloom.operators.describe import parse_frequency

    p = F.col("o_orderpriority")
    label = (F.when(p == "1-URGENT", "Month (12)").when(p == "2-HIGH", "Week (52)")
             .when(p == "3-MEDIUM", "Half-hour (48)").when(p == "5-LOW", "Auto").otherwise("Quarter (4)"))
    df = table(spark, sf, "orders").select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return df.select("label", parse_frequency(F.col("label")).cast("bigint").alias("frequency"), "n")


@query("tuned_parameters_lookup", "O-150", """
SELECT o_orderpriority AS id, CASE WHEN count(*) % 2 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS penalty,
  0.5::DOUBLE AS mixture
FROM orders GROUP BY 1""")
def tuned_parameters_lookup(spark, sf):
    from seriesloom.plans.tuning import with_tuned

    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(
        F.count(F.lit(1)).alias("n"))
    tuned = counts.where(F.col("n") % 2 == 0).select(
        "id", F.lit("Elastic Net").alias("method"), F.create_map(F.lit("penalty"), F.lit(0.25)).alias("params"))
    wanted = counts.select("id", F.lit("Elastic Net").alias("method"))
    full = with_tuned(wanted, tuned, {"Elastic Net": default_params("Elastic Net")})
    return full.select("id", F.col("params")["penalty"].alias("penalty"), F.col("params")["mixture"].alias("mixture"))
