"""Hypothesis tests and metrics."""

from pyspark.sql import functions as F

from seriesloom.catalog.registry import (
    ORDERS_D, ORDERS_M, SHIP_M, orders_daily, orders_monthly, query, ship_monthly, with_sql,
)
from seriesloom.operators import reshape as R
from seriesloom.operators import stats as S


@query("test_jarque_bera", "O-89", with_sql(ORDERS_D, """
c AS (SELECT id, value - avg(value) OVER (PARTITION BY id) AS d FROM p)""", """
m AS (SELECT id, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY id)
""", """
j AS (SELECT id, n / 6.0::DOUBLE * (m3 * m3 / (m2 * m2 * m2) + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4) AS s
  FROM m)""", """
SELECT id, 'Jarque-Bera' AS test, round(s, 5) AS statistic, round(exp(-s / 2), 7) AS p_value FROM j"""))
def test_jarque_bera(spark, sf):
    out = S.jarque_bera(S.sample(orders_daily(spark, sf)))
    return out.withColumn("statistic", F.round("statistic", 5)).withColumn("p_value", F.round("p_value", 7))


BOX_SQL = """
k AS (SELECT id, count(*) AS n, CAST(floor(pow(count(*) - 1, 1.0 / 3.0::DOUBLE)) AS INTEGER) AS k
  FROM p GROUP BY id),
d AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) AS t,
  value - avg(value) OVER (PARTITION BY id) AS d FROM p),
c0 AS (SELECT id, sum(d * d) AS c0 FROM d GROUP BY id),
lg AS (SELECT id, unnest(range(1, k + 1)) AS lag FROM k),
ck AS (SELECT a.id, lag, sum(a.d * b.d) AS ck FROM d a JOIN lg ON a.id = lg.id JOIN d b ON a.id = b.id
  AND b.t = a.t - lag GROUP BY a.id, lag),
r AS (SELECT ck.id, lag, n, ck / nullif(c0, 0) AS r FROM ck JOIN c0 ON ck.id = c0.id JOIN k ON k.id = ck.id)"""


@query("test_box", "O-91", with_sql(SHIP_M, BOX_SQL, """
SELECT id, round(n * sum(r * r), 6) AS box_pierce, round(n * (n + 2) * sum(r * r / (n - lag)), 6) AS ljung_box
FROM r GROUP BY id, n"""))
def test_box(spark, sf):
    long = S.box_tests(S.sample(ship_monthly(spark, sf)))
    wide = R.to_wide(long, ["id"], "test", "statistic", ["Box-Pierce", "Ljung-Box"])
    wide = R.pick_columns(wide, rename={"Box-Pierce": "box_pierce", "Ljung-Box": "ljung_box"})
    return R.round_numeric(wide, 6)


@query("test_kpss", "O-94", with_sql(ORDERS_D, """
e AS (SELECT id, date, value - avg(value) OVER (PARTITION BY id) AS e, count(*) OVER (PARTITION BY id) AS n FROM p)""",
"""
c AS (SELECT *, sum(e) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum,
  row_number() OVER (PARTITION BY id ORDER BY date) AS t, floor(4 * pow(n / 100.0::DOUBLE, 0.25::DOUBLE)) AS l
  FROM e)""", """
b AS (SELECT id, n, sum(cum * cum) / (n * n) AS eta, sum(e * e) / n AS s0 FROM c GROUP BY id, n)""", """
x AS (SELECT a.id, sum(2.0::DOUBLE / a.n * (1 - i / (a.l + 1)) * a.e * z.e) AS s1 FROM c a
  JOIN (SELECT unnest(range(1, 11)) AS i) ON i <= a.l JOIN c z ON a.id = z.id AND z.t = a.t - i GROUP BY a.id)""", """
SELECT b.id, 'KPSS' AS test, round(eta / (s0 + s1), 7) AS statistic FROM b JOIN x ON b.id = x.id"""))
def test_kpss(spark, sf):
    out = S.kpss(S.sample(orders_daily(spark, sf)))
    return out.select("id", "test", F.round("statistic", 7).alias("statistic"))


@query("test_dickey_fuller_statistics", "O-92 O-93 O-90")
def test_dickey_fuller_statistics(spark, sf):
    return S.array_tests(S.sample(orders_daily(spark, sf)))


@query("test_dickey_fuller", "O-92", with_sql(ORDERS_D, """
x AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) AS t, value AS y,
  lag(value) OVER (PARTITION BY id ORDER BY date) AS l FROM p)""", """
r AS (SELECT id, regr_slope(y - l, t) AS bd, regr_intercept(y - l, t) AS ad, regr_slope(l, t) AS bl,
  regr_intercept(l, t) AS al, count(l) AS n FROM x WHERE l IS NOT NULL GROUP BY id)""", """
e AS (SELECT x.id, n, y - l - ad - bd * t AS d, l - al - bl * t AS v FROM x JOIN r ON x.id = r.id
  WHERE l IS NOT NULL)""", """
b AS (SELECT id, n, sum(d * v) / sum(v * v) AS b, sum(v * v) AS vv, sum(d * d) AS dd FROM e GROUP BY id, n)""", """
SELECT id, 'Augmented Dickey-Fuller' AS test, round(b / sqrt((dd - b * b * vv) / (n - 3) / vv), 6) AS statistic
FROM b"""))
def test_dickey_fuller(spark, sf):
    """Without lagged differences, so that SQL can follow; the battery uses k of them."""
    points = S.sample(orders_daily(spark, sf)).withColumn("k", F.lit(0))
    out = S.array_tests(points).where("test = 'Augmented Dickey-Fuller'")
    return out.select("id", "test", F.round("statistic", 6).alias("statistic"))


@query("test_phillips_perron", "O-93", with_sql(ORDERS_D, """
x AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS t, value / stddev_pop(value) OVER (PARTITION
  BY id) AS y FROM p)""", """
z AS (SELECT id, t, y, lag(y) OVER (PARTITION BY id ORDER BY t) AS l FROM x)""", """
r AS (SELECT id, regr_slope(y, t) AS gy, regr_intercept(y, t) AS ay, regr_slope(l, t) AS bl, regr_intercept(l, t) AS al,
  CAST(count(l) AS DOUBLE) AS n, sum(l * l) AS ll, sum(l * t) AS lt, sum(l) AS sl FROM z WHERE l IS NOT NULL
  GROUP BY id)""", """
e AS (SELECT z.id, t, y - ay - gy * t AS d, l - al - bl * t AS v FROM z JOIN r ON z.id = r.id WHERE l IS NOT NULL)""",
"""
b AS (SELECT id, sum(d * v) / sum(v * v) AS a FROM e GROUP BY id)""", """
u AS (SELECT e.id, t, d - a * v AS u FROM e JOIN b ON e.id = b.id)""", """
s0 AS (SELECT id, sum(u * u) / count(*) AS s, floor(4 * pow(count(*) / 100.0::DOUBLE, 0.25::DOUBLE)) AS lags,
  count(*) AS n FROM u GROUP BY id)""", """
s1 AS (SELECT a.id, sum((1 - i / (lags + 1)) * a.u * c.u) * 2 / max(s0.n) AS extra FROM u a JOIN s0 ON a.id = s0.id
  JOIN (SELECT unnest(range(1, 11)) AS i) ON i <= lags JOIN u c ON c.id = a.id AND c.t = a.t - i GROUP BY a.id)""", """
q AS (SELECT r.*, n * n * (n * n - 1) * ll / 12 - n * lt * lt + n * (n + 1) * lt * sl
  - n * (n + 1) * (2 * n + 1) * sl * sl / 6 AS dx FROM r)""", """
SELECT q.id, 'Phillips-Perron' AS test, round(q.n * (a - 1) - pow(q.n, 6) / (24 * dx) * extra, 3) AS statistic
FROM q JOIN b ON q.id = b.id JOIN s1 ON s1.id = q.id"""))
def test_phillips_perron(spark, sf):
    out = S.array_tests(S.sample(orders_daily(spark, sf))).where("test = 'Phillips-Perron'")
    return out.select("id", "test", F.round("statistic", 3).alias("statistic"))


@query("test_battery", "O-95 O-89 O-90 O-91 O-92 O-93 O-94")
def test_battery(spark, sf):
    return S.test_battery(orders_monthly(spark, sf))


@query("significance_stars", "O-95 O-20", with_sql(ORDERS_M, """
r AS (SELECT id, count(*) AS n, value FROM p GROUP BY id, value)""", """
q AS (SELECT id, avg(value) AS m FROM p GROUP BY id)""", """
s AS (SELECT id, CASE id WHEN '1-URGENT' THEN 0.0005 WHEN '2-HIGH' THEN 0.005 WHEN '3-MEDIUM' THEN 0.02
  WHEN '5-LOW' THEN 0.5 ELSE 0.07 END AS pv FROM q)""", """
SELECT id, CASE WHEN pv < 0.001 THEN '***' WHEN pv < 0.01 THEN '**' WHEN pv < 0.05 THEN '*' WHEN pv < 0.1 THEN '.'
  ELSE '' END AS signif FROM s"""))
def significance_stars(spark, sf):
    i = F.col("id")
    p = (F.when(i == "1-URGENT", 0.0005).when(i == "2-HIGH", 0.005).when(i == "3-MEDIUM", 0.02)
         .when(i == "5-LOW", 0.5).otherwise(0.07))
    ids = orders_monthly(spark, sf).groupBy("id").agg(F.avg("value").alias("m"))
    return ids.select("id", S.stars(p).alias("signif"))
