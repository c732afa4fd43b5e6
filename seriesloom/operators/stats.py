"""Hypothesis tests per series: normality, independence and stationarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import distributions as S
from seriesloom.operators.panel import by_date, whole

# Null hypotheses by test.
NULL_HYPOTHESES = {
    "Jarque-Bera": "Normality",
    "Shapiro-Wilk": "Normality",
    "Box-Pierce": "No autocorrelation",
    "Ljung-Box": "No autocorrelation",
    "Augmented Dickey-Fuller": "No stationarity",
    "Phillips-Perron": "No stationarity",
    "KPSS": "Stationarity",
}


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".")
            .when(p.isNotNull(), ""))


def sample(panel: DataFrame) -> DataFrame:
    """Known points of each series, all of them, with their number n and k, the number of lags of the tests."""
    known = panel.where(F.col("value").isNotNull())
    counted = known.select("id", "date", "value", F.count(F.lit(1)).over(whole()).alias("n"))
    return counted.withColumn("k", F.floor(F.pow(F.col("n") - 1, F.lit(1.0 / 3.0))).cast("int"))


def gather(points: DataFrame) -> DataFrame:
    """One row per series with everything the tests need, from one window pass and one aggregate.

    Columns that a single test does not use are pruned by the optimizer.
    """
    w = by_date()
    e = points.withColumn("e", F.col("value") - F.avg("value").over(whole()))
    e = e.withColumn("cum", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("date", "value", "e")))
    return e.groupBy("id").agg(
        F.count(F.lit(1)).alias("m"), F.first("k").alias("k"), F.skewness("value").alias("skew"),
        F.kurtosis("value").alias("kurt"), F.sum(F.col("cum") * F.col("cum")).alias("cum2"),
        F.sum(F.col("e") * F.col("e")).alias("ss"), rows.alias("rows"))


def lag_sum(lag: Column) -> Column:
    """Sum of the products of deviations ``lag`` points apart, over the rows of a series."""
    size = F.greatest(F.col("m") - lag, F.lit(0)).cast("int")
    d = F.transform("rows", lambda r: r["e"])
    pairs = F.zip_with(F.slice(d, F.lit(1), size), F.slice(d, lag + 1, size), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def lags_up_to(most: Column) -> Column:
    """1, 2, ... most; empty for 0."""
    return F.slice(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(1), F.greatest(most, F.lit(0)))


def _result(test: str, statistic: Column, p_value: Column) -> Column:
    return F.struct(F.lit(test).alias("test"), statistic.alias("statistic"), p_value.alias("p_value"))


def jarque_bera_of() -> list[Column]:
    stat = F.col("m") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return [_result("Jarque-Bera", stat, F.exp(-stat / 2))]


def kpss_of() -> list[Column]:
    """Level stationarity with Bartlett weights up to trunc(4 (n / 100)^(1/4)) lags."""
    m = F.col("m")
    lags = F.floor(4 * F.pow(m / 100.0, F.lit(0.25))).cast("int")
    spread = F.aggregate(F.transform(lags_up_to(F.least(lags, m.cast("int") - 1)),
                                     lambda i: 2.0 / m * (1 - i / (lags + 1)) * lag_sum(i)),
                         F.col("ss") / m, lambda s, x: s + x)
    stat = F.try_divide(F.col("cum2") / (m * m), spread)
    return [_result("KPSS", stat, S.kpss_p(stat))]


def with_box(gathered: DataFrame) -> DataFrame:
    """Adds bp and lb, the Box-Pierce and Ljung-Box statistics over the first k autocorrelations; k differs by id."""
    usable = F.least(F.col("k"), F.col("m").cast("int") - 1)
    df = gathered.withColumn("_r", F.transform(lags_up_to(usable), lambda lag: F.struct(
        lag.alias("lag"), F.try_divide(lag_sum(lag), F.col("ss")).alias("r"))))
    zero, m = F.lit(0.0), F.col("m")
    return df.withColumns({
        "bp": m * F.aggregate("_r", zero, lambda s, x: s + x["r"] * x["r"]),
        "lb": m * (m + 2) * F.aggregate("_r", zero, lambda s, x: s + x["r"] * x["r"] / (m - x["lag"])),
    }).drop("_r")


def box_of() -> list[Column]:
    return [_result("Box-Pierce", F.col("bp"), S.chi2_p(F.col("bp"), F.col("k"))),
            _result("Ljung-Box", F.col("lb"), S.chi2_p(F.col("lb"), F.col("k")))]


def _long(gathered: DataFrame, results: Column) -> DataFrame:
    return gathered.select("id", F.inline(results))


def jarque_bera(points: DataFrame) -> DataFrame:
    return _long(gather(points), F.array(*jarque_bera_of()))


def box_tests(points: DataFrame) -> DataFrame:
    return _long(with_box(gather(points)), F.array(*box_of()))


def kpss(points: DataFrame) -> DataFrame:
    return _long(gather(points), F.array(*kpss_of()))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inverse = np.linalg.pinv(x.T @ x, hermitian=True)
    beta = inverse @ (x.T @ y)
    rest = y - x @ beta
    sigma2 = rest @ rest / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(np.diag(inverse) * sigma2, 0)), rest


def dickey_fuller(x: np.ndarray, k: int) -> tuple[float, float]:
    """t statistic of the lagged level in the regression with constant, trend and k lagged differences."""
    step = np.diff(x)
    n = len(step)
    rows = n - k
    if rows < k + 4:
        return float("nan"), float("nan")
    y = step[k:]
    level = (x[:-1][k:] - x.mean()) / (x.std() or 1.0)  # scaling leaves the t statistic alone
    trend = np.arange(rows) / rows
    lagged = [step[k - i:n - i] for i in range(1, k + 1)]
    beta, se, _ = _ols(np.column_stack([level, np.ones(rows), trend, *lagged]), y)
    if se[0] == 0:
        return float("nan"), float("nan")
    stat = float(beta[0] / se[0])
    return stat, S.table_p(stat, n, S.ADF_VALUES)


def phillips_perron(x: np.ndarray) -> tuple[float, float]:
    """Z(alpha) with constant and trend and the short truncation lag."""
    y, before = x[1:], x[:-1]
    n = len(y)
    if n < 6 or x.std() == 0:
        return float("nan"), float("nan")
    y, before = y / x.std(), before / x.std()
    t = np.arange(1, n + 1)
    beta, _, u = _ols(np.column_stack([np.ones(n), t - n / 2, before]), y)
    short = u @ u / n
    lags = int(4 * (n / 100) ** 0.25)
    long = short + 2 / n * sum((1 - i / (lags + 1)) * (u[i:] @ u[:-i]) for i in range(1, lags + 1))
    size = float(n)
    d = (size**2 * (size**2 - 1) * (before @ before) / 12 - size * (before @ t) ** 2
         + size * (size + 1) * (before @ t) * before.sum()
         - size * (size + 1) * (2 * size + 1) * before.sum() ** 2 / 6)
    stat = float(size * (beta[2] - 1) - size**6 / (24 * d) * (long - short))
    return stat, S.table_p(stat, n, S.PP_VALUES)


def array_results() -> Column:
    """Shapiro-Wilk, augmented Dickey-Fuller and Phillips-Perron over all points of a series."""

    @F.pandas_udf("array<struct<test:string,statistic:double,p_value:double>>")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for values, lags in zip(x, k):
            v = np.asarray(values, dtype=float)
            found = {"Shapiro-Wilk": S.shapiro(v), "Augmented Dickey-Fuller": dickey_fuller(v, int(lags)),
                     "Phillips-Perron": phillips_perron(v)}
            out.append([{"test": t, "statistic": None if s != s else s, "p_value": None if p != p else p}
                        for t, (s, p) in found.items()])
        return pd.Series(out)

    return run(F.transform("rows", lambda r: r["value"]), F.col("k"))


def array_tests(points: DataFrame) -> DataFrame:
    return _long(gather(points), array_results())


def test_battery(panel: DataFrame, digits: int = 4) -> DataFrame:
    """All seven tests per series: test, h0, statistic, p_value, signif. One scan, one exchange."""
    wide = with_box(gather(sample(panel)))
    wide = wide.withColumn("_native", F.array(*jarque_bera_of(), *box_of(), *kpss_of())).withColumn(
        "_arrays", array_results())
    both = wide.select("id", F.inline(F.concat("_native", "_arrays")))
    h0 = F.create_map(*[v for k, h in NULL_HYPOTHESES.items() for v in (F.lit(k), F.lit(h))])
    return both.select(
        "id", "test", h0[F.col("test")].alias("h0"), F.round("statistic", digits).alias("statistic"),
        F.round("p_value", digits).alias("p_value"), stars(F.col("p_value")).alias("signif"))
