"""Profiles, summaries, decomposition, autocorrelation and distributions of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.constants import ACF_LAG_MULTIPLE, DEFAULT_HORIZON, FREQUENCY_LABELS
from seriesloom.functions import periods
from seriesloom.functions.text import let
from seriesloom.operators.panel import by_date, whole


def _lookup(col: Column, table: dict) -> Column:
    out = F.lit(None).cast("int")
    for key, value in table.items():
        if value is not None:
            out = F.when(col == F.lit(key), F.lit(value)).otherwise(out)
    return out


def parse_frequency(label: Column) -> Column:
    """Frequency of a label; Auto is null, an unknown label raises an error."""
    known = label.isin(list(FREQUENCY_LABELS))
    return F.when(known, _lookup(label, FREQUENCY_LABELS)).otherwise(
        F.raise_error(F.concat(F.lit("unknown frequency "), label)).cast("int"))


def default_horizon(frequency: Column) -> Column:
    return _lookup(frequency, DEFAULT_HORIZON)


def acf_lags(frequency: Column, horizon: Column) -> Column:
    return horizon * _lookup(frequency, ACF_LAG_MULTIPLE)


def infer_frequency(panel: DataFrame) -> DataFrame:
    """Per id: scale of the median step, and frequency = median number of rows in the next larger calendar unit."""
    stepped = panel.select(
        "id", "date", (periods.epoch_seconds(F.col("date"))
                       - periods.epoch_seconds(F.lag("date").over(by_date()))).alias("step"))
    typical = stepped.groupBy("id").agg(F.percentile("step", 0.5).alias("typical_step"))
    day = 86400
    s = F.col("typical_step")
    scale = (
        F.when(s < 3600, "minute").when(s < day, "hour").when(s < 7 * day, "day").when(s < 28 * day, "week")
        .when(s < 89 * day, "month").when(s < 360 * day, "quarter").otherwise("year")
    )
    scaled = panel.select("id", "date").join(typical.select("id", scale.alias("scale")), "id")
    bucket = F.col("date")
    for name, grain in (("minute", "day"), ("hour", "day"), ("day", "week"), ("week", "quarter"),
                        ("month", "year"), ("quarter", "year")):
        bucket = F.when(F.col("scale") == name, periods.truncate(F.col("date"), grain)).otherwise(bucket)
    counts = scaled.groupBy("id", "scale", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("id", "scale").agg(
        F.round(F.percentile("n", 0.5)).cast("int").alias("frequency"))


def series_profile(panel: DataFrame, frequency: int | None = None) -> DataFrame:
    """Per id: length, span, frequency, default horizon, hold-out size and number of ACF lags."""
    base = panel.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    if frequency is None:
        base = base.join(infer_frequency(panel).drop("scale"), "id")
    else:
        base = base.withColumn("frequency", F.lit(frequency))
    # frequencies outside the table follow the nearest larger known one
    f = F.col("frequency")
    known = F.when(f <= 2, f).when(f <= 4, 4).when(f == 5, 5).when(f <= 7, 7).when(f <= 12, 12).when(
        f <= 13, 13).when(f <= 24, 24).when(f <= 48, 48).otherwise(52)
    return base.withColumn("horizon", default_horizon(known)).withColumn(
        "n_assess", F.round(F.col("n") * 0.2).cast("int")
    ).withColumn("acf_lags", acf_lags(known, F.col("horizon")))


def summarise(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Per group and column: rows, missing, complete rate, mean, sd, quartiles, distinct values."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "variable", "value")
    x = F.col("value")
    out = long.groupBy(*keys, "variable").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(x.isNull()).alias("n_missing"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.percentile(x, [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"),
        F.count_distinct(x).alias("n_unique"),
    )
    q = F.col("q")
    return out.select(
        *keys, "variable", "n_rows", "n_missing",
        (1 - F.col("n_missing") / F.col("n_rows")).alias("complete_rate"), "mean", "sd",
        *[q[i].alias(n) for i, n in enumerate(("p0", "p25", "p50", "p75", "p100"))], "n_unique")


def histogram(panel: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins between the smallest and largest value of each id."""
    x = F.col("value")
    spread = panel.where(x.isNotNull()).select(
        "id", "value", F.min(x).over(whole()).alias("lo"), F.max(x).over(whole()).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(x - F.col("lo"), width)), F.lit(0)).cast("int")
    binned = spread.withColumn("bin", F.least(place, F.lit(bins - 1)) + 1)
    return binned.groupBy("id", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("lo") + width * (F.col("bin") - 1)).alias("bin_start"))


def density(panel: DataFrame, points: int = 64) -> DataFrame:
    """Gaussian kernel density on a grid per id: one sum per grid point, so no row is repeated."""
    x = F.col("value")
    stats = panel.where(x.isNotNull()).select(
        "id", "value", F.count(x).over(whole()).alias("n"), F.stddev_samp(x).over(whole()).alias("sd"),
        F.percentile(x, [0.25, 0.75]).over(whole()).alias("q"),
        F.min(x).over(whole()).alias("lo"), F.max(x).over(whole()).alias("hi"))
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    spread = F.least(F.col("sd"), F.when(iqr > 0, iqr).otherwise(F.col("sd")))
    h = spread * F.pow(F.col("n"), -0.2) * 0.9
    stats = stats.withColumn("h", h).where(F.col("h") > 0)
    low = F.col("lo") - 3 * F.col("h")
    gap = (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1)
    sums = [
        F.sum(F.exp(-0.5 * F.pow((low + gap * k - x) / F.col("h"), 2))
              / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias(f"k{k}")
        for k in range(points)
    ]
    wide = stats.groupBy("id").agg(F.min(low).alias("low"), F.min(gap).alias("gap"), *sums)
    return wide.select(
        "id", "low", "gap", F.posexplode(F.array(*[F.col(f"k{k}") for k in range(points)])).alias("point", "density")
    ).select("id", (F.col("point") + 1).alias("point"), (F.col("low") + F.col("gap") * F.col("point")).alias("x"),
             "density")


def seasonal_profile(panel: DataFrame, units: list[str] = ("quarter", "month", "wday", "hour")) -> DataFrame:
    """Quartiles of the value by level of each calendar unit."""
    parts = {
        "hour": F.hour("date"), "wday": F.dayofweek("date"), "week": F.weekofyear("date"),
        "month": F.month("date"), "quarter": F.quarter("date"), "year": F.year("date"),
    }
    long = panel.select("id", "value", *[parts[u].alias(u) for u in units]).unpivot(
        ["id", "value"], list(units), "unit", "level")
    q = F.percentile("value", [0.25, 0.5, 0.75])
    return long.groupBy("id", "unit", "level").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), q[0].alias("p25"), q[1].alias("p50"),
        q[2].alias("p75"), F.max("value").alias("high"))


def decompose(panel: DataFrame, period: int, robust: bool = False) -> DataFrame:
    """Additive decomposition: centred moving trend, mean of each season phase, remainder.

    The moving window covers one season and shrinks at both ends. All columns come from windows by id.
    """
    panel = panel.withColumn("_t", F.row_number().over(by_date()))
    half = max(1, period // 2)
    around = by_date().rowsBetween(-half, half)
    trend = F.percentile("value", 0.5).over(around) if robust else F.avg("value").over(around)
    out = panel.withColumn("trend", trend)
    if period > 1:
        phase = F.pmod(F.col("_t") - 1, F.lit(period))
        out = out.withColumn("_phase", phase).withColumn(
            "_raw", F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy("id", "_phase")))
        out = out.withColumn("season", F.col("_raw") - F.avg("_raw").over(whole())).drop("_phase", "_raw")
    else:
        out = out.withColumn("season", F.lit(0.0))
    return out.withColumn("remainder", F.col("value") - F.col("trend") - F.col("season")).drop("_t")


def smooth(panel: DataFrame, span: int) -> DataFrame:
    """Local linear smoother: a straight line fitted to the span rows around each date."""
    half = max(1, span // 2)
    t = F.row_number().over(by_date()).cast("double")
    around = by_date().rowsBetween(-half, half)
    local = panel.withColumn("_t", t).withColumn("_b", F.regr_slope("value", "_t").over(around)).withColumn(
        "_a", F.regr_intercept("value", "_t").over(around))
    return local.withColumn("smooth", F.col("_a") + F.col("_b") * F.col("_t")).drop("_t", "_a", "_b")


def autocorrelation(panel: DataFrame, lags: int, value: str = "value", keys: list[str] = ("id",)) -> DataFrame:
    """ACF and PACF for lags 1..lags with the white-noise band.

    All lags are columns of one window and one aggregate over the same partitioning: nothing is exploded or joined.
    """
    return acf_array(panel, lags, value, keys).select(
        *keys, "n", F.posexplode(F.arrays_zip("acf", pacf_of(F.col("acf")).alias("pacf"))).alias("p", "v")
    ).select(*keys, (F.col("p") + 1).alias("lag"), F.col("v.acf").alias("acf"), F.col("v.pacf").alias("pacf"),
             (1.96 / F.sqrt("n")).alias("white_noise"))


def acf_array(panel: DataFrame, lags: int, value: str = "value", keys: list[str] = ("id",)) -> DataFrame:
    """One row per group: n and the array of autocorrelations."""
    w = by_date(*keys)
    centred = panel.where(F.col(value).isNotNull()).withColumn(
        "_d", F.col(value) - F.avg(value).over(whole(*keys)))
    products = centred.select(
        *keys, "_d", *[(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_c{k}") for k in range(1, lags + 1)])
    sums = products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("c0"),
        *[F.sum(f"_c{k}").alias(f"_c{k}") for k in range(1, lags + 1)])
    acf = F.array(*[F.try_divide(F.coalesce(F.col(f"_c{k}"), F.lit(0.0)), F.col("c0")) for k in range(1, lags + 1)])
    return sums.select(*keys, "n", "c0", acf.alias("acf"))


def pacf_of(acf: Column) -> Column:
    """Partial autocorrelations from the autocorrelations by the Durbin-Levinson recursion."""
    empty = F.array().cast("array<double>")

    def advance(state, k):
        phi = state["phi"]
        up = F.aggregate(
            F.zip_with(phi, F.reverse(F.slice(acf, 1, k - 1)), lambda a, r: a * r), F.lit(0.0), lambda s, x: s + x)
        down = F.aggregate(
            F.zip_with(phi, F.slice(acf, 1, k - 1), lambda a, r: a * r), F.lit(0.0), lambda s, x: s + x)
        return let(F.try_divide(F.element_at(acf, k) - up, 1.0 - down), lambda last: F.struct(
            F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last)).alias("phi"),
            F.concat(state["pacf"], F.array(last)).alias("pacf")))

    start = F.struct(empty.alias("phi"), empty.alias("pacf"))
    return F.aggregate(F.sequence(F.lit(1), F.size(acf)), start, advance, lambda s: s["pacf"])


def cross_correlation(panel: DataFrame, regressors: list[str], lags: int) -> DataFrame:
    """Correlation of value(t) with each regressor at t - lag, for lags -lags..lags."""
    long = panel.unpivot(["id", "date", "value"], regressors, "variable", "x").na.drop(subset=["value", "x"])
    keys = ["id", "variable"]
    w, everything = by_date(*keys), whole(*keys)
    centred = long.select(
        *keys, "date", (F.col("value") - F.avg("value").over(everything)).alias("y"),
        (F.col("x") - F.avg("x").over(everything)).alias("x"))
    span = range(-lags, lags + 1)
    products = centred.select(
        *keys, "x", "y", *[(F.col("y") * F.lag("x", k).over(w)).alias(f"c{k + lags}") for k in span])
    scale = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    wide = products.groupBy(*keys).agg(scale.alias("s"), *[F.sum(f"c{k + lags}").alias(f"c{k + lags}") for k in span])
    array = F.array(*[F.try_divide(F.coalesce(F.col(f"c{k + lags}"), F.lit(0.0)), F.col("s")) for k in span])
    return wide.select(*keys, F.posexplode(array).alias("p", "ccf")).select(
        *keys, (F.col("p") - lags).alias("lag"), "ccf")
