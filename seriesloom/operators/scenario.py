"""Business scenarios from forecast tables (id, model_desc, key, date, value, conf_lo, conf_hi, conf_lvl)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.constants import AGGREGATIONS
from seriesloom.operators.panel import by_date_desc


def adjust(forecast: DataFrame, percent: float | None = None) -> DataFrame:
    """Raise predictions by a percentage; bounds and actuals stay."""
    factor = 1 + (percent or 0.0) / 100
    return forecast.withColumn(
        "value", F.when(F.col("key") == "prediction", F.col("value") * factor).otherwise(F.col("value")))


def aggregate(forecast: DataFrame, n_future: int, level: float = 0.9, how: str = "sum") -> DataFrame:
    """Per id and model: previous period, forecast, worst and best case with sd and change in percent.

    The Variability of the worst and best case is that of the forecast values, not of the bounds.
    """
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {how!r}; one of {AGGREGATIONS}")
    fold = {"sum": F.sum, "mean": F.avg, "median": F.median}[how]
    keys = ["id", "model_desc"]
    preds = forecast.where((F.col("key") == "prediction") & (F.abs(F.col("conf_lvl").cast("double") - level) < 1e-9))
    ahead = preds.groupBy(*keys).agg(
        fold("value").alias("mid"), fold("conf_lo").alias("lo"), fold("conf_hi").alias("hi"),
        F.stddev_samp("value").alias("sd"))
    actual = forecast.where(F.col("key") == "actual").withColumn("_r", F.row_number().over(by_date_desc()))
    before = actual.where(F.col("_r") <= n_future).groupBy("id").agg(
        fold("value").alias("prev"), F.stddev_samp("value").alias("prev_sd"))
    both = ahead.join(before, "id")

    def line(order, name, value, sd, change=True):
        delta = F.try_divide(F.col(value) - F.col("prev"), F.col("prev")) * 100
        return F.struct(
            F.lit(order).alias("line"), F.lit(name).alias("scenario"), F.col(value).alias("value"),
            F.col(sd).alias("variability"),
            (delta if change else F.lit(None).cast("double")).alias("delta_pp"))

    lines = F.array(
        line(1, "Previous Period", "prev", "prev_sd", False), line(2, "Forecast", "mid", "sd"),
        line(3, "Worst Case", "lo", "sd"), line(4, "Best Case", "hi", "sd"))
    return both.select(*keys, F.explode(lines).alias("s")).select(*keys, "s.*")


def scenario_values(forecast: DataFrame, level: float = 0.9, digits: int = 2) -> DataFrame:
    """Date, worst case, forecast and best case of every predicted row."""
    preds = forecast.where((F.col("key") == "prediction") & (F.abs(F.col("conf_lvl").cast("double") - level) < 1e-9))
    return preds.select(
        "id", "model_desc", "date", F.round("conf_lo", digits).alias("worst_case"),
        F.round("value", digits).alias("forecast"), F.round("conf_hi", digits).alias("best_case"))


def ensembles_only(df: DataFrame, with_actual: bool = False) -> DataFrame:
    """Rows of ensembles and stacks, optionally with the actual rows."""
    keep = F.col("model_desc").rlike("^(Ens|Stk) - ")
    return df.where(keep | (F.col("model_desc") == "ACTUAL") if with_actual else keep)
