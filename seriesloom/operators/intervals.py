"""Prediction intervals from test residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.panel import by_date
from seriesloom.operators.reshape import with_levels


def add_conformal(preds: DataFrame, run: str, levels: list[float]) -> DataFrame:
    """Predicted rows of a run with split-conformal bounds for every level.

    The half width is the ceil((n + 1) level)-th smallest absolute test residual of the same id and model. A level
    that needs more residuals than there are has no bounds. The residuals (as many as the hold-out has rows) reach the
    rows of the run by a window, so the predictions are read once and nothing is joined.
    """
    rows = preds.where(F.col("ahead") & F.col("run").isin("test", run))
    size = F.when(F.col("run") == "test", F.abs(F.col("actual") - F.col("prediction")))
    widths = F.array_sort(F.collect_list(size).over(Window.partitionBy("id", "model_desc")))
    rows = rows.withColumn("widths", widths).where(F.col("run") == run).select(
        "id", "model_desc", F.lit("prediction").alias("key"), "date", F.col("prediction").alias("value"), "widths")
    rows = with_levels(rows, levels)
    n = F.size("widths")
    k = F.greatest(F.lit(1), F.ceil((n + 1) * F.col("conf_lvl").cast("double") - 1e-9)).cast("int")
    half = F.when(k <= n, F.try_element_at("widths", k))
    return rows.withColumns({"conf_lo": F.col("value") - half, "conf_hi": F.col("value") + half}).drop("widths")


def widen(forecast: DataFrame, kind: str = "linear", beta: float = 0.5) -> DataFrame:
    """Widen the bounds of predictions with the horizon: beta (h - 1), or h^beta - 1."""
    h = F.row_number().over(by_date("id", "model_desc", "conf_lvl", "key"))
    if kind == "linear":
        growth = beta * (h - 1)
    elif kind == "exponential":
        growth = F.pow(h, F.lit(beta)) - 1
    else:
        raise ValueError(f"unknown type {kind!r}")
    out = forecast.withColumn("_g", F.when(F.col("key") == "prediction", growth).otherwise(0.0))
    return out.withColumns({
        "conf_lo": F.col("conf_lo") - F.col("_g"), "conf_hi": F.col("conf_hi") + F.col("_g")}).drop("_g")
