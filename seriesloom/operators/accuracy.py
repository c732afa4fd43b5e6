"""Accuracy tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.metrics import metric
from seriesloom.operators.panel import by_date

ACCURACY = ["me", "mae", "mape", "mase", "smape", "rmse", "rmspe", "rsq"]


def accuracy_table(rows: DataFrame, keys: list[str], metrics: list[str] = ACCURACY) -> DataFrame:
    """Error measures per group of rows (date, actual, prediction)."""
    a, p = F.col("actual"), F.col("prediction")
    rows = rows.where(a.isNotNull() & p.isNotNull())
    if "mase" in metrics:
        rows = rows.withColumn("_step", F.abs(a - F.lag("actual").over(by_date(*keys))))
    return rows.groupBy(*keys).agg(*[metric(m, a, p, F.col("_step")).alias(m) for m in metrics])


def accuracy_report(table: DataFrame, single_method: bool = True, digits: int = 2) -> DataFrame:
    """Single method: metric by Train/Test; several: one row per algorithm and type."""
    names = [m for m in ACCURACY if m in table.columns]
    rounded = table.select(
        "id", F.col("model_desc").alias("Algorithm"), F.col("type").alias("Type"),
        *[F.round(m, digits).alias(m.upper()) for m in names])
    if not single_method:
        return rounded
    long = rounded.unpivot(["id", "Algorithm", "Type"], [m.upper() for m in names], "Metric", "Value")
    return long.groupBy("id", "Algorithm", "Metric").pivot("Type", ["Train", "Test"]).agg(F.first("Value"))
