"""Naive, seasonal naive and rolling average: windows only, so several of them share one pass over the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.frames import BASE, RUN_KEYS, Context
from seriesloom.operators.panel import by_date


def _before(*keys: str) -> Window:
    return by_date(*RUN_KEYS, *keys).rowsBetween(Window.unboundedPreceding, -1)


def _naive(df: DataFrame, ctx: Context, params: dict) -> tuple[DataFrame, Column]:
    """Last known value; fitted values are the value of the row before."""
    return df, F.last("y", ignorenulls=True).over(_before())


def _seasonal_naive(df: DataFrame, ctx: Context, params: dict) -> tuple[DataFrame, Column]:
    """Last known value of the same phase; the plain last value where no season is complete."""
    df = df.withColumn("_phase", F.pmod("t", F.lit(max(1, ctx.period))))
    same = F.last("y", ignorenulls=True).over(_before("_phase"))
    any_row = F.last("y", ignorenulls=True).over(_before())
    return df, F.when(F.col("ahead"), F.coalesce(same, any_row)).otherwise(same)


def _rolling_average(df: DataFrame, ctx: Context, params: dict) -> tuple[DataFrame, Column]:
    """Mean of the last ``window_size`` known values, held over the horizon."""
    size = int(params["window_size"])
    df = df.withColumn("_k", F.count("y").over(by_date(*RUN_KEYS))).withColumn(
        "_n", F.count("y").over(Window.partitionBy(*RUN_KEYS)))
    held = F.avg(F.when(F.col("_k") > F.col("_n") - size, F.col("y"))).over(Window.partitionBy(*RUN_KEYS))
    trailing = F.avg("y").over(by_date(*RUN_KEYS).rowsBetween(-size, -1))
    return df, F.when(F.col("ahead"), held).otherwise(trailing)


VALUES = {"Naive": _naive, "Seasonal Naive": _seasonal_naive, "Rolling Average": _rolling_average}


def window_models(frame: DataFrame, methods: list[str], ctx: Context, params: dict[str, dict]) -> DataFrame:
    """Predictions of several of these methods from one pass."""
    df = frame
    for method in methods:
        df, value = VALUES[method](df, ctx, params[method])
        df = df.withColumn(method, value.cast("double"))
    return df.unpivot(BASE, list(methods), "model_desc", "prediction")


def naive(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    return window_models(frame, ["Naive"], ctx, {"Naive": params})


def seasonal_naive(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    return window_models(frame, ["Seasonal Naive"], ctx, {"Seasonal Naive": params})


def rolling_average(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    return window_models(frame, ["Rolling Average"], ctx, {"Rolling Average": params})
