"""Combining the predictions of several models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.accuracy import accuracy_table
from seriesloom.operators.frames import BASE

ROW = ["id", "run", "date", "t", "h", "ahead", "actual"]


def rank_weights(preds: DataFrame, run: str = "test") -> DataFrame:
    """Weight of a model per id: 1 for the largest error on the run, up to the number of models for the smallest."""
    scored = accuracy_table(preds.where((F.col("run") == run) & F.col("ahead")), ["id", "model_desc"], ["rmse"])
    place = F.rank().over(Window.partitionBy("id").orderBy(F.col("rmse").desc()))
    return scored.select("id", "model_desc", place.cast("double").alias("weight"))


def combine(preds: DataFrame, methods: list[str], weights: DataFrame | None = None) -> DataFrame:
    """Average, Weighted Average and Median of all models, row by row, in one aggregate."""
    names = {"Average": "Ens - Average", "Weighted Average": "Ens - Weighted Average", "Median": "Ens - Median"}
    unknown = set(methods) - set(names)
    if unknown:
        raise ValueError(f"unknown ensembles {sorted(unknown)}")
    p = F.col("prediction")
    aggs = {}
    if "Average" in methods:
        aggs["Average"] = F.avg(p)
    if "Median" in methods:
        aggs["Median"] = F.median(p)
    rows = preds
    if "Weighted Average" in methods:
        weights = rank_weights(preds) if weights is None else weights
        rows = preds.join(weights, ["id", "model_desc"], "left")
        w = F.when(p.isNotNull(), F.col("weight"))
        aggs["Weighted Average"] = F.try_divide(F.sum(w * p), F.sum(w))
    first = [F.first(c).alias(c) for c in ROW if c not in ("id", "run", "date")]
    wide = rows.groupBy("id", "run", "date").agg(*first, *[v.alias(names[k]) for k, v in aggs.items()])
    return wide.unpivot(ROW, [names[k] for k in methods], "model_desc", "prediction").select(
        *BASE, "model_desc", "prediction")
