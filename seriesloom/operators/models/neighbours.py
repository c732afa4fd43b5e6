"""K nearest neighbours within each series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.frames import BASE, RUN_KEYS, Context
from seriesloom.operators.models.regression import _standardised, feature_names

PART, TARGETS = 2048, 256  # fitted rows of one series handled together, and rows whose neighbours are sought there


def _nearest(d: np.ndarray, t: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` least distances of each row of d, ties to the smaller t; t is ascending."""
    if d.shape[1] > most:
        edge = np.partition(d, most - 1, axis=1)[:, most - 1:most]
        # ties at the edge are settled by order: rank by (distance, place) among what does not lie beyond it
        d = np.where(d <= edge, d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :most]


def neighbour_lists(frame: DataFrame, names: list[str], most: int, inside: bool = False) -> DataFrame:
    """The ``most`` nearest fitted rows of every predicted row; with ``inside`` of every fitted row, too, itself left out.

    The wanted rows of a series are gathered and sent to parts of at most PART fitted rows each, TARGETS wanted rows at a
    time. A part keeps its nearest rows only, so no pair leaves a task, and the parts of a long series run side by side.
    """
    scaled = frame.withColumn("x", F.array(*_standardised(names)))
    scaled = scaled.where(~F.exists("x", lambda v: v.isNull()))
    asked = scaled if inside else scaled.where("ahead")
    wanted = asked.groupBy(*RUN_KEYS, F.floor(F.col("t") / TARGETS).alias("_block")).agg(
        F.collect_list(F.struct("t", "x")).alias("wanted"))
    known = scaled.where("NOT ahead AND y IS NOT NULL").withColumn("part", F.floor(F.col("t") / PART))
    parts = known.groupBy(*RUN_KEYS, "part").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("known"))
    both = parts.join(wanted, RUN_KEYS)
    width = len(names)

    @F.pandas_udf("array<struct<t:int,near:array<struct<distance:double,other:int,y:double>>>>")
    def nearest(targets: pd.Series, target_t: pd.Series, flat: pd.Series, t: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, ta, b, tb, yb in zip(targets, target_t, flat, t, y):
            a, b = np.asarray(a, float).reshape(-1, width), np.asarray(b, float).reshape(-1, width)
            ta, tb, yb = np.asarray(ta, int), np.asarray(tb, int), np.asarray(yb, float)
            d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2)).round(12)
            d[ta[:, None] == tb[None, :]] = np.inf  # a row is no neighbour of itself
            found = []
            for i, at in enumerate(_nearest(d, tb, most)):
                at = at[np.isfinite(d[i, at])]
                found.append({"t": int(ta[i]), "near": [
                    {"distance": q, "other": o, "y": v} for q, o, v in zip(d[i, at].tolist(), tb[at].tolist(), yb[at].tolist())]})
            out.append(found)
        return pd.Series(out)

    flat = lambda c: F.flatten(F.transform(c, lambda r: r["x"]))
    found = both.select(*RUN_KEYS, F.inline(nearest(
        flat("wanted"), F.transform("wanted", lambda r: r["t"]), flat("known"),
        F.transform("known", lambda r: r["t"]), F.transform("known", lambda r: r["y"]))))
    pairs = found.select(*RUN_KEYS, "t", F.inline("near"))
    place = F.row_number().over(Window.partitionBy(*RUN_KEYS, "t").orderBy("distance", "other"))
    return pairs.withColumn("place", place).where(F.col("place") <= most)


def knn_path(frame: DataFrame, ctx: Context, sizes: list[int], inside: bool = False) -> DataFrame:
    """Predictions for several numbers of neighbours from one search; ``choice`` indexes ``sizes``."""
    df, names = feature_names(frame, ctx, "KNN")
    near = neighbour_lists(df, names, max(sizes), inside)
    weight = 1 / (F.col("distance") + 1e-6)
    aggs = []
    for i, k in enumerate(sizes):
        inside = F.when(F.col("place") <= k, weight)
        aggs.append((F.sum(inside * F.col("y")) / F.sum(inside)).alias(f"_{i}"))
    wide = near.groupBy(*RUN_KEYS, "t").agg(*aggs)
    values = F.array(*[F.col(f"_{i}") for i in range(len(sizes))])
    joined = df.join(wide, [*RUN_KEYS, "t"], "left")
    return joined.select(*BASE, F.posexplode(values).alias("choice", "prediction")).select(
        "choice", *BASE, F.lit("KNN").alias("model_desc"), "prediction")


def knn(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Inverse-distance weighted mean of the nearest fitted rows; a fitted row is left out of its own neighbours."""
    return knn_path(frame, ctx, [int(params["neighbors"])], inside=True).drop("choice")
