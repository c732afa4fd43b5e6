"""Tree models, one per series and run: every (id, run) is a group of a grouped job, so series never touch each other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.constants import SEED
from seriesloom.functions import trees as T
from seriesloom.operators.frames import BASE, RUN_KEYS, Context, predictions
from seriesloom.operators.models.regression import feature_names


def by_series(frame: DataFrame, ctx: Context, method: str, predict: Callable) -> DataFrame:
    """Predictions of all rows of every series by ``predict(x, y, known)``; rows without some feature get null.

    A group is one series of one run, as long as the calendar makes it. Series with fewer than two whole known rows get null.
    """
    df, names = feature_names(frame, ctx, method)
    rows = df.select(*BASE, "y", F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    schema = rows.select(*BASE, F.lit(None).cast("double").alias("_v")).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[np.nan if v is None else v for v in r] for r in part["x"]], float).reshape(len(part), len(names))
        y = part["y"].to_numpy(float)
        whole = np.isfinite(x).all(1)
        out = np.full(len(part), np.nan)
        known = (np.isfinite(y) & ~part["ahead"].to_numpy(bool))[whole]
        if known.sum() >= 2:
            order = np.argsort(part["date"].to_numpy()[whole], kind="stable")
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            value = predict(x[whole][order], np.where(known, y[whole], 0.0)[order], known[order])
            out[whole] = value[back]
        return part[list(BASE)].assign(_v=out)

    return predictions(rows.groupBy(*RUN_KEYS).applyInPandas(run, schema), method, F.col("_v"))


def random_forest(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    trees, mtry, min_n = (int(params[f"rf_{k}"]) for k in ("trees", "mtry", "min_n"))

    def predict(x, y, known):
        codes = T.binned(x)
        return T.forest_predict(T.forest(codes, y, known, trees, mtry, min_n, SEED), codes)

    return by_series(frame, ctx, "Random Forest", predict)


def boosting(params: dict, prefix: str) -> Callable:
    p = {k: params[f"{prefix}_{k}"] for k in ("trees", "tree_depth", "learn_rate", "min_n", "mtry", "loss_reduction",
                                              "sample_size")}

    def predict(x, y, known):
        return T.boosted(T.binned(x), y, known, int(p["trees"]), int(p["tree_depth"]), float(p["learn_rate"]),
                         int(p["min_n"]), int(p["mtry"]), float(p["loss_reduction"]), float(p["sample_size"]), SEED)

    return predict


def boosted_trees(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    return by_series(frame, ctx, "Boosted Trees", boosting(params, "boost"))


def leaf_linear(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """A tree of at most ``max_rules`` leaves with a linear model in each, in committees, moved by nearest neighbours."""
    most, committees, neighbours = (int(params[k]) for k in ("max_rules", "committees", "cub_neighbors"))
    return by_series(frame, ctx, "Cubist",
                     lambda x, y, known: T.rules(x, T.binned(x), y, known, most, committees, neighbours))


def boosted_residuals(frame: DataFrame, ctx: Context, params: dict, base: DataFrame, method: str,
                      prefix: str) -> DataFrame:
    """Boosted trees on what a base model leaves over; the prediction is the sum."""
    basis = base.select(*RUN_KEYS, "date", F.col("prediction").alias("_base"))
    joined = frame.join(basis, [*RUN_KEYS, "date"], "left")
    left_over = joined.withColumn("y", F.when(~F.col("ahead"), F.col("y") - F.col("_base")))
    boosted = by_series(left_over.drop("_base"), ctx, method, boosting(params, prefix))
    both = boosted.join(basis, [*RUN_KEYS, "date"], "left")
    return both.select(*BASE, "model_desc", (F.col("_base") + F.col("prediction")).alias("prediction"))


def arima_boost(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    from seriesloom.constants import default_params
    from seriesloom.operators.models.arima import sarima

    base = sarima(frame, Context(ctx.period), default_params("SARIMA"))
    return boosted_residuals(frame, ctx, params, base, "ARIMA-Boost", "arima_boost")


def changepoint_boost(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    from seriesloom.constants import default_params
    from seriesloom.operators.models.regression import changepoints

    base = changepoints(frame, Context(ctx.period), default_params("Prophet"))
    return boosted_residuals(frame, ctx, params, base, "Prophet-Boost", "prophet_boost")
