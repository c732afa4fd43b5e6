"""Methods by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.constants import default_params
from seriesloom.operators.frames import RUN_KEYS, Context
from seriesloom.operators.linear import cross_products, elastic_net, features_array, least_squares
from seriesloom.operators.models import arima, automatic, neighbours, regression, simple, smoothing, trees

MODELS = {
    "Naive": simple.naive,
    "Seasonal Naive": simple.seasonal_naive,
    "Rolling Average": simple.rolling_average,
    "ETS": smoothing.ets,
    "Theta": smoothing.theta,
    "SARIMA": arima.sarima,
    "TBATS": regression.several_seasons,
    "STLM": smoothing.decompose_then,
    "Prophet": regression.changepoints,
    "Linear Regression": regression.linear,
    "Elastic Net": regression.elastic,
    "MARS": regression.hinges,
    "KNN": neighbours.knn,
    "SVM": regression.support_vector,
    "Random Forest": trees.random_forest,
    "Boosted Trees": trees.boosted_trees,
    "Cubist": trees.leaf_linear,
    "Feed-Forward": regression.feed_forward,
    "Feed-Forward AR": regression.feed_forward_ar,
    "ARIMA-Boost": trees.arima_boost,
    "Prophet-Boost": trees.changepoint_boost,
    "H2O AutoML": automatic.automatic,
}

TIME_ONLY = {"Naive", "Seasonal Naive", "Rolling Average", "ETS", "Theta", "TBATS", "STLM", "Feed-Forward AR"}


def context_for(method: str, ctx: Context) -> Context:
    """The features a method may use: none, all but lags, or all."""
    if method in TIME_ONLY:
        return Context(ctx.period)
    if method == "SARIMA":
        return Context(ctx.period, tuple(f for f in ctx.features if "lag" not in f))
    return ctx


def fit_predict(frame: DataFrame, method: str, ctx: Context, params: dict | None = None) -> DataFrame:
    """Predictions of one method for all rows of all runs."""
    if method not in MODELS:
        raise ValueError(f"unknown method {method!r}")
    return MODELS[method](frame, context_for(method, ctx), default_params(method, params))


def fitted_parameters(frame: DataFrame, method: str, ctx: Context, params: dict | None = None) -> DataFrame:
    """Fitted parameters in long form (id, run, parameter, value), for every method with a stored form.

    Parameters that are lists are numbered from 0 (``knots_0``); regressions name theirs by feature.
    """
    from seriesloom.operators.models.store import STATES

    full, ctx = default_params(method, params), context_for(method, ctx)
    number = lambda *names: F.create_map(*[
        x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    if method == "ETS":
        table = smoothing.ets_parameters(frame, ctx, full)
        values = number("trended", "damped", "alpha", "beta", "gamma", "aicc")
    elif method == "SARIMA":
        table = arima.sarima_parameters(frame, ctx, full)
        values = F.map_concat("coefficients", number("d", "seasonal_d", "aicc"))
    elif method in ("Linear Regression", "Elastic Net"):
        df, names = regression.feature_names(frame, ctx, method)
        sums = cross_products(df, RUN_KEYS, features_array(names), F.col("y"))
        if method == "Elastic Net":
            table = elastic_net(sums, [(float(full["penalty"]), float(full["mixture"]))])
        else:
            table = least_squares(sums)
        labels = F.array(*[F.lit(n) for n in ["intercept", *names]])
        values = F.map_from_arrays(labels, F.col("beta"))
    elif method in STATES:
        named = STATES[method][0](frame, ctx, full).select(*RUN_KEYS, F.explode("numbers").alias("_name", "_v"))
        rows = named.select(*RUN_KEYS, "_name", F.size("_v").alias("_k"), F.posexplode("_v").alias("_i", "value"))
        label = F.when(F.col("_k") == 1, F.col("_name")).otherwise(F.concat_ws("_", "_name", "_i"))
        return rows.select(*RUN_KEYS, label.alias("parameter"), "value")
    else:
        raise ValueError(f"{method} has no parameters per series")
    return table.select(*RUN_KEYS, F.explode(values).alias("parameter", "value"))


def fit_predict_all(frame: DataFrame, methods: list[str], ctx: Context, params: dict | None = None) -> DataFrame:
    """Predictions of several methods, stacked; ``params`` maps a method to its overrides.

    The methods that are plain windows share one pass.
    """
    given = params or {}
    windows = [m for m in methods if m in simple.VALUES]
    parts = [fit_predict(frame, m, ctx, given.get(m)) for m in methods if m not in windows]
    if windows:
        full = {m: default_params(m, given.get(m)) for m in windows}
        parts.insert(0, simple.window_models(frame, windows, Context(ctx.period), full))
    return reduce(lambda a, b: a.unionByName(b), parts)
