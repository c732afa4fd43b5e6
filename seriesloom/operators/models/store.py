"""Fitted models as a table: fitted once, saved, and joined to rows that the fit has not seen.

A model is one row per (id, method, version): what was fitted (named arrays of doubles), the settings, the features, and where
the fitted part ends. Saved tables are partitioned by method and version. ``score`` joins rows to models by id and evaluates
the same expressions that fit and predict in one go use, so both give the same numbers. Reports of parameters and
explanations read this table, whatever the method.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.constants import default_params
from seriesloom.operators.frames import RUN_KEYS, Context, as_arrays, filled_y
from seriesloom.operators.linear import (
    cross_products, elastic_net, features_array, fit_in_place, fit_series, fitted, least_squares,
)
from seriesloom.operators.models import arima, regression, smoothing
from seriesloom.operators.panel import by_date, whole

NUMBERS = "map<string,array<double>>"
KEYS = ["id", "method", "version"]
SEASONS = {"none": 0.0, "additive": 1.0, "multiplicative": 2.0}


def _numbers(**arrays: Column) -> Column:
    """Named arrays of doubles; single numbers become arrays of one."""
    parts = []
    for name, value in arrays.items():
        parts += [F.lit(name), value.cast("array<double>")]
    return F.create_map(*parts)


def _one(value: Column | str) -> Column:
    return F.array((F.col(value) if isinstance(value, str) else value).cast("double"))


def _array(name: str) -> Column:
    return F.col("numbers")[name]


def _number(name: str, at: int = 0) -> Column:
    return F.get(F.col("numbers")[name], at)


# Fits: frame, context and settings to (id, run, numbers). Scores: rows next to their model to a prediction.


def _fit_naive(frame, ctx, params):
    last = F.max_by("y", F.when(F.col("y").isNotNull(), F.col("t")))
    return frame.where("NOT ahead").groupBy(*RUN_KEYS).agg(_numbers(last=_one(last)).alias("numbers"))


def _fit_seasonal_naive(frame, ctx, params):
    m = max(1, ctx.period)
    known = frame.where("NOT ahead").withColumn("_p", F.pmod("t", F.lit(m)))
    last = F.max_by("y", F.when(F.col("y").isNotNull(), F.col("t"))).over(Window.partitionBy(*RUN_KEYS))
    phases = known.withColumn("_last", last).groupBy(*RUN_KEYS, "_p").agg(
        F.max_by("y", F.when(F.col("y").isNotNull(), F.col("t"))).alias("v"), F.first("_last").alias("_last"))
    table = phases.groupBy(*RUN_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("_p", "v"))).alias("by"), F.first("_last").alias("_last"))
    every = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.coalesce(F.try_element_at("by", p), F.col("_last")))
    return table.select(*RUN_KEYS, _numbers(phase=every).alias("numbers"))


def _fit_rolling(frame, ctx, params):
    known = frame.where("NOT ahead AND y IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*RUN_KEYS).orderBy(F.desc("t")))
    last = known.withColumn("_k", place).where(F.col("_k") <= int(params["window_size"]))
    return last.groupBy(*RUN_KEYS).agg(_numbers(mean=_one(F.avg("y"))).alias("numbers"))


def _score_seasonal_naive(rows, ctx, params):
    phase = F.pmod("t", F.lit(max(1, ctx.period))).cast("int")
    return rows, F.get(_array("phase"), phase)


def _fit_ets(frame, ctx, params):
    kind = smoothing._ets_forms(ctx.period, params)[2]
    table = smoothing.ets_table(as_arrays(frame), ctx.period, params)
    b = F.col("best")
    code = F.lit(0.0)
    for name, value in SEASONS.items():
        code = F.when(b["season"] == name, value).otherwise(code)
    return table.where(F.col("best.values").isNotNull()).select(*RUN_KEYS, _numbers(
        season=_one(code), grows=_one(F.lit(float(kind == "multiplicative"))), trended=_one(b["trended"].cast("double")),
        alpha=_one(b["alpha"]), beta=_one(b["beta"]), gamma=_one(b["gamma"]), phi=_one(b["phi"]), aicc=_one(b["aicc"]),
        level=_one(b["level"]), slope=_one(b["slope"]), slots=b["slots"]).alias("numbers"))


def _score_ets(rows, ctx, params):
    h, phi = F.col("h"), _number("phi")
    reach = F.when(phi >= 1, h).otherwise(phi * (1 - F.pow(phi, h)) / F.nullif(1 - phi, F.lit(0.0)))
    line = F.when(_number("grows") == 1, _number("level") * F.pow(_number("slope"), reach)).otherwise(
        _number("level") + _number("slope") * reach)
    now = F.get(_array("slots"), F.pmod(F.col("t") - 1, F.lit(max(1, ctx.period))).cast("int"))
    return rows, F.when(_number("season") == 1, line + now).when(_number("season") == 2, line * now).otherwise(line)


def _fit_theta(frame, ctx, params):
    arrays = smoothing.theta_fit(frame, ctx).where(F.col("best.values").isNotNull())
    seasons = F.transform(F.slice("rows", 1, max(1, ctx.period)), lambda r: r["season"])
    return arrays.select(*RUN_KEYS, _numbers(
        level=_one("best.level"), alpha=_one("best.alpha"), slope=_one("_slope"),
        seasonal=_one(F.col("_seasonal").cast("double")), ratio=_one(F.element_at("rows", 1)["_ratio"].cast("double")),
        seasons=seasons).alias("numbers"))


def _score_theta(rows, ctx, params):
    line = _number("level") + _number("slope") / 2 * (F.col("h") - 1 + 1 / _number("alpha"))
    season = F.get(_array("seasons"), F.pmod(F.col("t") - 1, F.lit(max(1, ctx.period))).cast("int"))
    back = F.when(_number("ratio") == 1, line * season).otherwise(line + season)
    return rows, F.when(_number("seasonal") == 1, back).otherwise(line)


def _fit_sarima(frame, ctx, params):
    m, offset = max(1, ctx.period), F.array(F.lit(0.0))
    extra = []
    if ctx.features:
        x = features_array(list(ctx.features))
        frame = fit_in_place(frame, RUN_KEYS, x, F.col("y"), "_bx", penalty=[0.0] + [1e-6] * len(ctx.features))
        reg = fitted(x, F.col("_bx"))
        frame = frame.withColumn("_reg", reg).where("_reg IS NOT NULL").withColumn("y", F.col("y") - F.col("_reg"))
        extra, offset = ["_bx"], F.element_at("rows", 1)["_bx"]
    fit, _ = arima.arima_fit(frame, m, params, extra)
    known, (reach, back, _) = F.filter("rows", lambda r: ~r["ahead"]), arima.memory(params, m)

    def tail(field, k):
        return F.transform(F.slice(known, F.greatest(F.size(known) - k + 1, F.lit(1)), F.lit(k)),
                           lambda r: F.coalesce(r[field], F.lit(0.0)))

    return fit.where(F.size(known) > 0).select(*RUN_KEYS, _numbers(
        beta=F.col("beta"), differences=F.array(F.col("dd").cast("double"), F.col("ds").cast("double")), aicc=_one("aicc"),
        z=tail("z", reach), e=tail("e", reach), y=tail("y", back), regression=offset).alias("numbers"))


def _score_sarima(rows, ctx, params):
    """Forecasts recur: the path to the farthest row of an id is computed once and its steps are looked up."""
    m = max(1, ctx.period)
    far = rows.groupBy("id").agg(F.max("h").alias("_far"), F.first("numbers").alias("numbers"))
    path = arima.path(params, m, _array("z"), _array("e"), _array("y"), _array("beta"), _number("differences"),
                      _number("differences", 1), F.greatest(F.col("_far"), F.lit(0)))
    rows = rows.join(far.select("id", path.alias("_path")), "id")
    value = F.get("_path", F.col("h") - 1)
    if ctx.features:
        value = value + fitted(features_array(list(ctx.features)), _array("regression"))
    return rows, value


def _fit_linear(method):
    def fit(frame, ctx, params):
        df, names = regression.feature_names(frame, ctx, method)
        sums = cross_products(df, RUN_KEYS, features_array(names), F.col("y"), width=len(names) + 1)
        if method == "Elastic Net":
            table = elastic_net(sums, [(float(params["penalty"]), float(params["mixture"]))])
        else:
            table = least_squares(sums)
        return table.select(*RUN_KEYS, _numbers(beta=F.col("beta")).alias("numbers"))

    return fit


def _score_linear(method):
    def score(rows, ctx, params):
        df, names = regression.feature_names(rows, ctx, method)
        return df, fitted(features_array(names), _array("beta"))

    return score


def _with_stats(frame, x, y, stats: dict[str, Column], solver, **options):
    """Coefficients of each series next to statistics that are the same in all its rows."""
    df = frame.withColumns(stats).withColumn("x", x)
    fit = fit_series(df, RUN_KEYS, F.col("x"), y, ["t", *stats], solver=solver, **options)
    first = F.element_at("rows", 1)
    return fit.select(*RUN_KEYS, "beta", *[first[c].alias(c) for c in stats])


def _fit_hinges(frame, ctx, params):
    df, names = regression.feature_names(frame, ctx, "MARS")
    table = regression.hinge_fit(df, names, params)
    pairs = F.flatten(F.transform("pairs", lambda p: F.array(p["a"], p["b"])))
    return table.select(*RUN_KEYS, _numbers(beta=F.col("beta"), knots=F.flatten("knots"), pairs=pairs).alias("numbers"))


def _score_hinges(rows, ctx, params):
    df, names = regression.feature_names(rows, ctx, "MARS")
    count = F.size(_array("knots")) / len(names)
    knots = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.slice(
        _array("knots"), (i * count + 1).cast("int"), count.cast("int")))
    ends = F.filter(F.transform(_array("pairs"), lambda a, i: F.when(i % 2 == 0, F.struct(
        a.cast("int").alias("a"), F.get(_array("pairs"), i + 1).cast("int").alias("b")))), lambda p: p.isNotNull())
    f = F.array(*[F.col(c).cast("double") for c in names])
    df = df.withColumn("_f", f).withColumn("_k", knots).withColumn("_p", ends)
    df = df.withColumn("_x", regression.hinge_basis(F.col("_f"), F.col("_k"), F.col("_p")))
    return df, fitted(F.col("_x"), _array("beta"))


def _fit_seasons(frame, ctx, params):
    x, subsets = regression.season_terms(ctx, params)
    df = filled_y(frame).withColumn("_top", F.max(F.when(~F.col("ahead"), F.col("t"))).over(whole(*RUN_KEYS)))
    df = df.withColumn("_u", F.col("t") / F.col("_top")).withColumn("_x", x)
    rows = fit_in_place(df, RUN_KEYS, F.col("_x"), F.col("y"), subsets=subsets).where("NOT ahead")
    rows = rows.withColumn("_e", F.col("y") - fitted(F.col("_x"))).withColumn("_e1", F.lag("_e").over(by_date(*RUN_KEYS)))
    return rows.groupBy(*RUN_KEYS).agg(
        F.try_divide(F.sum(F.col("_e") * F.col("_e1")), F.sum(F.col("_e") * F.col("_e"))).alias("_phi"),
        F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("t"))).alias("_last"), F.first("beta").alias("beta"),
        F.first("_top").alias("_top")).select(*RUN_KEYS, _numbers(
            beta=F.col("beta"), phi=_one(F.coalesce("_phi", F.lit(0.0))), last=_one("_last"), top=_one("_top")).alias("numbers"))


def _score_seasons(rows, ctx, params):
    df = rows.withColumn("_u", F.col("t") / _number("top")).withColumn("_x", regression.season_terms(ctx, params)[0])
    return df, fitted(F.col("_x"), _array("beta")) + F.coalesce(F.pow(_number("phi"), "h") * _number("last"), F.lit(0.0))


def _fit_changepoints(frame, ctx, params):
    from seriesloom.functions import transforms as X

    y, everything = F.col("y"), whole(*RUN_KEYS)
    stats = {"_lo": F.lit(float(params["logistic_floor"])), "_hi": F.lit(0.0)}
    if params["growth"] == "logistic":
        stats["_hi"] = F.lit(float(params["logistic_cap"])) if params["logistic_cap"] else 1.2 * F.max(y).over(everything)
    df = frame.withColumns(stats)
    if params["growth"] == "logistic":
        df = df.withColumn("y", X.log_interval(y, F.col("_lo"), F.col("_hi")))
    elif params["prophet_season"] == "multiplicative":
        df = df.withColumn("y", F.when(y > 0, F.ln(y)))
    df = df.withColumn("_scale", F.coalesce(F.nullif(F.max(F.abs("y")).over(everything), F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("_top", F.max(F.when(~F.col("ahead"), F.col("t"))).over(everything))
    df = df.withColumn("_u", F.col("t") / F.col("_top"))
    df, x, options = regression.trend_terms(df, ctx, params)
    table = _with_stats(df, x, F.col("y") / F.col("_scale"), {c: F.col(c) for c in ("_scale", "_top", "_lo", "_hi")},
                        **options)
    return table.select(*RUN_KEYS, _numbers(beta=F.col("beta"), scale=_one("_scale"), top=_one("_top"), floor=_one("_lo"),
                                            cap=_one("_hi")).alias("numbers"))


def _score_changepoints(rows, ctx, params):
    from seriesloom.functions import transforms as X

    df, x, _ = regression.trend_terms(rows.withColumn("_u", F.col("t") / _number("top")), ctx, params)
    value = fitted(x, _array("beta")) * _number("scale")
    if params["growth"] == "logistic":
        return df, X.inverse_log_interval(value, _number("floor"), _number("cap"))
    return df, F.exp(value) if params["prophet_season"] == "multiplicative" else value


def _fit_net(frame, ctx, params):
    df, names = regression.feature_names(frame, ctx, "Feed-Forward")
    df = df.withColumns(regression.moments(names))
    x, ridge = regression.hidden_layer(names, params)
    table = _with_stats(df, x, F.col("y"), {c: F.col(c) for c in ("_mean", "_sd")}, least_squares, penalty=ridge)
    return table.select(*RUN_KEYS, _numbers(beta=F.col("beta"), mean=F.col("_mean"), sd=F.col("_sd")).alias("numbers"))


def _score_net(rows, ctx, params):
    df, names = regression.feature_names(rows, ctx, "Feed-Forward")
    df = df.withColumns({"_mean": _array("mean"), "_sd": _array("sd")})
    df = df.withColumn("_x", regression.hidden_layer(names, params)[0])
    return df, fitted(F.col("_x"), _array("beta"))


def _fit_neighbours(frame, ctx, params):
    """The fitted rows themselves, scaled by their moments."""
    df, names = regression.feature_names(frame, ctx, "KNN")
    df = df.withColumns(regression.moments(names)).withColumn("_x", regression.scaled_by_moments(names))
    known = df.where("NOT ahead AND y IS NOT NULL").where(~F.exists("_x", lambda v: v.isNull()))
    rows = known.groupBy(*RUN_KEYS).agg(F.array_sort(F.collect_list(F.struct("t", "y", "_x"))).alias("rows"),
                                        F.first("_mean").alias("_mean"), F.first("_sd").alias("_sd"))
    return rows.select(*RUN_KEYS, _numbers(
        x=F.flatten(F.transform("rows", lambda r: r["_x"])), y=F.transform("rows", lambda r: r["y"]),
        mean=F.col("_mean"), sd=F.col("_sd")).alias("numbers"))


def _score_neighbours(rows, ctx, params):
    df, names = regression.feature_names(rows, ctx, "KNN")
    width = len(names)
    df = df.withColumns({"_mean": _array("mean"), "_sd": _array("sd")})
    df = df.withColumn("_x", regression.scaled_by_moments(names)).withColumn("_all", _array("x"))
    gaps = F.transform(_array("y"), lambda y, i: F.struct(F.round(F.sqrt(F.aggregate(
        F.transform("_x", lambda v, j: F.pow(v - F.get("_all", i * width + j), 2)), F.lit(0.0), lambda s, g: s + g)), 12)
        .alias("d"), i.alias("i"), y.alias("y")))
    near = F.slice(F.sort_array(gaps), 1, int(params["neighbors"]))
    df = df.withColumn("_near", F.when(~F.exists("_x", lambda v: v.isNull()), near))
    total = lambda f: F.aggregate(F.transform("_near", f), F.lit(0.0), lambda s, v: s + v)
    weight = lambda r: 1 / (r["d"] + 1e-6)
    return df, F.try_divide(total(lambda r: weight(r) * r["y"]), total(weight))


def _constant(name: str) -> Callable:
    return lambda rows, ctx, params: (rows, _number(name))


#: Fit and score of each method that has a state; what recurs in time only scores rows after the fitted ones.
STATES: dict[str, tuple[Callable, Callable]] = {
    "Naive": (_fit_naive, _constant("last")),
    "Seasonal Naive": (_fit_seasonal_naive, _score_seasonal_naive),
    "Rolling Average": (_fit_rolling, _constant("mean")),
    "ETS": (_fit_ets, _score_ets),
    "Theta": (_fit_theta, _score_theta),
    "SARIMA": (_fit_sarima, _score_sarima),
    "TBATS": (_fit_seasons, _score_seasons),
    "Prophet": (_fit_changepoints, _score_changepoints),
    "Linear Regression": (_fit_linear("Linear Regression"), _score_linear("Linear Regression")),
    "Elastic Net": (_fit_linear("Elastic Net"), _score_linear("Elastic Net")),
    "MARS": (_fit_hinges, _score_hinges),
    "KNN": (_fit_neighbours, _score_neighbours),
    "Feed-Forward": (_fit_net, _score_net),
}

#: Methods whose prediction depends on features or the calendar alone: they score rows of the fitted part, too.
ANY_ROW = {"Prophet", "Linear Regression", "Elastic Net", "MARS", "KNN", "Feed-Forward"}


def fit_models(frame: DataFrame, methods: list[str], ctx: Context, params: dict | None = None, version: str = "1",
               run: str = "future") -> DataFrame:
    """Fitted models of a run of a model frame, one row per id and method.

    ``params`` maps a method to its overrides. Series that are too short for a method have no row for it. ``n`` is the
    position of the last fitted row and ``fitted_to`` its date.
    """
    from seriesloom.operators.models.registry import context_for

    unknown = [m for m in methods if m not in STATES]
    if unknown:
        raise ValueError(f"no stored form of {unknown}; there is one of {sorted(STATES)}")
    frame = frame.where(F.col("run") == run)
    ends = frame.where("NOT ahead").groupBy("id").agg(F.max("t").alias("n"), F.max("date").alias("fitted_to"))
    parts = []
    for method in methods:
        own, full = context_for(method, ctx), default_params(method, (params or {}).get(method))
        table = STATES[method][0](frame, own, full)
        parts.append(table.select(
            "id", F.lit(method).alias("method"), F.lit(version).alias("version"), F.lit(own.period).alias("period"),
            F.array(*[F.lit(f) for f in own.features]).cast("array<string>").alias("features"),
            F.lit(json.dumps(full, sort_keys=True)).alias("settings"), "numbers"))
    return reduce(lambda a, b: a.unionByName(b), parts).join(ends, "id")


def save_models(models: DataFrame, folder: str, mode: str = "append") -> None:
    """Write models below a folder, partitioned by method and version."""
    models.write.mode(mode).partitionBy("method", "version").parquet(folder)


def load_models(spark: SparkSession, folder: str, methods: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Saved models; methods and version prune the folders that are read."""
    schema = (f"id string, period int, features array<string>, settings string, numbers {NUMBERS}, n int, "
              "fitted_to timestamp_ntz, method string, version string")
    found = spark.read.schema(schema).parquet(folder)
    if methods is not None:
        found = found.where(F.col("method").isin(list(methods)))
    return found if version is None else found.where(F.col("version") == version)


def _kinds(models: DataFrame) -> list[tuple]:
    """Distinct methods, versions and settings: a few rows, as all ids of a fit share them."""
    return models.select("method", "version", "period", "features", "settings").distinct().collect()


def score(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Predictions of stored models for rows (id, date and the features), with method, version, t and h.

    Rows need no target. Positions go on after the fitted part in order of dates, one step a row, unless the rows bring
    their own ``t``. Rows of ids without a model drop out. Rows of the fitted part get null from methods that step through
    time, and rows with a missing feature get null from those that use it.
    """
    parts = []
    for kind in _kinds(models):
        method, params = kind.method, json.loads(kind.settings)
        ctx = Context(kind.period, tuple(kind.features))
        own = models.where((F.col("method") == method) & (F.col("version") == kind.version) &
                           (F.col("settings") == kind.settings) & (F.col("period") == kind.period) &
                           (F.col("features") == F.array(*[F.lit(f) for f in kind.features]).cast("array<string>")))
        clash = {"method", "version", "period", "features", "settings", "numbers", "n", "fitted_to", "h", "prediction"}
        df = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in clash]).join(
            own.select("id", "numbers", "n", "fitted_to"), "id")
        if "t" not in rows.columns and "date" in rows.columns:
            after = F.col("date") > F.col("fitted_to")  # rows that repeat a date have the same position
            place = F.dense_rank().over(Window.partitionBy("id", after).orderBy("date"))
            back = F.dense_rank().over(Window.partitionBy("id", after).orderBy(F.desc("date")))
            df = df.withColumn("t", F.when(after, F.col("n") + place).otherwise(F.col("n") - back + 1))
        elif "t" not in rows.columns:
            df = df.withColumn("t", F.lit(None))
        df = df.withColumn("t", F.col("t").cast("int")).withColumn("h", F.greatest(F.col("t") - F.col("n"), F.lit(0)))
        df, value = STATES[method][1](df, ctx, params)
        if method not in ANY_ROW:
            value = F.when(F.col("h") > 0, value)
        keep = [c for c in rows.columns if c.lower() not in clash and c != "t"]
        parts.append(df.select(*keep, F.lit(method).alias("method"), F.lit(kind.version).alias("version"), "t", "h",
                               value.cast("double").alias("prediction")))
    if not parts:
        raise ValueError("there are no models")
    return reduce(lambda a, b: a.unionByName(b), parts)


def predictor(models: DataFrame, method: str) -> Callable[[DataFrame], DataFrame]:
    """A stored model as the function of rows that explanations ask for: adds ``prediction``. Rows bring ``t`` or are taken in
    order of dates."""
    own = models.where(F.col("method") == method)

    def predict(df: DataFrame) -> DataFrame:
        return score(own, df).drop("method", "version", "h", *([] if "t" in df.columns else ["t"]))

    return predict


def parameters(models: DataFrame) -> DataFrame:
    """Every number of every stored model in long form: id, method, version, parameter, position (from 0), value."""
    named = models.select(*KEYS, F.explode("numbers").alias("parameter", "_v"))
    return named.select(*KEYS, "parameter", F.posexplode("_v").alias("position", "value"))
