"""Models that are linear in a basis: one small solve per series, all series in one job.

linear regression, elastic net, hinge basis, several seasons, trend with changepoints, and nets with a random hidden
layer differ only in the columns they put in front of the solver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.constants import SEED
from seriesloom.functions import transforms as X
from seriesloom.functions.calendar import LABELS, signature
from seriesloom.functions.text import dot
from seriesloom.operators.features import add_holidays
from seriesloom.operators.frames import BASE, RUN_KEYS, Context, filled_y, predictions, steps_ahead
from seriesloom.operators.linear import (
    _grow_and_prune, elastic_net, features_array, fit_in_place, fit_series, fitted, grouped_ols, sparse_least_squares,
)
from seriesloom.operators.panel import by_date, whole

ROW = ["t", "date", "h", "ahead", "actual"]


def feature_names(frame: DataFrame, ctx: Context, method: str) -> tuple[DataFrame, list[str]]:
    """Columns a method regresses on: the given features, or the calendar and the position in the series."""
    if ctx.features:
        names = [c for c in ctx.features if not (method == "MARS" and "spline" in c)]
        return frame, names
    parts = {k: v for k, v in signature(F.col("date")).items() if k not in LABELS}
    return frame.withColumns({**parts, "time_trend": F.col("t")}), [*parts, "time_trend"]


def _solved(frame: DataFrame, x: Column, solver, **options) -> DataFrame:
    """Rows of every series with the coefficients next to them."""
    columns = [*ROW, "x"]
    fit = fit_series(frame.withColumn("x", x), RUN_KEYS, F.col("x"), F.col("y"), columns, solver=solver, **options)
    extra = ["choice"] if solver is elastic_net else []
    return fit.select(*RUN_KEYS, *extra, "beta", F.inline("rows"))


def linear(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    df, names = feature_names(frame, ctx, "Linear Regression")
    rows = fit_in_place(df, RUN_KEYS, features_array(names), F.col("y"))
    return predictions(rows, "Linear Regression", fitted(features_array(names)))


def net_path(frame: DataFrame, ctx: Context, grid: list[tuple[float, float]]) -> DataFrame:
    """Elastic net predictions for a whole grid of (penalty, mixture); ``choice`` is the index in the grid."""
    df, names = feature_names(frame, ctx, "Elastic Net")
    rows = _solved(df, features_array(names), elastic_net, grid=grid)
    return rows.select("choice", *BASE, F.lit("Elastic Net").alias("model_desc"),
                       fitted(F.col("x")).alias("prediction"))


def elastic(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    return net_path(frame, ctx, [(float(params["penalty"]), float(params["mixture"]))]).drop("choice")


# Knots of the first look (tenths of the sorted values), knots around the strongest one in each further look, the number of
# such looks, and the terms whose products are tried for degree 2.
TENTHS, AROUND, LOOKS, PARTNERS = 9, 4, 3, 8


def hinge_basis(f: Column, knots: Column, pairs: Column | None = None) -> Column:
    """Constant, features and hinges at their knots, and products of the terms at the places in ``pairs``."""
    terms = F.flatten(F.zip_with(f, knots, lambda v, ks: F.concat(
        F.array(v), F.transform(ks, lambda k: F.greatest(v - k, F.lit(0.0))))))
    x = F.concat(F.array(F.lit(1.0)), terms)
    if pairs is None:
        return x
    from seriesloom.functions.text import let

    return let(x, lambda b: F.concat(b, F.transform(pairs, lambda p: F.coalesce(
        F.get(b, p["a"]) * F.get(b, p["b"]), F.when(p["a"] < 0, F.lit(0.0))))))


def _closer(values: list[np.ndarray], ranks: list[np.ndarray], beta: np.ndarray, share: int) -> list[np.ndarray]:
    """Ranks of the next look at each feature: the tenths, and others around its strongest hinge, up to 1/share of the values away."""
    out, count = [], len(ranks[0])
    for i, (v, at) in enumerate(zip(values, ranks)):
        size = np.abs(beta[i * (count + 1) + 2:][:count])
        here = at[size.argmax()] if size.max() > 0 else at[TENTHS // 2]
        step, last = max(len(v) / (share * AROUND), 1.0), max(len(v) - 1, 0)
        away = np.arange(-AROUND, AROUND + 1) * step
        away = (np.sign(away) * np.floor(np.abs(away) + 0.5)).astype(int)  # halves go away from zero
        out.append(np.concatenate((at[:TENTHS], np.clip(here + away, 0, last))))
    return out


def _hinge_values(f: np.ndarray, knots: list[np.ndarray], pairs: list[tuple[int, int]] = ()) -> np.ndarray:
    """``hinge_basis`` of many rows at once."""
    columns = [np.ones(len(f))]
    for v, at in zip(f.T, knots):
        columns += [v, *[np.maximum(v - k, 0.0) for k in at]]
    columns += [columns[a] * columns[b] if a >= 0 else np.zeros(len(f)) for a, b in pairs]
    return np.column_stack(columns)


def _look_at_hinges(f: np.ndarray, y: np.ndarray, terms: int, prune: str, degree: int):
    """Knots, pairs and coefficients of one series from its fitted rows."""
    whole_rows = np.isfinite(f).all(axis=1) & np.isfinite(y)
    values = [np.sort(v[~np.isnan(y) & ~np.isnan(v)]) for v in f.T]
    ranks = [np.array([k * max(len(v) - 1, 0) // (TENTHS + 1) for k in range(1, TENTHS + 1)]) for v in values]

    def solved(pairs=()):
        knots = [v[at] if len(v) else np.full(len(at), np.nan) for v, at in zip(values, ranks)]
        z = np.column_stack((_hinge_values(f[whole_rows], knots, pairs), y[whole_rows]))
        return knots, _grow_and_prune(z.T @ z, len(z), terms, prune)

    knots, beta = solved()
    for look in range(LOOKS):
        ranks = _closer(values, ranks, beta, (TENTHS + 1) * AROUND**look)
        knots, beta = solved()
    if degree < 2:
        return knots, [], beta
    strong = sorted(((abs(b), i) for i, b in enumerate(beta) if i > 0 and b != 0), reverse=True)[:PARTNERS]
    at = [i for _, i in strong] + [-1] * (PARTNERS - len(strong))
    both = [(i, j) for i in range(PARTNERS) for j in range(i + 1, PARTNERS)]
    pairs = [(at[i], at[j]) if at[j] >= 0 else (-1, -1) for i, j in both]
    knots, beta = solved(pairs)
    return knots, pairs, beta


def hinge_fit(frame: DataFrame, names: list[str], params: dict) -> DataFrame:
    """One row per series: rows (with features f), knots, pairs (for degree 2) and beta.

    Knots are values of the fitted rows. The first look has the tenths of each feature; every further look keeps these and
    places others around the strongest hinge of each feature, closer each time, so that after LOOKS looks the knots stand at
    every few hundredths of a percent of the values (at every value of short series). Looks work on the gathered rows: one
    shuffle serves all. Degree 2 adds products of the strongest terms chosen so far. All looks of a series are one call, so
    that a task keeps one Python worker for them, whatever their number.
    """
    terms, prune = int(params["num_terms"]), "none" if params["prune_method"] in ("none", "forward") else "backward"
    degree, width = int(params["prod_degree"]), len(names)
    f = F.array(*[F.col(c).cast("double") for c in names])
    row = F.struct(*ROW, F.col("y").cast("double").alias("y"), f.alias("f"))
    df = frame.groupBy(*RUN_KEYS).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    df = df.where(F.exists("rows", lambda r: ~r["ahead"]))

    @F.pandas_udf("knots array<array<double>>, pairs array<struct<a:int,b:int>>, beta array<double>")
    def fit(flat: pd.Series) -> pd.DataFrame:
        found = []
        for cells in flat:
            z = np.asarray(cells, dtype=float).reshape(-1, width + 1)
            found.append(_look_at_hinges(z[:, :-1], z[:, -1], terms, prune, degree))
        return pd.DataFrame({
            "knots": [[list(np.where(np.isnan(k), None, k)) for k in knots] for knots, _, _ in found],
            "pairs": [[{"a": a, "b": b} for a, b in pairs] for _, pairs, _ in found],
            "beta": [beta for _, _, beta in found]})

    known = F.filter("rows", lambda r: ~r["ahead"])
    flat = F.flatten(F.transform(known, lambda r: F.transform(
        F.concat(r["f"], F.array(r["y"])), lambda v: F.coalesce(v, F.lit(float("nan"))))))
    return df.select(*RUN_KEYS, "rows", fit.asNondeterministic()(flat).alias("fit")).select(*RUN_KEYS, "rows", "fit.*")


def hinges(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Hinge basis (and products of its terms for degree 2), grown and pruned term by term."""
    df, names = feature_names(frame, ctx, "MARS")
    fit = hinge_fit(df, names, params)
    rows = fit.select(*RUN_KEYS, "knots", "pairs", "beta", F.inline("rows"))
    rows = rows.withColumn("x", hinge_basis(F.col("f"), F.col("knots"), F.col("pairs")))
    return predictions(rows, "MARS", fitted(F.col("x")))


def _scaled_time() -> Column:
    return F.col("t") / F.max(F.when(~F.col("ahead"), F.col("t"))).over(whole(*RUN_KEYS))


def _waves(t: Column, period: float, k: int) -> list[Column]:
    out = []
    for order in range(1, k + 1):
        angle = t * (2 * math.pi * order / period)
        out += [F.sin(angle), F.cos(angle)]
    return out


MOST_WAVES = 12  # Fourier order of a season in the search


def season_terms(ctx: Context, params: dict) -> tuple[Column, list[list[int]]]:
    """Trend (in column _u) and Fourier terms of the seasons, and the candidate subsets: orders of all seasons rise together, and
    each season alone goes on rising while the others stay low."""
    if params["auto_tbats"]:
        lengths = [ctx.period]
    else:
        lengths = [int(params[f"tbats_seasonal_period_{i}"]) for i in (1, 2, 3)]
    columns, blocks = [F.lit(1.0), F.col("_u")], []
    for p in dict.fromkeys(p for p in lengths if p > 1):
        most = min(MOST_WAVES, p // 2)
        blocks.append([len(columns) + 2 * k for k in range(most + 1)])
        columns += _waves(F.col("t"), p, most)
    top = max([len(b) - 1 for b in blocks], default=0)
    orders = [[k] * len(blocks) for k in range(1, top + 1)]
    orders += [[k if i == j else low for j in range(len(blocks))]
               for i in range(len(blocks)) for k in range(1, top + 1) for low in (0, 1, 2, 3) if len(blocks) > 1]
    subsets = [[0], [0, 1]]
    for order in orders:
        used = [0, 1]
        for k, ends in zip(order, blocks):
            used += list(range(ends[0], ends[min(k, len(ends) - 1)]))
        subsets += [used, [c for c in used if c != 1]]
    return F.array(*[c.cast("double") for c in columns]), [list(s) for s in dict.fromkeys(map(tuple, subsets))]


def several_seasons(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Trend and Fourier terms of up to three seasons (orders by AICc) with first-order errors."""
    x, subsets = season_terms(ctx, params)
    df = filled_y(frame).withColumn("_u", _scaled_time()).withColumn("x", x)
    rows = fit_in_place(df, RUN_KEYS, F.col("x"), F.col("y"), subsets=subsets)
    w, everything = by_date(*RUN_KEYS), whole(*RUN_KEYS)
    rows = rows.withColumn("_line", fitted(F.col("x"))).withColumn("_e", F.col("y") - F.col("_line"))
    rows = rows.withColumn("_e1", F.lag("_e").over(w))
    phi = F.try_divide(F.sum(F.col("_e") * F.col("_e1")).over(everything),
                       F.sum(F.col("_e") * F.col("_e")).over(everything))
    last = F.last("_e", ignorenulls=True).over(w)
    rows = rows.withColumn("_phi", F.coalesce(phi, F.lit(0.0))).withColumn("_last", last)
    inside = F.col("_line") + F.coalesce(F.col("_phi") * F.col("_e1"), F.lit(0.0))
    ahead = F.col("_line") + F.coalesce(F.pow("_phi", "h") * F.col("_last"), F.lit(0.0))
    return predictions(rows, "TBATS", F.when(F.col("ahead"), ahead).otherwise(inside))


def trend_terms(df: DataFrame, ctx: Context, params: dict) -> tuple[DataFrame, Column, dict]:
    """The frame with holiday flags, and the columns of the model (scaled time in column _u) with the penalties of their priors.

    Changes of the trend have a Laplace prior, which leaves most of them at zero; seasons and effects a normal one. Both assume
    errors of a tenth of the largest value.
    """
    count, span = int(params["changepoint_num"]), float(params["changepoint_range"])
    columns = [F.lit(1.0), F.col("_u")]
    penalty, sparse = [0.0, 1e-6], [0.0, 0.0]
    knots = [span * (j + 1) / (count + 1) for j in range(count)]
    columns += [F.greatest(F.col("_u") - c, F.lit(0.0)) for c in knots]
    penalty += [0.0] * count
    sparse += [0.01 / float(params["prior_scale_changepoints"])] * count
    day = F.datediff(F.col("date").cast("date"), F.lit("2000-01-01").cast("date")) + F.hour("date") / 24.0
    seasons = [("seasonality_yearly", 365.25, 10), ("seasonality_weekly", 7, 3), ("seasonality_daily", 1, 4)]
    for name, length, k in seasons:
        if params[name]:
            columns += _waves(day, length, k)
            penalty += [0.01 / float(params["prior_scale_seasonality"]) ** 2] * (2 * k)
    df = add_holidays(df)
    flags = [c for c in df.columns if c.startswith("holiday_")]
    columns += [F.col(c) for c in flags] + [F.col(c) for c in ctx.features]
    penalty += [0.01 / float(params["prior_scale_holidays"]) ** 2] * (len(flags) + len(ctx.features))
    sparse += [0.0] * (len(penalty) - len(sparse))
    return df, F.array(*[c.cast("double") for c in columns]), {"solver": sparse_least_squares, "l1": sparse, "l2": penalty}


def changepoints(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Piecewise trend, yearly/weekly/daily seasons, holidays and regressors with penalties from prior scales.

    Multiplicative seasons work on the log scale; logistic growth on the logit between floor and cap.
    """
    logistic = params["growth"] == "logistic"
    multiplicative = params["prophet_season"] == "multiplicative"
    y = F.col("y")
    df = frame
    if logistic:
        cap = F.lit(float(params["logistic_cap"])) if params["logistic_cap"] else 1.2 * F.max(y).over(
            whole(*RUN_KEYS))
        df = df.withColumn("_hi", cap).withColumn("_lo", F.lit(float(params["logistic_floor"])))
        df = df.withColumn("y", X.log_interval(y, F.col("_lo"), F.col("_hi")))
    elif multiplicative:
        df = df.withColumn("y", F.when(y > 0, F.ln(y)))
    # the penalties are meant for a target of unit scale
    df = df.withColumn("_scale", F.coalesce(F.nullif(F.max(F.abs(F.col("y"))).over(whole(*RUN_KEYS)), F.lit(0.0)),
                                            F.lit(1.0)))
    df = df.withColumn("_u", _scaled_time()).withColumn("_ys", F.col("y") / F.col("_scale"))
    df, x, options = trend_terms(df, ctx, params)
    keep = [*ROW, "_scale", "x"] + (["_lo", "_hi"] if logistic else [])
    df = df.withColumn("x", x)
    fit = fit_series(df, RUN_KEYS, F.col("x"), F.col("_ys"), keep, **options)
    rows = fit.select(*RUN_KEYS, "beta", F.inline("rows"))
    value = fitted(F.col("x")) * F.col("_scale")
    if logistic:
        value = X.inverse_log_interval(value, F.col("_lo"), F.col("_hi"))
    elif multiplicative:
        value = F.exp(value)
    return predictions(rows, "Prophet", value)


def _random_layer(inputs: Column, width: int, units: int, seed: int) -> list[Column]:
    """Hidden units tanh(w . x + b) with fixed random weights."""
    rng = np.random.default_rng(seed)
    scale = 1 / math.sqrt(max(width, 1))
    out = []
    for _ in range(units):
        weights = F.array(*[F.lit(float(v)) for v in rng.normal(0, scale, width)])
        out.append(F.tanh(dot(inputs, weights) + float(rng.uniform(-1, 1))))
    return out


def moments(names: list[str]) -> dict[str, Column]:
    """Means and standard deviations of the fitted rows of a series, as arrays _mean and _sd."""
    known = [F.when(~F.col("ahead"), F.col(c).cast("double")) for c in names]
    return {"_mean": F.array(*[F.avg(k).over(whole(*RUN_KEYS)) for k in known]),
            "_sd": F.array(*[F.stddev_samp(k).over(whole(*RUN_KEYS)) for k in known])}


def scaled_by_moments(names: list[str]) -> Column:
    """Features in units of _sd around _mean; a constant feature is zero."""
    out = []
    for i, c in enumerate(names):
        mean, sd = F.col("_mean")[i], F.col("_sd")[i]
        out.append(F.when(sd > 0, (F.col(c) - mean) / F.nullif(sd, F.lit(0.0))).otherwise(
            F.when(F.col(c).isNotNull(), F.lit(0.0))))
    return F.array(*out)


def hidden_layer(names: list[str], params: dict) -> tuple[Column, list[float]]:
    """Constant and hidden units of the net, with the ridge penalties of the output layer."""
    units = int(params["ff_hidden_units"])
    hidden = _random_layer(scaled_by_moments(names), len(names), units, SEED)
    return F.array(F.lit(1.0), *hidden), [0.0] + [1e-3 + float(params["ff_penalty"])] * units


def _standardised(names: list[str]) -> list[Column]:
    out = []
    for c in names:
        known = F.when(~F.col("ahead"), F.col(c).cast("double"))
        mean, sd = F.avg(known).over(whole(*RUN_KEYS)), F.stddev_samp(known).over(whole(*RUN_KEYS))
        out.append(F.when(sd > 0, (F.col(c) - mean) / F.nullif(sd, F.lit(0.0))).otherwise(
            F.when(F.col(c).isNotNull(), F.lit(0.0))))
    return out


def feed_forward(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """One hidden layer with random weights and a ridge output layer (extreme learning machine)."""
    df, names = feature_names(frame, ctx, "Feed-Forward")
    x, ridge = hidden_layer(names, params)
    rows = _solved(df.withColumns(moments(names)), x, _ridge(ridge))
    return predictions(rows, "Feed-Forward", fitted(F.col("x")))


def _ridge(penalty: list[float]):
    from seriesloom.operators.linear import least_squares

    return lambda sums, carry: least_squares(sums, penalty=penalty, carry=carry)


def feed_forward_ar(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Autoregressive nets: lags in, several random hidden layers, predictions averaged; recursive over the horizon."""
    m = max(1, ctx.period)
    lags = list(range(1, max(1, int(params["ffar_non_seasonal_ar"])) + 1))
    lags += [k * m for k in range(1, int(params["ffar_seasonal_ar"]) + 1) if m > 1 and k * m not in lags]
    nets, units = int(params["ffar_num_networks"]), int(params["ffar_hidden_units"])
    w, everything = by_date(*RUN_KEYS), whole(*RUN_KEYS)
    df = filled_y(frame)
    df = df.withColumn("_mu", F.avg("y").over(everything)).withColumn("_sd", F.coalesce(F.nullif(
        F.stddev_samp("y").over(everything), F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("z", (F.col("y") - F.col("_mu")) / F.col("_sd"))
    df = df.withColumn("_in", F.array(*[F.lag("z", k).over(w) for k in lags]))
    layers = [(lambda v, i=i: _random_layer(v, len(lags), units, SEED + i)) for i in range(nets)]
    columns = [*ROW, "z", "_mu", "_sd"]
    ridge = [0.0] + [1e-2 + float(params["ffar_penalty"])] * units
    # one row per (id, run): its rows once, and one output layer per network
    for i, layer in enumerate(layers):
        x = F.array(F.lit(1.0), *layer(F.col("_in")))
        df = df.withColumn(f"_x{i}", x)
    gathered = fit_series(
        df, RUN_KEYS, F.flatten(F.array(*[F.col(f"_x{i}") for i in range(nets)])), F.col("z"), columns,
        solver=_per_network(nets, units + 1, ridge))
    known = F.filter("rows", lambda r: ~r["ahead"])
    zs = F.transform(known, lambda r: F.coalesce(r["z"], F.lit(0.0)))
    reach = max(lags)

    def net_value(history: Column) -> Column:
        inputs = F.array(*[F.element_at(history, -k) for k in lags])
        parts = []
        for i, layer in enumerate(layers):
            parts.append(dot(F.array(F.lit(1.0), *layer(inputs)), F.element_at(F.col("betas"), i + 1)))
        return sum(parts[1:], parts[0]) / nets

    start = F.struct(F.concat(F.array_repeat(F.lit(0.0), reach), F.slice(
        zs, F.greatest(F.size(zs) - reach + 1, F.lit(1)), F.lit(reach))).alias("hist"),
        F.array().cast("array<double>").alias("out"))

    def step(st, h):
        from seriesloom.functions.text import let

        return let(net_value(st["hist"]), lambda v: F.struct(
            F.concat(F.slice(st["hist"], 2, F.size(st["hist"]) - 1), F.array(v)).alias("hist"),
            F.concat(st["out"], F.array(v)).alias("out")))

    ahead = F.aggregate(steps_ahead(F.size("rows") - F.size(known)), start, step, lambda s: s["out"])
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), reach), zs)
    inside = F.transform(known, lambda r, i: net_value(F.slice(padded, i + 1, F.lit(reach))))
    values = F.concat(inside, ahead)
    rows = gathered.select(*RUN_KEYS, F.explode(F.arrays_zip("rows", values.alias("p"))).alias("q"))
    rows = rows.select(*RUN_KEYS, "q.rows.*", F.col("q.p").alias("_p"))
    return predictions(rows, "Feed-Forward AR", F.col("_p") * F.col("_sd") + F.col("_mu"))


def _per_network(nets: int, width: int, ridge: list[float]):
    """Solver: ridge output layer of every network from the cross products of all of them."""
    from seriesloom.operators.linear import _least_squares, _square

    def solver(sums: DataFrame, carry: list[str]) -> DataFrame:
        @F.pandas_udf("array<array<double>>")
        def solve(gram: pd.Series) -> pd.Series:
            m = _square(np.stack(gram.to_numpy()))
            out = []
            for i in range(nets):
                s = np.arange(i * width, (i + 1) * width)
                beta, _ = _least_squares(m[:, s[:, None], s[None, :]], m[:, s, -1], np.asarray(ridge))
                out.append(beta)
            return pd.Series([[o[j] for o in out] for j in range(len(m))])

        return sums.select(*RUN_KEYS, *carry, solve("gram").alias("betas"))

    return solver


#: Random Fourier features of the radial variant; rounds of reweighting if the coefficients never stand still.
RADIAL, MOST_ROUNDS = 256, 500


def support_vector(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Regression with the epsilon-insensitive loss for each series, by reweighted least squares until it stands still.

    Targets and features are standardised by the fitted rows of the series; the radial variant puts RADIAL random Fourier
    features in front.
    """
    from seriesloom.operators.models.trees import by_series

    cost, margin, radial = float(params["cost"]), float(params["margin"]), params["boundary"] == "Radial"
    spread = math.sqrt(2 * float(params["rbf_sigma"]))

    def scaled(values, rows):
        mean, sd = rows.mean(0), rows.std(0, ddof=1)
        return (values - mean) / np.where(sd > 1e-12, sd, 1.0), mean, np.where(sd > 1e-12, sd, 1.0)

    def predict(x, y, known):
        z, _, _ = scaled(x, x[known])
        target, mu, sd = scaled(y, y[known])
        if radial:
            random = np.random.default_rng(SEED)
            turn = random.normal(0, spread, (z.shape[1], RADIAL))
            z = np.cos(z @ turn + random.uniform(0, 2 * math.pi, RADIAL)) * math.sqrt(2 / RADIAL)
        z = np.column_stack((np.ones(len(z)), z))
        ridge = np.diag([1e-9] + [1.0] * (z.shape[1] - 1))
        inside, wanted, beta = z[known], target[known], None
        for _ in range(MOST_ROUNDS):
            if beta is None:
                weight, aim = np.full(len(wanted), cost), wanted
            else:
                error = wanted - inside @ beta
                size = np.abs(error)
                weight = np.where(size > margin, cost / np.maximum(size, 1e-3), 1e-6)
                aim = wanted - np.sign(error) * np.minimum(margin, size)
            new = np.linalg.solve(inside.T @ (inside * weight[:, None]) + ridge, inside.T @ (aim * weight))
            still = beta is not None and np.abs(new - beta).max() <= 1e-6 * max(1.0, np.abs(new).max())
            beta = new
            if still:
                break
        return mu + sd * (z @ beta)

    return by_series(frame, ctx, "SVM", predict)
