"""Seasonal ARIMA by two regressions (Hannan and Rissanen 1982), for all series at once.

Stage 1 regresses on many lags, as many as AICc wants around zero and around multiples of the season, and yields residuals;
stage 2 regresses on lags of the series and of the residuals. All candidate orders are subsets of one regression, so they
share one pass; of those that are stationary and invertible the smallest AICc wins. This approximates the maximum-likelihood
fit; it needs no iteration.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.text import dot
from seriesloom.operators.frames import BASE, RUN_KEYS, Context, filled_y, predictions, steps_ahead
from seriesloom.operators.linear import FIT_SCHEMA, _least_squares, _square, features_array, fit_in_place, fit_series, fitted, series_products
from seriesloom.operators.panel import by_date, whole

# Bounds of the automatic search: orders, seasonal orders, their sum, differences and seasonal differences.
MOST_ORDER, MOST_SEASONAL, MOST_SUM, MOST_DIFFERENCES = 5, 2, 5, 2
# Lags of the first regression: near zero, at multiples of the season, and on either side of such a multiple.
NEAR_LAGS, SEASON_LAGS, BESIDE = (2, 4, 8, 12), 4, 2
KPSS_LIMIT, KPSS_LAGS = 0.463, 30


def _orders(params: dict, m: int) -> tuple[int, int, int, int, list[list[int]]]:
    """Largest orders p, P, q, Q and the column subsets of all candidates; column 0 is the constant."""
    if params["auto_arima"]:
        p = q = MOST_ORDER if m <= 1 else max(1, min(MOST_ORDER, m - 1))
        cap_p = cap_q = MOST_SEASONAL if m > 1 else 0
        every = itertools.product(range(p + 1), range(q + 1), range(cap_p + 1), range(cap_q + 1), (True, False))
        options = [o for o in every if sum(o[:4]) <= MOST_SUM]
    else:
        p, q = int(params["non_seasonal_ar"]), int(params["non_seasonal_ma"])
        cap_p, cap_q = (int(params["seasonal_ar"]), int(params["seasonal_ma"])) if m > 1 else (0, 0)
        options = [(p, q, cap_p, cap_q, True)]
    subsets = []
    for i, j, s, r, constant in options:
        columns = [0] * constant + list(range(1, 1 + i)) + [1 + p + k for k in range(s)]
        columns += [1 + p + cap_p + k for k in range(j)] + [1 + p + cap_p + q + k for k in range(r)]
        if columns:
            subsets.append(columns)
    return p, cap_p, q, cap_q, subsets


def long_lags(p: int, cap_p: int, q: int, cap_q: int, m: int) -> tuple[list[int], list[list[int]]]:
    """Lags of the first regression in order, and the nested candidates among them as column subsets (0 is the constant).

    Near zero they reach at least past the orders; around multiples of the season they reach past the seasonal orders, as a
    seasonal moving average echoes in the regression at all these multiples.
    """
    near = sorted({*NEAR_LAGS, p + q + 2})
    lags = list(range(1, near[-1] + 1))
    ends = [k for k in near]
    seasons = max(SEASON_LAGS, cap_p + cap_q + 1) if m > 1 else 0
    for j in range(1, seasons + 1):
        new = [k for k in range(j * m - BESIDE, j * m + BESIDE + 1) if k > 0 and k not in lags]
        lags += new
        ends.append(len(lags))
    return lags, [list(range(e + 1)) for e in dict.fromkeys(ends)]


def is_stable(weights: np.ndarray) -> bool:
    """Whether x(t) = sum of weights[k - 1] x(t - k) dies out: all reflection coefficients lie inside the unit circle."""
    a = np.trim_zeros(np.asarray(weights, float), "b")
    while len(a):
        k = a[-1]
        if not abs(k) < 0.9995:
            return False
        a = (a[:-1] + k * a[:-1][::-1]) / (1 - k * k)
    return True


def _polynomials(beta: np.ndarray, p: int, cap_p: int, q: int, cap_q: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by lag of the autoregression and of the residuals (with the sign that makes their recursion)."""
    ar, ma = np.zeros(max(p, cap_p * m)), np.zeros(max(q, cap_q * m))
    for k in range(p):
        ar[k] += beta[1 + k]
    for k in range(cap_p):
        ar[(k + 1) * m - 1] += beta[1 + p + k]
    for k in range(q):
        ma[k] -= beta[1 + p + cap_p + k]
    for k in range(cap_q):
        ma[(k + 1) * m - 1] -= beta[1 + p + cap_p + q + k]
    return ar, ma


def _choose(p: int, cap_p: int, q: int, cap_q: int, m: int):
    """Solver for ``fit_series``: the subset with the least AICc among those that are stationary and invertible."""

    def solver(sums: DataFrame, subsets: list[list[int]], carry: list[str] = ()) -> DataFrame:
        @F.pandas_udf(FIT_SCHEMA)
        def solve(gram: pd.Series, n: pd.Series) -> pd.DataFrame:
            g, rows = _square(np.stack(gram.to_numpy())), n.to_numpy(dtype=float)
            width = g.shape[1] - 1
            d = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2)[:, :width], 0))
            d = np.where(d > 0, d, 1.0)
            a = g[:, :width, :width] / d[:, :, None] / d[:, None, :] + np.eye(width) * 1e-10
            b, yy = g[:, :width, width] / d, g[:, width, width]
            score = np.empty((len(g), len(subsets)))
            for c, subset in enumerate(subsets):
                s = np.array(subset)
                x = np.linalg.solve(a[:, s[:, None], s[None, :]], b[:, s, None])[:, :, 0]
                sse = np.maximum(yy - (x * b[:, s]).sum(1), 1e-12 * np.maximum(yy, 1e-300))
                k = len(s) + 1
                aicc = rows * np.log(np.maximum(sse, 1e-300) / np.maximum(rows, 1)) + 2 * k + 2 * k * (k + 1) / np.maximum(
                    rows - k - 1, 1e-9)
                score[:, c] = np.where(rows > k + 1, aicc, 1e300 * (1 + k / 100))
            out = []
            for i, order in enumerate(np.argsort(score, axis=1, kind="stable")):
                for c in order:
                    s = np.array(subsets[c])
                    beta, inverse = _least_squares(g[i][None, s[:, None], s[None, :]], g[i][None, s, width], np.zeros(len(s)))
                    full = np.zeros(width)
                    full[s] = beta[0]
                    if all(map(is_stable, _polynomials(full, p, cap_p, q, cap_q, m))):
                        break
                sse = max(float(yy[i] - beta[0] @ g[i, s, width]), 0.0)
                se = np.full(width, np.nan)
                se[s] = np.sqrt(np.maximum(inverse[0], 0) * sse / max(rows[i] - len(s), 1))
                out.append((full, se, sse, int(c), float(score[i, c])))
            return pd.DataFrame(out, columns=["beta", "se", "sse", "choice", "aicc"]).astype({"choice": "int32"})

        keys = [c for c in sums.columns if c not in ("n", "gram", *carry)]
        return sums.select(*keys, *carry, "n", solve("gram", "n").alias("f")).select(*keys, *carry, "n", "f.*")

    return solver


def _kpss(df: DataFrame) -> DataFrame:
    """Adds _eta, the KPSS statistic of level stationarity of z; the truncation lag grows with the root of the length."""
    w, everything = by_date(*RUN_KEYS), whole(*RUN_KEYS)
    df = df.withColumn("_e", F.col("z") - F.avg("z").over(everything))
    df = df.withColumn("_cum", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count("z").over(everything)
    reach = F.least(F.floor(3 * F.sqrt(n) / 13), F.lit(KPSS_LAGS))
    past = F.collect_list(F.coalesce("_e", F.lit(0.0))).over(w.rowsBetween(-KPSS_LAGS, -1))
    df = df.withColumns({"_past": past, "_reach": reach, "_n": n})
    near = F.slice("_past", F.greatest(F.size("_past") - F.col("_reach") + 1, F.lit(1)).cast("int"), F.col("_reach").cast("int"))
    df = df.withColumn("_near", near)
    weighted = F.aggregate(F.transform("_near", lambda e, i: e * (1 - (F.size("_near") - i) / (F.col("_reach") + 1))),
                           F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("_echo", F.col("_e") * weighted)
    spread = F.sum(F.col("_e") * F.col("_e")).over(everything) + 2 * F.coalesce(F.sum("_echo").over(everything), F.lit(0.0))
    eta = F.try_divide(F.sum(F.col("_cum") * F.col("_cum")).over(everything), F.col("_n") * spread)
    return df.withColumn("_eta", eta).drop("_e", "_cum", "_past", "_reach", "_n", "_echo", "_near")


def _with_differences(df: DataFrame, m: int, params: dict) -> DataFrame:
    """Adds dd, ds (orders of differencing) and z, the differenced y."""
    w, everything = by_date(*RUN_KEYS), whole(*RUN_KEYS)
    if not params["auto_arima"]:
        dd, ds = int(params["non_seasonal_differences"]), int(params["seasonal_differences"]) if m > 1 else 0
        df = df.withColumn("dd", F.lit(dd)).withColumn("ds", F.lit(ds)).withColumn("z", F.col("y"))
        for lag, times in ((m, ds), (1, dd)):
            for _ in range(times):
                df = df.withColumn("z", F.col("z") - F.lag("z", lag).over(w))
        return df
    if m > 1:
        from seriesloom.operators.models.smoothing import _phase_season

        half = max(1, m // 2)
        df = _phase_season(df, m, "_s").withColumn("_tr", F.avg("y").over(w.rowsBetween(-half, half)))
        rem = F.col("y") - F.col("_tr") - F.col("_s")
        strength = 1 - F.try_divide(F.var_samp(rem).over(everything), F.var_samp(rem + F.col("_s")).over(everything))
        long = F.count("y").over(everything) >= 3 * m
        df = df.withColumn("ds", F.when((strength > 0.64) & long, 1).otherwise(0)).drop("_s", "_tr")
        df = df.withColumn("z", F.when(F.col("ds") == 1, F.col("y") - F.lag("y", m).over(w)).otherwise(F.col("y")))
    else:
        df = df.withColumn("ds", F.lit(0)).withColumn("z", F.col("y"))
    df = df.withColumn("dd", F.lit(0))
    for k in range(MOST_DIFFERENCES):  # one more difference as long as the last one left the series unsteady
        more = (F.col("_eta") > KPSS_LIMIT) & (F.col("dd") == k)
        df = _kpss(df).withColumn("dd", F.when(more, k + 1).otherwise(F.col("dd"))).drop("_eta")
        df = df.withColumn("z", F.when(F.col("dd") == k + 1, F.col("z") - F.lag("z", 1).over(w)).otherwise(F.col("z")))
    return df


def difference_weights(dd: int, ds: int, m: int) -> list[float]:
    """Weights c_j with y(t) = z(t) + sum c_j y(t - j) for the given differences."""
    poly = [1.0]
    for lag, times in ((1, dd), (m, ds)):
        for _ in range(times):
            poly = [a - b for a, b in zip(poly + [0.0] * lag, [0.0] * lag + poly)]
    return [-c for c in poly[1:]]


def _nested_fit(ends: list[int]):
    """Coefficients of the first regression: of the first ``ends`` columns (in ascending steps) those that AICc prefers.

    The candidates are nested, so one elimination of the cross products, column by column, shows the error of each.
    """

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, n: pd.Series) -> pd.Series:
        g, rows = _square(np.stack(gram.to_numpy())), n.to_numpy(dtype=float)
        p = g.shape[1] - 1
        d = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 0))
        d = np.where(d > 0, d, 1.0)
        scaled = g / d[:, :, None] / d[:, None, :]
        left, best, pick = scaled.copy(), np.full(len(g), np.inf), np.full(len(g), ends[0])
        for j in range(p):
            pivot = left[:, j, j]
            fine = pivot > 1e-9
            ratio = np.where(fine[:, None], left[:, j + 1:, j] / np.where(fine, pivot, 1.0)[:, None], 0.0)
            left[:, j + 1:, j + 1:] -= ratio[:, :, None] * left[:, j, None, j + 1:]
            if j + 1 in ends:
                sse, k = np.maximum(left[:, p, p], 1e-12), j + 2
                aicc = rows * np.log(sse) + 2 * k + 2 * k * (k + 1) / np.maximum(rows - k - 1, 1e-9)
                aicc = np.where(rows > k + 1, aicc, 1e300 + k * 1e290)
                pick, best = np.where(aicc < best, j + 1, pick), np.minimum(best, aicc)
        out = np.zeros((len(g), p))
        for k in np.unique(pick):
            mine = np.flatnonzero(pick == k)
            a = scaled[mine][:, :k, :k] + np.eye(k) * 1e-9
            out[mine, :k] = np.linalg.solve(a, scaled[mine][:, :k, p, None])[:, :, 0] * d[mine, p, None] / d[mine, :k]
        return pd.Series(list(out))

    return solve.asNondeterministic()


def _long_residuals(df: DataFrame, lags: list[Column], ends: list[int]) -> DataFrame:
    """Adds e, what the first regression (constant and lags) leaves of z; zero where z is missing."""
    cells = F.transform(F.array(F.lit(1.0), *lags, F.col("z")), lambda v: F.coalesce(v, F.lit(float("nan"))))
    names = [c for c in df.columns if c not in RUN_KEYS]
    grouped = df.withColumn("_z", cells).groupBy(*RUN_KEYS).agg(F.array_sort(F.collect_list(F.struct(
        "t", *[c for c in names if c != "t"], "_z"))).alias("rows"))
    width = len(lags) + 2
    known = F.filter("rows", lambda r: r["z"].isNotNull())
    flat = F.flatten(F.transform(known, lambda r: r["_z"]))
    grouped = grouped.withColumn("_s", series_products(flat, F.lit(width)))
    grouped = grouped.withColumn("_b", _nested_fit(ends)("_s.gram", "_s.n"))
    rows = F.transform("rows", lambda r: r.dropFields("_z").withField("e", F.when(r["z"].isNull(), F.lit(0.0)).otherwise(
        r["z"] - dot(F.slice(r["_z"], 1, width - 1), F.col("_b")))))
    return grouped.select(*RUN_KEYS, F.inline(rows))


def arima_fit(frame: DataFrame, m: int, params: dict, extra: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """One row per (id, run): its rows with their regressors x, coefficients and orders; and the names of x."""
    p, cap_p, q, cap_q, subsets = _orders(params, m)
    w = by_date(*RUN_KEYS)
    df = _with_differences(filled_y(frame), m, params)
    lags, nested = long_lags(p, cap_p, q, cap_q, m)
    # in front of the series stands its mean, so that no row is lost to long lags
    df = df.withColumn("_mean", F.avg("z").over(whole(*RUN_KEYS)))
    before = lambda k: F.when(F.col("z").isNotNull(), F.coalesce(F.lag("z", k).over(w), F.col("_mean")))
    if q or cap_q:
        df = _long_residuals(df, [before(k) for k in lags], [len(c) for c in nested])
    else:
        df = df.withColumn("e", F.lit(0.0))
    df = df.withColumn("e", F.when(~F.col("ahead"), F.col("e")))
    auto = params["auto_arima"]
    lag_z = before if auto else lambda k: F.lag("z", k).over(w)
    lag_e = lambda k: F.lag("e", k, 0.0).over(w) if auto else F.lag("e", k).over(w)
    names = {f"z{k}": lag_z(k) for k in range(1, p + 1)}
    names.update({f"zs{k}": lag_z(k * m) for k in range(1, cap_p + 1)})
    names.update({f"e{k}": lag_e(k) for k in range(1, q + 1)})
    names.update({f"es{k}": lag_e(k * m) for k in range(1, cap_q + 1)})
    x2 = features_array(list(names))
    df = df.withColumns(names).withColumn("x", x2)
    columns = ["t", "date", "h", "ahead", "actual", "y", "z", "e", "x", "dd", "ds", *extra]
    solver = {"solver": _choose(p, cap_p, q, cap_q, m)} if auto else {}
    cells = [F.lit(1.0), *map(F.col, names)]
    fit = fit_series(df, RUN_KEYS, F.col("x"), F.col("z"), columns, cells=cells, subsets=subsets, **solver)
    first = F.element_at("rows", 1)
    return fit.withColumn("dd", first["dd"]).withColumn("ds", first["ds"]), list(names)


def memory(params: dict, m: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Values of z and e that a forecast looks back on, values of y, and the possible (differences, seasonal differences)."""
    p, cap_p, q, cap_q, _ = _orders(params, m)
    if params["auto_arima"]:
        pairs = [(a, b) for a in range(MOST_DIFFERENCES + 1) for b in ((0, 1) if m > 1 else (0,))]
    else:
        pairs = [(int(params["non_seasonal_differences"]), int(params["seasonal_differences"]) if m > 1 else 0)]
    return max(p, q, cap_p * m, cap_q * m, 1), max(a + b * m for a, b in pairs) or 1, pairs


def path(params: dict, m: int, z: Column, e: Column, y: Column, beta: Column, dd: Column, ds: Column, steps: Column) -> Column:
    """Forecasts of all steps as an array, from the last values of z, e and y (missing ones in front count as zero)."""
    p, cap_p, q, cap_q, _ = _orders(params, m)
    reach, back, pairs = memory(params, m)
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    start = F.struct(F.concat(zeros(reach), z).alias("z"), F.concat(zeros(reach), e).alias("e"),
                     F.concat(zeros(back), y).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(st, h):
        lags = [F.element_at(st["z"], -k) for k in range(1, p + 1)]
        lags += [F.element_at(st["z"], -k * m) for k in range(1, cap_p + 1)]
        lags += [F.element_at(st["e"], -k) for k in range(1, q + 1)]
        lags += [F.element_at(st["e"], -k * m) for k in range(1, cap_q + 1)]
        value = dot(F.array(F.lit(1.0), *lags), beta)
        level = F.lit(0.0)
        for a, b in pairs:
            past = F.lit(0.0)
            for j, c in enumerate(difference_weights(a, b, m), 1):
                if c:
                    past = past + c * F.element_at(st["y"], -j)
            level = F.when((dd == a) & (ds == b), past).otherwise(level)
        push = lambda a, v: F.concat(F.slice(a, 2, F.size(a) - 1), F.array(v))
        now = value + level
        return F.struct(push(st["z"], value).alias("z"), push(st["e"], F.lit(0.0)).alias("e"),
                        push(st["y"], now).alias("y"), F.concat(st["out"], F.array(now)).alias("out"))

    return F.aggregate(steps_ahead(steps), start, step, lambda s: s["out"])


def sarima(frame: DataFrame, ctx: Context, params: dict, extra: list[str] = ()) -> DataFrame:
    """ARIMA(p,d,q)(P,D,Q); with feature columns in the context, ARIMA errors around a regression on them.

    Rows with a missing regressor have no place in the regression: they are left out of the fit and predicted as null.
    """
    m = max(1, ctx.period)
    offset = None
    if ctx.features:
        x = features_array(list(ctx.features))
        frame = fit_in_place(frame, RUN_KEYS, x, F.col("y"), "_bx", penalty=[0.0] + [1e-6] * len(ctx.features))
        frame = frame.withColumn("_reg", fitted(x, F.col("_bx"))).drop("_bx")
        left_out = frame.where(F.col("_reg").isNull())
        frame = frame.where(F.col("_reg").isNotNull()).withColumn("y", F.col("y") - F.col("_reg"))
        extra = [*extra, "_reg"]
        offset = "_reg"
    arrays, names = arima_fit(frame, m, params, extra)
    arrays = arrays.withColumn("_known", F.filter("rows", lambda r: ~r["ahead"]))
    known = F.col("_known")
    reach, back, pairs = memory(params, m)
    tail = lambda field, k: F.transform(
        F.slice(known, F.greatest(F.size(known) - k + 1, F.lit(1)), F.lit(k)),
        lambda r: F.coalesce(r[field], F.lit(0.0)))
    b = F.col("beta")
    ahead = path(params, m, tail("z", reach), tail("e", reach), tail("y", back), b, F.col("dd"), F.col("ds"),
                 F.size("rows") - F.size(known))
    ahead = F.when(F.size(known) > 0, ahead).otherwise(F.transform(ahead, lambda _: F.lit(None).cast("double")))
    # the steps ahead are worked out once a series; fitted rows are plain arithmetic once the rows are back
    arrays = arrays.select(*RUN_KEYS, "rows", "beta", F.size("_known").alias("_k"), ahead.alias("_steps"))
    rows = arrays.select(*RUN_KEYS, "beta", "_k", "_steps", F.posexplode("rows").alias("_i", "_row")).select(
        *RUN_KEYS, "_row.*", "beta", "_k", "_steps", "_i")
    inside = F.col("y") - F.col("z") + fitted(F.col("x"), b, len(names) + 1)
    rows = rows.withColumn("_p", F.when(F.col("_i") < F.col("_k"), inside).otherwise(
        F.get("_steps", F.col("_i") - F.col("_k")))).drop("beta", "_k", "_steps", "_i")
    if offset:
        rows = rows.withColumn("_p", F.col("_p") + F.col("_reg"))
        left_out = left_out.withColumn("_p", F.lit(None).cast("double"))
        rows = rows.unionByName(left_out.select(*[c for c in rows.columns if c in left_out.columns]),
                                allowMissingColumns=True)
    out = predictions(rows, "SARIMA", F.col("_p"))
    keep = [c for c in extra if c != "_reg"]
    return out if not keep else rows.select(*BASE, F.lit("SARIMA").alias("model_desc"),
                                            F.col("_p").alias("prediction"), *keep)


def sarima_parameters(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Chosen differences, coefficients by name and AICc per (id, run)."""
    fit, names = arima_fit(frame, max(1, ctx.period), params)
    terms = F.map_from_arrays(F.array(*[F.lit(n) for n in ["constant", *names]]), F.col("beta"))
    return fit.select(*RUN_KEYS, F.col("dd").alias("d"), F.col("ds").alias("seasonal_d"),
                      terms.alias("coefficients"), "aicc")
