"""Exponential smoothing, the Theta method, and decomposition with a smoothed remainder.

Spark gathers each series of each run into one array (as long as the calendar allows, never several series) and spreads
the arrays over the tasks. A vectorised helper then steps through time once for all series of an Arrow batch and all
candidates of the parameter grid together, so the grid adds neither rows nor shuffles.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.text import let
from seriesloom.operators.frames import RUN_KEYS, Context, as_arrays, explode_arrays
from seriesloom.operators.panel import by_date, whole

ALPHAS, BETAS, GAMMAS, PHI = (0.1, 0.3, 0.6, 0.9), (0.05, 0.2), (0.05, 0.2), 0.9
ETS_SCHEMA = ("season string, trended boolean, damped boolean, alpha double, beta double, gamma double, phi double, aicc double, "
              "values array<double>, level double, slope double, slots array<double>")
SEARCHED = ("alpha", "beta", "gamma", "phi")
# Range of each parameter, first step of the refinement, step and gain at which it stands still, and forms refined a series.
RANGES = {"alpha": (1e-4, 0.9999), "beta": (0.0, 0.9999), "gamma": (0.0, 0.9999), "phi": (0.8, 0.98)}
FIRST_STEP, LAST_STEP, LEAST_GAIN, FINALISTS = 0.1, 3e-3, 1e-6, 2
LONG = 2000  # points beyond which a series is worked on in segments
NO_ROOM = 1e9  # added to the score of candidates with more parameters than the series can carry: among them the error decides
BATCH_CELLS = 400_000  # series x candidates held at once in a task


def _d(x: float) -> Column:
    return F.lit(float(x))


def _recursion(y, n, grid, season, m, trend, relative, fitted=None):
    """Run the smoothing recursions for series (rows of y, padded) and candidates (columns of the grid arrays).

    Returns level, slope, season slots and the error sums after the last value of every series.
    """
    alpha, beta, gamma, phi, trended = (grid[k] for k in ("alpha", "beta", "gamma", "phi", "trended"))
    rows, cols = np.arange(len(y)), alpha.shape[1]
    grow = trend == "multiplicative"
    if season == "none":
        k = np.minimum(n, max(m, 2))
        level, far, reach = y[:, 0], y[rows, k - 1], np.maximum(k - 1, 1)
        with np.errstate(all="ignore"):
            slope = np.where(level * far > 0, np.abs(far / level) ** (1 / reach), 1.0) if grow else (far - level) / reach
    else:
        level = y[:, :m].mean(1)
        rise = (y[:, m:2 * m].mean(1) - level) / m
        with np.errstate(all="ignore"):
            slope = np.maximum(1 + rise / level, 0.01) if grow else rise
    level = np.repeat(level[:, None], cols, 1)
    slope = np.where(trended > 0, slope[:, None], 1.0 if grow else 0.0) * np.ones((1, cols))
    if season != "none":
        first = y[:, :m].T[:, :, None]
        slots = first - level if season == "additive" else first / level
    else:
        slots = np.zeros((1, 1, 1))
    if y.shape[1] > LONG and season != "multiplicative" and not grow and not relative:
        return _by_segments(y, n, grid, season, m, level, slope, slots, fitted)
    return _walk(y, n, grid, season, m, grow, relative, level, slope, slots, fitted)


def _walk(y, n, grid, season, m, grow, relative, level, slope, slots, fitted=None):
    """The recursions from given states, step by step for all rows and candidates."""
    alpha, beta, gamma, phi = (grid[k] for k in ("alpha", "beta", "gamma", "phi"))
    sse, logs = np.zeros_like(level), np.zeros_like(level)
    for t in range(y.shape[1]):
        live = (t < n)[:, None]
        now = y[:, t][:, None]
        base = level * slope**phi if grow else level + phi * slope
        if season == "none":
            hat, plain = base, now
        elif season == "additive":
            hat, plain = base + slots[t % m], now - slots[t % m]
        else:
            hat, plain = base * slots[t % m], now / np.where(slots[t % m] == 0, 1.0, slots[t % m])
        if fitted is not None:
            fitted[:, t] = hat[:, 0]
        error = now - hat
        if relative:
            safe = np.where(hat == 0, 1e-12, hat)
            error, logs = error / safe, np.where(live, logs + np.log(np.abs(safe)), logs)
        sse = np.where(live, sse + error * error, sse)
        new = alpha * plain + (1 - alpha) * base
        if grow:
            ratio = np.where(level == 0, 1.0, new / np.where(level == 0, 1.0, level))
            moved = np.maximum(beta * ratio + (1 - beta) * slope**phi, 0.01)
        else:
            moved = beta * (new - level) + (1 - beta) * phi * slope
        if season == "additive":
            slots[t % m] = np.where(live, gamma * (now - base) + (1 - gamma) * slots[t % m], slots[t % m])
        elif season == "multiplicative":
            fresh = now / np.where(base == 0, 1.0, base)
            slots[t % m] = np.where(live, gamma * fresh + (1 - gamma) * slots[t % m], slots[t % m])
        slope = np.where(live, moved, slope)
        level = np.where(live, new, level)
    return level, slope, slots, sse, logs


def _by_segments(y, n, grid, season, m, level, slope, slots, fitted=None):
    """The recursions of long series whose step is affine in the state, all segments of a series side by side.

    What a segment makes of its first state is a matrix that all segments share (they start at the same phase), and what it
    adds is its result from a state of zeros. Composed along the series these give the first state of every segment, from
    which one more pass yields errors and fitted values. Steps in Python: twice the root of the length.
    """
    cols, phases = level.shape[1], m if season == "additive" else 1
    size = 2 + (phases if season == "additive" else 0)
    ends = np.zeros_like(level), np.zeros_like(level), np.zeros((phases, *level.shape)), np.zeros_like(level)
    for i in range(len(y)):
        own = {k: np.broadcast_to(v, level.shape)[i:i + 1] for k, v in grid.items()}
        length = -(-int(np.ceil(np.sqrt(n[i]))) // phases) * phases
        count = max(1, -(-int(n[i]) // length))
        parts = np.zeros((count, length))
        parts.ravel()[:n[i]] = y[i, :n[i]]
        sizes = np.clip(n[i] - length * np.arange(count), 0, length)

        def run(values, live, states, into=None):
            a, b, c = states[:, :, 0], states[:, :, 1], np.moveaxis(states[:, :, 2:], 2, 0)
            c = c.copy() if size > 2 else np.zeros((1, 1, 1))
            a, b, c, sse, _ = _walk(values, live, own, season, m, False, False, a.copy(), b.copy(), c, into)
            out = np.stack([a, b, *(c if size > 2 else ())], axis=2)
            return out, sse

        added, _ = run(parts, np.full(count, length), np.zeros((count, cols, size)))
        basis = np.repeat(np.eye(size)[:, None, :], cols, 1)
        turned, _ = run(np.zeros((size, length)), np.full(size, length), basis)  # [basis, candidate, state]
        first = np.stack([level[i], slope[i], *(np.broadcast_to(slots, (phases, *level.shape))[:, i] if size > 2 else ())], 1)
        starts = np.empty((count, cols, size))
        for k in range(count):
            starts[k] = first
            first = np.einsum("bcs,cb->cs", turned, first) + added[k]
        inside = np.zeros((count, length)) if fitted is not None else None
        last, sse = run(parts, sizes, starts, inside)
        if fitted is not None:
            fitted[i, :n[i]] = inside.ravel()[:n[i]]
        ends[0][i], ends[1][i], ends[3][i] = last[-1, :, 0], last[-1, :, 1], sse.sum(0)
        if size > 2:
            ends[2][:, i] = last[-1, :, 2:].T
    return ends[0], ends[1], ends[2] if size > 2 else slots, ends[3], np.zeros_like(level)


def _ahead(level, slope, slots, phi, n, steps, season, m, trend):
    """Forecasts of one series from its final state."""
    h = np.arange(1, steps + 1)
    reach = h if phi >= 1 else phi * (1 - phi**h) / (1 - phi)
    line = level * slope**reach if trend == "multiplicative" else level + slope * reach
    if season == "none":
        return line
    now = slots[(n + h - 1) % m]
    return line + now if season == "additive" else line * now


def _grid(trends, season, params):
    """Candidate parameters as columns of shape (1, C), with the number of parameters of each."""
    fixed = not params["auto_ets"]
    alphas = (params["smooth_level"],) if fixed else params.get("alphas", ALPHAS)
    betas = (params["smooth_trend"],) if fixed else BETAS
    gammas = (params["smooth_season"],) if fixed else GAMMAS
    out = []
    for form in trends:
        trended = form != "none"
        phi = PHI if form == "damped" else 1.0
        for a, b, c in itertools.product(alphas, betas if trended else (0.0,), gammas if season != "none" else (0.0,)):
            out.append((a, b, c, phi, float(trended), 3.0 + 2 * trended + (form == "damped")))
    names = ("alpha", "beta", "gamma", "phi", "trended", "k")
    return {k: np.array([[c[i] for c in out]], dtype=float) for i, k in enumerate(names)}


def _ets_forms(period: int, params: dict) -> tuple[list[str], list[str], str, bool]:
    """Season types, trend types, kind of trend and kind of error to try."""
    if params.get("level_only"):
        return ["none"], ["none"], "additive", False
    if params["auto_ets"]:
        return (["none", "additive", "multiplicative"] if period > 1 else ["none"],
                ["none", "additive", "damped"], "additive", False)
    seasons = ["none"] + ([params["season"]] if params["season"] != "none" and period > 1 else [])
    damped = params["damping"] not in ("none", False, None)
    trends = ["none" if params["trend"] == "none" else "damped" if damped else "additive"]
    kind = "multiplicative" if params["trend"] == "multiplicative" else "additive"
    return seasons, trends, kind, params["error"] == "multiplicative"


def _score(sse, logs, size, k):
    """AICc; candidates without room for it come after all others and are told apart by their error."""
    room = size - k - 1
    fit = size * np.log(np.maximum(sse / size, 1e-300)) + 2 * logs
    aicc = fit + 2 * k + 2 * k * (k + 1) / np.maximum(room, 1)
    return np.where(np.isfinite(fit), np.where(room > 0, aicc, fit + NO_ROOM), 1e300)


def _refine(y, n, own, score, season, m, kind, relative):
    """Move the parameters of every series (own: arrays of its length) until its score stands still.

    A round tries a step up and down in each parameter for all series at once; where none helps, the step is halved.
    """
    own = {k: v.copy() for k, v in own.items()}
    moving = [name for name in SEARCHED if not (
        name == "gamma" and season == "none" or name in ("beta", "phi") and not own["trended"].any())]
    step, best, alive = np.full(len(y), FIRST_STEP), score.copy(), np.arange(len(y))
    while len(alive):
        trial = {name: np.repeat(own[name][alive][:, None], 2 * len(moving), 1) for name in (*SEARCHED, "trended")}
        for i, name in enumerate(moving):
            low, high = RANGES[name]
            free = own["phi"][alive] < 1 if name == "phi" else own["trended"][alive] > 0 if name == "beta" else True
            size = step[alive] * (high - low) * free
            trial[name][:, 2 * i] = np.clip(trial[name][:, 2 * i] + size, low, np.where(size > 0, high, np.inf))
            trial[name][:, 2 * i + 1] = np.clip(trial[name][:, 2 * i + 1] - size, np.where(size > 0, low, 0), np.inf)
        *_, sse, logs = _recursion(y[alive], n[alive], trial, season, m, kind, relative)
        got = _score(sse, logs, n[alive][:, None], own["k"][alive][:, None])
        pick = got.argmin(1)
        least = got[np.arange(len(alive)), pick]
        gain = best[alive] - least
        better = gain > LEAST_GAIN * np.maximum(np.abs(best[alive]), 1.0)
        rows = alive[better]
        for name in SEARCHED:
            own[name][rows] = trial[name][better, pick[better]]
        best[rows] = least[better]
        step[alive[~better]] /= 2
        alive = alive[step[alive] >= LAST_STEP]
    return own, best


def _solve_chunk(y, n, steps, seasons, trends, kind, relative, m, params):
    """Best candidate of every series, its fitted values, forecasts and last state."""
    names = ("alpha", "beta", "gamma", "phi", "trended")
    best = {"aicc": np.full(len(y), np.inf), "season": np.full(len(y), "none", dtype=object)}
    for k in names:
        best[k] = np.ones(len(y)) if k == "phi" else np.zeros(len(y))
    found = []  # of each season and form: series, score, parameters
    for season in seasons:
        grid = _grid(trends, season, params)
        usable = n >= (2 * m if season != "none" else 2)
        if season == "multiplicative":
            usable &= np.array([row[:size].min(initial=np.inf) > 0 for row, size in zip(y, n)])
        if not usable.any():
            continue
        where, size = np.flatnonzero(usable), n[usable]
        *_, sse, logs = _recursion(y[usable], size, grid, season, m, kind, relative)
        k = grid["k"] + (m if season != "none" else 0)
        score = _score(sse, logs, size[:, None], k)
        if season != "none" and not params["auto_ets"]:
            score = score * 0 - 1e300  # a season asked for is used wherever the series is long enough
        form = grid["trended"][0] * 2 + (grid["phi"][0] < 1)
        for f in np.unique(form):
            columns = np.flatnonzero(form == f)
            pick = columns[score[:, columns].argmin(1)]
            own = {name: grid[name][0][pick] for name in names} | {"k": k[0][pick]}
            found.append((season, where, score[np.arange(len(size)), pick], own))
    if params["auto_ets"] and "alphas" not in params and found:
        table = np.full((len(y), len(found)), np.inf)
        for c, (_, where, score, _) in enumerate(found):
            table[where, c] = score
        last = np.sort(table, axis=1)[:, min(FINALISTS, len(found)) - 1]
        for c, (season, where, score, own) in enumerate(found):
            some = np.flatnonzero((score <= last[where]) & (score < 1e300))
            if len(some):
                moved, least = _refine(y[where[some]], n[where[some]], {k: v[some] for k, v in own.items()}, score[some],
                                       season, m, kind, relative)
                score[some] = least
                for name in names:
                    own[name][some] = moved[name]
    for season, where, score, own in found:
        better = score < best["aicc"][where]
        rows = where[better]
        best["aicc"][rows], best["season"][rows] = score[better], season
        for name in names:
            best[name][rows] = own[name][better]
    values, state = [None] * len(y), [(np.nan, np.nan, [])] * len(y)
    for season in seasons:
        mine = np.flatnonzero((best["season"] == season) & np.isfinite(best["aicc"]))
        if not len(mine):
            continue
        own = {k: best[k][mine][:, None] for k in names}
        inside = np.zeros((len(mine), y.shape[1]))
        level, slope, slots, _, _ = _recursion(y[mine], n[mine], own, season, m, kind, relative, inside)
        for j, i in enumerate(mine):
            now = slots[:, j, 0] if season != "none" else slots
            ahead = _ahead(level[j, 0], slope[j, 0], now, best["phi"][i], n[i], steps[i], season, m, kind)
            values[i] = np.concatenate([inside[j, :n[i]], ahead])
            state[i] = level[j, 0], slope[j, 0], now if season != "none" else []
    return pd.DataFrame({
        "season": best["season"], "trended": best["trended"] > 0, "damped": best["phi"] < 1, "alpha": best["alpha"],
        "beta": best["beta"], "gamma": best["gamma"], "phi": best["phi"],
        "aicc": np.where(np.isfinite(best["aicc"]), best["aicc"], np.nan),
        "values": values, "level": [x[0] for x in state], "slope": [x[1] for x in state], "slots": [x[2] for x in state]})


def ets_table(arrays: DataFrame, period: int, params: dict, column: str = "ys") -> DataFrame:
    """Adds ``best``: chosen form and parameters of each (id, run), with fitted values followed by forecasts."""
    seasons, trends, kind, relative = _ets_forms(period, params)
    width = max(_grid(trends, s, params)["alpha"].shape[1] for s in seasons)

    @F.pandas_udf(ETS_SCHEMA)
    def solve(ys: pd.Series, steps: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(v) for v in ys])
        order = np.argsort(sizes, kind="stable")  # series of like length share a chunk, little padding
        chunk = max(1, BATCH_CELLS // (width * max(1, period // 4)))  # one slot per phase and cell
        parts = []
        for at in range(0, len(order), chunk):
            rows = order[at:at + chunk]
            n = sizes[rows]
            y = np.zeros((len(rows), max(int(n.max()), 2 * period, 2)))
            for j, i in enumerate(rows):
                y[j, :n[j]] = np.nan_to_num(np.asarray(ys.iloc[i], dtype=float))
            part = _solve_chunk(y[:, :max(int(n.max()), 1)] if period <= 1 else y, n, steps.to_numpy()[rows],
                                seasons, trends, kind, relative, max(period, 1), params)
            part.index = rows
            parts.append(part)
        return pd.concat(parts).sort_index()

    # marked so that the plan neither repeats the call nor moves it into a generator
    return arrays.withColumn("best", solve.asNondeterministic()(column, "n_ahead"))


def ets(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    table = ets_table(as_arrays(frame), ctx.period, params)
    return explode_arrays(table, "ETS", F.col("best.values"))


def ets_parameters(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Chosen form and parameters per (id, run)."""
    table = ets_table(as_arrays(frame), ctx.period, params)
    return table.select(*RUN_KEYS, "best.season", "best.trended", "best.damped", "best.alpha", "best.beta",
                        "best.gamma", "best.aicc")


def _phase_season(frame: DataFrame, period: int, out: str, value: str = "y", ratio: Column | None = None) -> DataFrame:
    """Season of each phase from the fitted rows (mean deviation from a centred moving mean), for all rows."""
    half = max(1, period // 2)
    phase = F.pmod(F.col("t") - 1, F.lit(period))
    trend = F.avg(value).over(by_date(*RUN_KEYS).rowsBetween(-half, half))
    df = frame.withColumn("_phase", phase).withColumn("_trend", trend)
    if ratio is None:
        deviation = F.col(value) - F.col("_trend")
    else:
        deviation = F.when(ratio, F.col(value) / F.nullif("_trend", _d(0))).otherwise(F.col(value) - F.col("_trend"))
    df = df.withColumn("_raw", F.avg(F.when(~F.col("ahead"), deviation)).over(whole(*RUN_KEYS, "_phase")))
    centre = F.avg("_raw").over(whole(*RUN_KEYS))
    season = F.col("_raw") - centre
    if ratio is not None:
        season = F.when(ratio, F.col("_raw") / F.nullif(centre, _d(0))).otherwise(season)
    return df.withColumn(out, F.coalesce(season, _d(0))).drop("_phase", "_trend", "_raw")


def theta_fit(frame: DataFrame, ctx: Context) -> DataFrame:
    """One row per (id, run): its rows with their season, whether it is used, the smoothed level and the slope."""
    m = ctx.period
    df = frame.withColumn("_ratio", F.min("y").over(whole(*RUN_KEYS)) > 0)
    if m > 1:
        df = _phase_season(df, m, "season", "y", F.col("_ratio"))
    else:
        df = df.withColumn("season", _d(0))
    arrays = as_arrays(df, ["season", "_ratio"])
    ys, n = F.col("ys"), F.col("n")
    if m > 1:
        mean = F.aggregate(ys, _d(0), lambda s, y: s + y) / n
        centred = let(mean, lambda mu: F.transform(ys, lambda y: y - mu))
        arrays = arrays.withColumn("_c", centred)
        product = lambda k: F.aggregate(F.zip_with(
            F.slice("_c", F.lit(1), F.greatest(n - k, F.lit(0))), F.slice("_c", k + 1, F.greatest(n - k, F.lit(0))),
            lambda a, b: a * b), _d(0), lambda s, x: s + F.coalesce(x, _d(0)))
        c0 = F.aggregate("_c", _d(0), lambda s, x: s + x * x)
        arrays = arrays.withColumn("_r", F.when(n >= 2 * m, let(c0, lambda c: F.transform(
            F.sequence(F.lit(1), F.lit(m)), lambda k: F.coalesce(F.try_divide(product(k), c), _d(0))))))
        noise = F.aggregate(F.slice("_r", 1, m - 1), _d(0), lambda s, r: s + 2 * r * r)
        seasonal = F.coalesce(F.abs(F.element_at("_r", m)) > 1.645 * F.sqrt((1 + noise) / n), F.lit(False))
        arrays = arrays.withColumn("_seasonal", seasonal)
    else:
        arrays = arrays.withColumn("_seasonal", F.lit(False))
    ratio = F.element_at("rows", 1)["_ratio"]
    seasons = F.transform("rows", lambda r: r["season"])
    adjusted = F.when(F.col("_seasonal"), F.zip_with(ys, F.slice(seasons, F.lit(1), n), lambda y, s: F.when(
        ratio, y / F.nullif(s, _d(0))).otherwise(y - s))).otherwise(ys)
    arrays = arrays.withColumn("z", adjusted).where(n >= 2)
    level = {"auto_ets": True, "alphas": tuple(a / 20 for a in range(1, 20))}
    arrays = ets_table(arrays, 0, {**level, "level_only": True}, "z")
    middle = (n + 1) / 2
    top = F.aggregate(F.transform("z", lambda y, i: y * (i + 1 - middle)), _d(0), lambda s, x: s + x)
    arrays = arrays.withColumn("_slope", top * 12 / (n * (F.pow(n, 2) - 1)))
    return arrays


def theta(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Half the trend of the series plus its exponentially smoothed level, on seasonally adjusted values."""
    arrays, n = theta_fit(frame, ctx), F.col("n")
    ratio = F.element_at("rows", 1)["_ratio"]
    seasons = F.transform("rows", lambda r: r["season"])
    half = F.col("_slope") / 2
    smoothed = F.col("best.values")
    inside = F.transform(F.slice(smoothed, F.lit(1), n), lambda v: v + half)
    ahead = F.transform(F.slice(smoothed, n + 1, F.col("n_ahead")), lambda v, i: v + half * (
        i + 1 / F.col("best.alpha")))
    line = F.concat(inside, ahead)
    values = F.when(F.col("_seasonal"), F.zip_with(line, seasons, lambda v, s: F.when(ratio, v * s).otherwise(
        v + s))).otherwise(line)
    return explode_arrays(arrays, "Theta", values)


def decompose_then(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Take out up to three seasons, forecast the rest by ETS or ARIMA, and put the seasons back."""
    from seriesloom.constants import default_params
    from seriesloom.operators.models.arima import sarima

    if params["auto_stlm"]:
        lengths = [ctx.period]
    else:
        lengths = [int(params[f"stlm_seasonal_period_{i}"]) for i in (1, 2, 3)]
    df = frame.withColumn("offset", _d(0))
    for m in [m for m in lengths if m > 1]:
        df = _phase_season(df, m, "_s").withColumn("y", F.col("y") - F.col("_s")).withColumn(
            "offset", F.col("offset") + F.col("_s")).drop("_s")
    if params["trend_model"] == "ARIMA":
        out = sarima(df, Context(1), default_params("SARIMA"), extra=["offset"])
        return out.withColumn("model_desc", F.lit("STLM")).withColumn(
            "prediction", F.col("prediction") + F.col("offset")).drop("offset")
    table = ets_table(as_arrays(df, ["offset"]), 1, default_params("ETS"))
    values = F.zip_with(F.col("best.values"), F.transform("rows", lambda r: r["offset"]), lambda v, s: v + s)
    return explode_arrays(table, "STLM", values)
