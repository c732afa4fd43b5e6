"""Choosing parameters: grids, cross-validated scores, leaderboards, and the table of tuned parameters."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.constants import METHOD_DEFAULTS, SEED, default_params
from seriesloom.operators.accuracy import accuracy_table
from seriesloom.operators.frames import Context, fold_runs, model_frame, random_fold_frame
from seriesloom.operators.models.neighbours import knn_path
from seriesloom.operators.models.registry import context_for, fit_predict
from seriesloom.operators.models.regression import net_path
from seriesloom.session import materialise

# Ranges searched per parameter: (low, high, whole numbers, logarithmic).
RANGES = {
    "penalty": (1e-4, 10.0, False, True),
    "mixture": (0.0, 1.0, False, False),
    "neighbors": (1, 15, True, False),
    "num_terms": (3, 30, True, False),
    "prod_degree": (1, 2, True, False),
    "cost": (0.05, 30.0, False, True),
    "margin": (0.0, 0.2, False, False),
    "rf_mtry": (1, 10, True, False),
    "rf_trees": (20, 1000, True, False),
    "rf_min_n": (2, 40, True, False),
    "boost_learn_rate": (0.01, 0.4, False, True),
    "arima_boost_learn_rate": (0.01, 0.4, False, True),
    "prophet_boost_learn_rate": (0.01, 0.4, False, True),
    "committees": (1, 5, True, False),
    "cub_neighbors": (0, 9, True, False),
    "rbf_sigma": (1e-3, 1.0, False, True),
    "window_size": (2, 24, True, False),
    "smooth_level": (0.05, 0.95, False, False),
    "smooth_trend": (0.0, 0.5, False, False),
    "smooth_season": (0.0, 0.5, False, False),
    "changepoint_num": (1, 50, True, False),
    "changepoint_range": (0.6, 0.9, False, False),
    "prior_scale_changepoints": (1e-3, 100.0, False, True),
    "prior_scale_seasonality": (1e-3, 100.0, False, True),
    "prior_scale_holidays": (1e-3, 100.0, False, True),
    "ffar_non_seasonal_ar": (1, 5, True, False),
    "ffar_num_networks": (1, 50, True, False),
    **{f"{model}_{name}": span for model in ("boost", "arima_boost", "prophet_boost") for name, span in {
        "mtry": (1, 10, True, False), "trees": (20, 1000, True, False), "min_n": (1, 40, True, False),
        "tree_depth": (1, 15, True, False), "loss_reduction": (1e-10, 30.0, False, True),
        "sample_size": (0.1, 1.0, False, False)}.items()},
    "max_rules": (2, 32, True, False),
    "ff_hidden_units": (2, 20, True, False),
    "ff_penalty": (1e-4, 10.0, False, True),
    "ffar_seasonal_ar": (0, 2, True, False),
    "ffar_hidden_units": (2, 10, True, False),
    "ffar_penalty": (1e-4, 10.0, False, True),
}

# Parameters tuned when nothing else is asked for.
TUNED_BY_DEFAULT = {
    "Elastic Net": ["penalty", "mixture"],
    "MARS": ["num_terms", "prod_degree"],
    "KNN": ["neighbors"],
    "SVM": ["cost", "margin"],
    "Random Forest": ["rf_mtry", "rf_trees", "rf_min_n"],
    "Boosted Trees": ["boost_learn_rate"],
    "Cubist": ["committees", "max_rules"],
    "Feed-Forward": ["ff_hidden_units", "ff_penalty"],
    "Feed-Forward AR": ["ffar_seasonal_ar", "ffar_hidden_units", "ffar_penalty"],
    "ARIMA-Boost": ["arima_boost_learn_rate"],
    "Prophet-Boost": ["prophet_boost_learn_rate"],
}


def tune_setup(ids: DataFrame, method: str, chosen: list[str] | None = None) -> DataFrame:
    """Per id one row per parameter of a method: default value and whether it varies."""
    chosen = TUNED_BY_DEFAULT[method] if chosen is None else chosen
    unknown = set(chosen) - set(METHOD_DEFAULTS[method])
    if unknown:
        raise ValueError(f"{method} has no parameters {sorted(unknown)}")
    rows = F.array(*[
        F.struct(F.lit(method).alias("method"), F.lit(k).alias("parameter"), F.lit(str(v)).alias("default"),
                 F.lit(k in chosen).alias("tune"))
        for k, v in METHOD_DEFAULTS[method].items()])
    return ids.select("id", F.inline(rows))


def space_filling(names: list[str], size: int, seed: int = SEED, around: dict | None = None,
                  shrink: float = 0.25) -> list[dict]:
    """Latin hypercube: every parameter takes one value from each of ``size`` equal slices of its range.

    With ``around`` the ranges shrink to a neighbourhood of that point (a finer second round).
    """
    unknown = [n for n in names if n not in RANGES]
    if unknown:
        raise ValueError(f"no range to search for {unknown}; parameters that can vary: {sorted(RANGES)}")
    rng = random.Random(seed)
    columns = {}
    for name in names:
        low, high, whole, logarithmic = RANGES[name]
        a, b = (math.log(low), math.log(high)) if logarithmic else (float(low), float(high))
        if around is not None:
            centre = math.log(around[name]) if logarithmic else float(around[name])
            reach = (b - a) * shrink / 2
            a, b = max(a, centre - reach), min(b, centre + reach)
        slices = list(range(size))
        rng.shuffle(slices)
        values = [a + (b - a) * (s + rng.random()) / size for s in slices]
        values = [math.exp(v) if logarithmic else v for v in values]
        columns[name] = [int(round(v)) if whole else v for v in values]
    return [{n: columns[n][i] for n in names} for i in range(size)]


def grid_table(ids: DataFrame, grid: list[dict]) -> DataFrame:
    """Grid as a table (id, choice, parameter, value)."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("choice"), F.lit(k).alias("parameter"), F.lit(float(v)).alias("value"))
        for i, point in enumerate(grid) for k, v in point.items()])
    return ids.select("id", F.inline(rows))


def staged(frame: DataFrame) -> DataFrame:
    """The frame from the shared folder, where several passes read it; keeps the note of its runs."""
    runs = frame.schema["run"].metadata
    return materialise(frame).withMetadata("run", runs)


def candidate_predictions(frame: DataFrame, method: str, ctx: Context, grid: list[dict]) -> DataFrame:
    """Predictions of every grid point on every run, marked by ``choice``.

    The elastic net and the neighbours evaluate the whole grid in one pass; other methods run once per point.
    """
    full = [default_params(method, p) for p in grid]
    ctx = context_for(method, ctx)
    if method == "Elastic Net":
        return net_path(frame, ctx, [(p["penalty"], p["mixture"]) for p in full])
    if method == "KNN":
        return knn_path(frame, ctx, [int(p["neighbors"]) for p in full])
    out = None
    for i, point in enumerate(grid):
        rows = fit_predict(frame, method, ctx, point).withColumn("choice", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def fold_scores(preds: DataFrame, metric: str = "rmse") -> DataFrame:
    """Mean error per id and grid point over the predicted rows of the folds."""
    by_fold = accuracy_table(preds.where(F.col("ahead")), ["id", "choice", "run"], [metric])
    return by_fold.groupBy("id", "choice").agg(F.avg(metric).alias("score"))


def best_choice(scores: DataFrame) -> DataFrame:
    """Grid point with the smallest error per id."""
    return scores.where(F.col("score").isNotNull()).groupBy("id").agg(
        F.min_by("choice", F.struct("score", "choice")).alias("choice"), F.min("score").alias("score"))


def fold_frame(panel: DataFrame, n_assess: int, n_folds: int, validation: str, rolling: bool) -> DataFrame:
    if validation == "TS CV":
        return model_frame(panel, fold_runs(n_assess, n_folds, rolling=rolling))
    if validation == "K-Fold CV":
        return random_fold_frame(panel, n_assess, n_folds)
    raise ValueError(f"unknown validation {validation!r}")


def point_maps(grid: list[dict]) -> Column:
    return F.array(*[F.create_map(*[v for k, x in p.items() for v in (F.lit(k), F.lit(float(x)))]) for p in grid])


def tune(panel: DataFrame, method: str, ctx: Context, n_assess: int, n_folds: int = 5, grid_size: int = 10,
         metric: str = "rmse", chosen: list[str] | None = None, second_round: bool = False,
         validation: str = "TS CV", rolling: bool = False) -> DataFrame:
    """Tuned parameters per id: (id, method, params map, score).

    Every grid point is scored on every fold of the training part: time slices (``TS CV``, expanding or rolling) or
    random folds (``K-Fold CV``). A second round looks around the point that is
    best on average (one row to the driver) and replaces a sequential search.
    """
    names = TUNED_BY_DEFAULT[method] if chosen is None else chosen
    frame = fold_frame(panel, n_assess, n_folds, validation, rolling)
    if second_round or method not in ("Elastic Net", "KNN"):
        frame = staged(frame)
    grid = space_filling(names, grid_size)
    scores = fold_scores(candidate_predictions(frame, method, ctx, grid), metric)
    if second_round:
        overall = scores.groupBy("choice").agg(F.avg("score").alias("score")).orderBy("score").first()
        grid = grid + space_filling(names, grid_size, SEED + 1, around=grid[overall["choice"]])
        scores = fold_scores(candidate_predictions(frame, method, ctx, grid), metric)
    return best_choice(scores).select("id", F.lit(method).alias("method"), F.element_at(
        point_maps(grid), F.col("choice") + 1).alias("params"), "score")


def surviving_predictions(frame: DataFrame, method: str, ctx: Context, grid: list[dict], left: DataFrame) -> DataFrame:
    """Predictions of the grid points that a series still has, given as rows (id, choice)."""
    names = frame.schema["run"].metadata
    kept = sorted(r["choice"] for r in left.select("choice").distinct().collect())  # at most the points of the grid
    if method in ("Elastic Net", "KNN"):  # one pass for all points
        part = frame.join(left.select("id").distinct(), "id", "left_semi").withMetadata("run", names)
        rows = candidate_predictions(part, method, ctx, [grid[i] for i in kept])
        rows = rows.withColumn("choice", F.array(*map(F.lit, kept))[F.col("choice")])
        return rows.join(left, ["id", "choice"], "left_semi")
    parts = []
    for i in kept:
        part = frame.join(left.where(F.col("choice") == i), "id", "left_semi").withMetadata("run", names)
        parts.append(candidate_predictions(part, method, ctx, [grid[i]]).withColumn("choice", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def tune_by_halving(panel: DataFrame, method: str, ctx: Context, n_assess: int, n_folds: int = 5, grid_size: int = 10,
                    metric: str = "rmse", chosen: list[str] | None = None, keep: float = 0.5,
                    validation: str = "TS CV", rolling: bool = False) -> DataFrame:
    """Tuned parameters per id by successive halving: (id, method, params, score, folds, fits).

    Every fold is a rung. After a rung each series keeps the share ``keep`` of its points, rounded up, with the least mean
    error over the folds so far (points without an error last, ties to the earlier point). A series with one point left is
    done: it is not fitted in the rungs that follow. So a series takes ``fits`` fits instead of grid_size * n_folds; its score is
    the mean over the ``folds`` that it saw. Series without any error have no row; an empty panel gives an empty result.
    """
    if not 0 < keep < 1:
        raise ValueError("keep is a share between 0 and 1")
    grid = space_filling(TUNED_BY_DEFAULT[method] if chosen is None else chosen, grid_size)
    frame = staged(fold_frame(panel, n_assess, n_folds, validation, rolling))
    everything = F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("choice")
    left = materialise(frame.select("id").distinct().select("id", everything))
    seen = means = None
    for run in frame.schema["run"].metadata["runs"]:
        of_id = Window.partitionBy("id")  # as many rows as points
        going = left.withColumn("_n", F.count(F.lit(1)).over(of_id)).where("_n > 1").select("id", "choice")
        if going.isEmpty():
            break
        part = frame.where(F.col("run") == run).withMetadata("run", {"runs": [run]})
        rows = surviving_predictions(part, method, ctx, grid, going)
        errors = accuracy_table(rows.where(F.col("ahead")), ["id", "choice", "run"], [metric]) \
            .select("id", "choice", "run", F.col(metric).alias("error"))
        seen = materialise(errors if seen is None else seen.unionByName(errors))
        means = seen.groupBy("id", "choice").agg(F.avg("error").alias("score"), F.count("error").alias("folds"))
        place = F.row_number().over(of_id.orderBy(F.col("score").asc_nulls_last(), "choice"))
        ranked = left.join(means, ["id", "choice"], "left").withColumns(
            {"_place": place, "_n": F.count(F.lit(1)).over(of_id)})
        left = materialise(ranked.where(F.col("_place") <= F.ceil(F.col("_n") * keep)).select("id", "choice"))
    if seen is None:  # no series, or one point only
        return tune(panel, method, ctx, n_assess, n_folds, grid_size, metric, chosen, False, validation, rolling) \
            .withColumns({"folds": F.lit(n_folds).cast("long"), "fits": F.lit(n_folds).cast("long")})
    fits = seen.groupBy("id").agg(F.count(F.lit(1)).alias("fits"))
    best = left.join(means, ["id", "choice"]).where(F.col("score").isNotNull()).groupBy("id").agg(
        F.min_by(F.struct("choice", "score", "folds"), F.struct("score", "choice")).alias("b"))
    return best.join(fits, "id").select(
        "id", F.lit(method).alias("method"), F.element_at(point_maps(grid), F.col("b.choice") + 1).alias("params"),
        F.col("b.score").alias("score"), F.col("b.folds").alias("folds"), "fits")


def predict_tuned(frame: DataFrame, method: str, ctx: Context, tuned: DataFrame, params: dict | None = None) -> DataFrame:
    """Predictions with the tuned parameters of every id; ids that are not tuned use ``params``.

    Tuned points are those of one grid, a few; each is fitted on the ids that chose it, so every series is fitted once.
    """
    own = tuned.where(F.col("method") == method).select("id", F.array_sort(F.map_entries("params")).alias("_point"))
    points = [r["_point"] for r in own.select("_point").distinct().collect()]
    parts = [fit_predict(frame.join(own, "id", "left_anti"), method, ctx, params)]
    for point in points:
        given = {e["key"]: int(e["value"]) if RANGES[e["key"]][2] else e["value"] for e in point}
        same = F.array(*[F.struct(F.lit(e["key"]).alias("key"), F.lit(e["value"]).alias("value")) for e in point])
        ids = own.where(F.col("_point") == same)
        parts.append(fit_predict(frame.join(ids, "id", "left_semi"), method, ctx, {**(params or {}), **given}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_tuned(wanted: DataFrame, tuned: DataFrame, defaults: dict[str, dict]) -> DataFrame:
    """Parameters per (id, method): defaults overridden by tuned values where they exist."""
    def literal(values):
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])

    base = F.create_map(*[x for m, p in defaults.items() for x in (F.lit(m), literal(p))])[F.col("method")]
    joined = wanted.join(tuned.select("id", "method", F.col("params").alias("_tuned")), ["id", "method"], "left")
    none = F.create_map().cast("map<string,double>")
    merged = F.map_zip_with(base, F.coalesce(F.col("_tuned"), none), lambda k, a, b: F.coalesce(b, a))
    return joined.withColumn("params", merged).drop("_tuned")


def leaderboard(panel: DataFrame, ctx: Context, n_assess: int, n_folds: int = 5, metric: str = "rmse",
                candidates: list[tuple[str, dict]] | None = None) -> DataFrame:
    """Candidates (method, parameters) ranked per id by their mean error over the folds; the number of candidates is
    the search budget."""
    if candidates is None:
        candidates = [("Elastic Net", p) for p in space_filling(["penalty", "mixture"], 4)]
        candidates += [("KNN", p) for p in space_filling(["neighbors"], 3)]
        candidates += [("Linear Regression", {}), ("MARS", {"num_terms": 8}), ("Feed-Forward", {})]
    frame = staged(model_frame(panel, fold_runs(n_assess, n_folds)))
    by_method: dict[str, list[dict]] = {}
    for method, p in candidates:
        by_method.setdefault(method, []).append(p)
    scores = None
    for method, grid in by_method.items():
        part = fold_scores(candidate_predictions(frame, method, ctx, grid), metric).withColumn(
            "method", F.lit(method))
        scores = part if scores is None else scores.unionByName(part)
    place = F.rank().over(Window.partitionBy("id").orderBy("score"))
    return scores.where(F.col("score").isNotNull()).select(
        "id", "method", "choice", "score", place.alias("place"))


