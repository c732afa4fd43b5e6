"""Forecasting workflow: fit, calibrate, combine, refit and forecast, for all series and methods in one set of jobs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.accuracy import accuracy_table
from seriesloom.operators.ensemble import combine
from seriesloom.operators.frames import Context, fold_runs, model_frame, standard_runs
from seriesloom.operators.intervals import add_conformal
from seriesloom.operators.models.registry import fit_predict_all
from seriesloom.operators.reshape import keep_models
from seriesloom.operators.scenario import ensembles_only
from seriesloom.operators.stacking import stack
from seriesloom.session import materialise


WINDOW_ONLY = {"Naive", "Seasonal Naive", "Rolling Average"}


@dataclass
class Forecast:
    """Lazy tables of one forecasting run."""

    data: DataFrame
    models: DataFrame
    predictions: DataFrame
    calibration: DataFrame
    residuals: DataFrame
    accuracy: DataFrame
    test_forecast: DataFrame
    oos_forecast: DataFrame


def model_table(ids: DataFrame, labels: list[str]) -> DataFrame:
    """Candidate models of every id with running numbers."""
    rows = F.array(*[F.struct(F.lit(i).alias("model_id"), F.lit(m).alias("model_desc"))
                     for i, m in enumerate(labels, 1)])
    return ids.select("id", F.inline(rows))


def merge_models(*tables: DataFrame) -> DataFrame:
    """Append model tables and number the models of each id anew (a few labels per id)."""
    numbered = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b), numbered)
    order = F.row_number().over(Window.partitionBy("id").orderBy("_table", "model_id"))
    return both.select("id", order.alias("model_id"), "model_desc")


def model_ids(labels: list[str]):
    """Label to id as a column: labels are few and known."""
    out = F.lit(None).cast("int")
    for i, m in enumerate(labels, 1):
        out = F.when(F.col("model_desc") == m, i).otherwise(out)
    return out


def calibration_of(preds: DataFrame) -> DataFrame:
    """Test rows with actual, prediction and residual."""
    rows = preds.where((F.col("run") == "test") & F.col("ahead"))
    return rows.select("id", "model_desc", "date", "actual", "prediction",
                       (F.col("actual") - F.col("prediction")).alias("residual"))


def residuals_of(preds: DataFrame) -> DataFrame:
    """Residuals of the training and the test rows, told apart by split."""
    rows = preds.where(F.col("run") == "test")
    return rows.select("id", "model_desc", "date", F.when(F.col("ahead"), "test").otherwise("train").alias("split"),
                       "actual", "prediction", (F.col("actual") - F.col("prediction")).alias("residual"))


def accuracy_of(preds: DataFrame, **options) -> DataFrame:
    rows = preds.where(F.col("run") == "test").withColumn("type", F.when(F.col("ahead"), "Test").otherwise("Train"))
    return accuracy_table(rows, ["id", "model_desc", "type"], **options)


def actual_rows(panel: DataFrame) -> DataFrame:
    known = panel.where(F.col("value").isNotNull())
    return known.select("id", F.lit("ACTUAL").alias("model_desc"), F.lit("actual").alias("key"), "date", "value")


def forecast(
    panel: DataFrame,
    methods: list[str],
    ctx: Context,
    n_assess: int,
    n_future: int,
    levels: list[float] = (0.9,),
    params: dict | None = None,
    ensembles: list[str] = (),
    stacking: list[str] = (),
    n_folds: int = 5,
    stage: bool | None = None,
    tuned: DataFrame | None = None,
) -> Forecast:
    """Run all methods on the hold-out test and on the future (and on folds when stacking).

    ``panel`` carries its future rows (``is_future``). With ``stage`` the predictions are written to the shared folder
    at once, and all tables of the result read them from there; without it every table fits the models anew. The
    default stages them unless all methods are plain windows. ``tuned`` (id, method, params) holds parameters of single
    ids, as ``tune`` finds them: its methods are fitted with them.
    """
    runs = standard_runs(n_assess, n_future) + (fold_runs(n_assess, n_folds) if stacking else [])
    frame = model_frame(panel, runs)
    chosen = set() if tuned is None else {r["method"] for r in tuned.select("method").distinct().collect()}
    plain = [m for m in methods if m not in chosen]
    parts = [fit_predict_all(frame, plain, ctx, params)] if plain else []
    if chosen:
        from seriesloom.plans.tuning import predict_tuned

        parts += [predict_tuned(frame, m, ctx, tuned, (params or {}).get(m)) for m in methods if m in chosen]
    preds = reduce(lambda a, b: a.unionByName(b), parts)
    if stage or (stage is None and not set(methods) <= WINDOW_ONLY):
        preds = materialise(preds)
    labels = list(methods)
    parts = preds.where(~F.col("run").startswith("fold"))
    members = parts
    if ensembles:
        parts = parts.unionByName(combine(members, ensembles))
        labels += [f"Ens - {e}" for e in ensembles]
    if stacking:
        parts = parts.unionByName(stack(preds, list(methods), stacking))
        labels += [f"Stk - {s}" for s in stacking]
    calibration = calibration_of(parts)
    data = panel.where(~F.col("is_future"))

    def table(run):
        rows = add_conformal(parts, run, list(levels)).withColumn("model_id", model_ids(labels))
        return rows.unionByName(actual_rows(data), allowMissingColumns=True)

    return Forecast(
        data, model_table(data.select("id").distinct(), labels), parts, calibration, residuals_of(parts), accuracy_of(parts),
        table("test"), table("future"))


def only_combinations(result: Forecast) -> Forecast:
    """The same tables restricted to ensembles and stacks (actual rows stay)."""
    return Forecast(
        result.data, keep_models(result.models, "^(Ens|Stk) - "), ensembles_only(result.predictions),
        ensembles_only(result.calibration), ensembles_only(result.residuals), ensembles_only(result.accuracy),
        ensembles_only(result.test_forecast, True), ensembles_only(result.oos_forecast, True))


def back_transform(result: Forecast, params: DataFrame, steps: list[str]) -> Forecast:
    """All tables on the original scale; residuals and accuracy are taken again from the restored values."""
    from seriesloom.operators.transform import history_levels, invert_ahead, invert_panel, invert_predictions, invert_values

    keys, bounds = ["id", "model_desc", "conf_lvl", "key"], ["value", "conf_lo", "conf_hi"]
    levels = history_levels(result.data, params, steps)

    def table(df):
        ahead = invert_ahead(df.where("key = 'prediction'"), levels, bounds, keys)
        ahead = invert_values(ahead, params, steps, bounds)
        known = df.where("key = 'actual'")
        back = invert_panel(known.select("id", "date", "value"), params, steps)
        return ahead.unionByName(
            back.select("id", F.lit("ACTUAL").alias("model_desc"), F.lit("actual").alias("key"), "date", "value"),
            allowMissingColumns=True)

    parts = invert_predictions(result.predictions, result.data, params, steps)
    return Forecast(
        invert_panel(result.data.select("id", "date", "value"), params, steps), result.models, parts,
        calibration_of(parts), residuals_of(parts), accuracy_of(parts), table(result.test_forecast),
        table(result.oos_forecast))
