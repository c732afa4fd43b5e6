"""Model frames: the same panel seen by several runs (hold-out test, cross-validation slices, the future).

A run fits on all rows but the last ``cut`` and predicts the ``length`` rows after them. Every model works on the key
(id, run), so calibration, folds and the final refit are one job, and partitioning by id serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.constants import SEED
from seriesloom.operators.panel import by_date, random_folds, spread, whole

RUN_KEYS = ["id", "run"]
BASE = ["id", "run", "date", "t", "h", "ahead", "actual"]


@dataclass(frozen=True)
class Run:
    name: str
    cut: int
    length: int
    skip: int = 0  # rows left out at the start, for training windows of fixed length


@dataclass(frozen=True)
class Context:
    """What a model needs to know besides its frame: season length and names of the feature columns."""

    period: int
    features: tuple[str, ...] = ()


def standard_runs(n_assess: int, n_future: int) -> list[Run]:
    return [Run("test", n_assess, n_assess), Run("future", 0, n_future)]


def fold_runs(n_assess: int, n_folds: int, inside: bool = True, rolling: bool = False) -> list[Run]:
    """Time slices of n_assess // n_folds rows; ``inside`` keeps them in front of the hold-out rows.

    Training rows are all earlier ones, or with ``rolling`` a window of the training length less n_assess.
    """
    step = max(1, n_assess // n_folds)
    base = n_assess if inside else 0
    cuts = [base + k * step for k in range(1, n_folds + 1)]
    return [Run(f"fold{k}", cut, step, max(0, base + n_assess - cut) if rolling else 0)
            for k, cut in enumerate(cuts, 1)]


def random_fold_frame(panel: DataFrame, n_assess: int, n_folds: int, seed: int = SEED) -> DataFrame:
    """K-fold frame of the rows before the hold-out: each run predicts the rows of one fold from those of the others.

    For methods that regress on features; a method that steps through time needs time slices.
    """
    if "is_future" in panel.columns:
        panel = panel.where(~F.col("is_future")).drop("is_future")
    rows = random_folds(panel, n_folds, seed).withColumn("t", F.row_number().over(by_date()))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole())).where(F.col("t") <= F.col("_n") - n_assess)
    names = [f"fold{k}" for k in range(1, n_folds + 1)]
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    ahead = F.col("fold") == F.col("_k")
    extra = [c for c in panel.columns if c not in ("id", "date", "value")]
    return rows.select(
        "id", F.concat(F.lit("fold"), F.col("_k")).alias("run", metadata={"runs": names}), "date",
        F.col("t").cast("int").alias("t"), ahead.cast("int").alias("h"), ahead.alias("ahead"),
        F.col("value").alias("actual"), F.when(~ahead, F.col("value")).alias("y"), *extra)


def model_frame(panel: DataFrame, runs: list[Run]) -> DataFrame:
    """Repeat the rows once per run. Needs id, date, value and (with future rows) is_future.

    Adds run, t (position), h (steps after the last fitted row), ahead, actual and y (value of fitted rows only).
    """
    if "is_future" not in panel.columns:
        panel = spread(panel).withColumn("is_future", F.lit(False))
    base = panel.withColumn("t", F.row_number().over(by_date())).withColumn(
        "_n", F.count(F.when(~F.col("is_future"), 1)).over(whole()))
    specs = F.array(*[
        F.struct(F.lit(r.name).alias("name"), F.lit(r.cut).alias("cut"), F.lit(r.length).alias("length"),
                 F.lit(r.skip).alias("skip"))
        for r in runs])
    rows = base.withColumn("_r", F.explode(F.filter(
        specs, lambda r: (F.col("t") <= F.col("_n") - r["cut"] + r["length"]) & (F.col("t") > r["skip"]))))
    h = F.col("t") - F.col("_n") + F.col("_r.cut")
    extra = [c for c in panel.columns if c not in ("id", "date", "value", "is_future")]
    return rows.select(
        "id", F.col("_r.name").alias("run", metadata={"runs": [r.name for r in runs]}), "date", F.col("t").cast("int").alias("t"),
        F.greatest(h, F.lit(0)).cast("int").alias("h"), (h > 0).alias("ahead"),
        F.when(~F.col("is_future"), F.col("value")).alias("actual"),
        F.when(h <= 0, F.col("value")).alias("y"), *extra)


def predictions(df: DataFrame, method: str, prediction: Column) -> DataFrame:
    """Common result shape of all models."""
    return df.select(*BASE, F.lit(method).alias("model_desc"), prediction.cast("double").alias("prediction"))


def filled_y(frame: DataFrame) -> DataFrame:
    """Carry the last known y over missing rows of the fitted part (models that step through time need no holes)."""
    w = by_date(*RUN_KEYS)
    carried = F.coalesce(F.last("y", ignorenulls=True).over(w), F.first("y", ignorenulls=True).over(
        whole(*RUN_KEYS)))
    return frame.withColumn("y", F.when(~F.col("ahead"), carried))


def as_arrays(frame: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per (id, run): rows in date order as an array, the fitted values ys as an array.

    The arrays are as long as the series, which the calendar bounds; they never hold several series.
    """
    row = F.struct("t", "date", "h", "ahead", "actual", "y", *extra)
    grouped = filled_y(frame).groupBy(*RUN_KEYS).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    ys = F.transform(F.filter("rows", lambda r: ~r["ahead"]), lambda r: r["y"])
    return grouped.withColumn("ys", ys).withColumn("n", F.size("ys")).withColumn(
        "n_ahead", F.size("rows") - F.col("n"))


def steps_ahead(n: Column) -> Column:
    """Array 1..n, empty for n = 0."""
    return F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n)


def explode_arrays(df: DataFrame, method: str, values: Column) -> DataFrame:
    """Back to rows: ``values`` holds one prediction per entry of ``rows``, or is null where there are none."""
    # a step of its own: an expression inside a generator is not compiled, and its common parts are worked out again
    df = df.select(*RUN_KEYS, "rows", F.coalesce(values, F.array().cast("array<double>")).alias("_values"))
    zipped = F.arrays_zip(F.col("rows"), F.col("_values").alias("p"))
    out = df.select(*RUN_KEYS, F.explode(zipped).alias("z")).select(
        *RUN_KEYS, "z.rows.*", F.col("z.p").alias("_p"))
    return predictions(out, method, F.col("_p"))
