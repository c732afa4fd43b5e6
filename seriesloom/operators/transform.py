"""Fixed-order transforms per series, their parameters, and the way back.

Parameters are windows by id, so the forward chain needs no join; the way back joins one row per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.constants import TRANSFORMATIONS
from seriesloom.functions import transforms as X
from seriesloom.functions.text import let
from seriesloom.operators.panel import by_date, by_date_desc, whole

LAMBDA_GRID = [round(-1 + 0.05 * k, 2) for k in range(61)]


def ordered_steps(steps: list[str]) -> list[str]:
    """Known steps in their fixed order; unknown names raise an error."""
    unknown = set(steps) - set(TRANSFORMATIONS)
    if unknown:
        raise ValueError(f"unknown transformations {sorted(unknown)}")
    return [s for s in TRANSFORMATIONS if s in steps]


def guerrero_lambda(panel: DataFrame, period: int) -> DataFrame:
    """Box-Cox lambda per id: the grid value with the steadiest sd / mean^(1 - lambda) over blocks of one season."""
    size = max(2, period)
    back = F.row_number().over(by_date_desc()) - 1
    n = F.count(F.lit(1)).over(whole())
    blocks = panel.where(F.col("value").isNotNull()).select(
        "id", "value", F.floor(back / size).alias("block"), F.floor(n / size).alias("n_blocks"))
    stats = blocks.where(F.col("block") < F.col("n_blocks")).groupBy("id", "block").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    usable = F.when(F.col("m") > 0, F.struct("m", "s"))
    # one array of block statistics per id, n / period entries
    grouped = stats.groupBy("id").agg(F.collect_list(usable).alias("b"))
    grid = F.array(*[F.lit(v) for v in LAMBDA_GRID])

    def variation(lam: Column) -> Column:
        # running mean and sum of squares of the ratios in one fold
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("ss"))

        def update(a, p):
            return let(p["s"] / F.pow(p["m"], 1 - lam), lambda r: let(
                a["mean"] + (r - a["mean"]) / (a["n"] + 1.0), lambda mean: F.struct(
                    (a["n"] + 1.0).alias("n"), mean.alias("mean"),
                    (a["ss"] + (r - a["mean"]) * (r - mean)).alias("ss"))))

        return F.aggregate(F.col("b"), start, update, lambda a: F.try_divide(
            F.sqrt(F.try_divide(a["ss"], a["n"] - 1)), a["mean"]))

    scored = F.transform(grid, lambda lam: F.struct(F.round(variation(lam), 10).alias("cv"), lam.alias("lam")))
    best = F.array_min(F.filter(scored, lambda s: s["cv"].isNotNull()))["lam"]
    return grouped.select("id", F.coalesce(best, F.lit(1.0)).alias("lambda"))


def transform_panel(panel: DataFrame, steps: list[str], period: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply the steps in fixed order; returns the transformed panel and one row of parameters per id."""
    steps = ordered_steps(steps)
    x = F.col("value")
    df = panel
    kept: dict[str, Column] = {}

    def remember(name: str, col: Column) -> Column:
        nonlocal df
        df = df.withColumn(f"_{name}", col)
        kept[name] = F.first(f"_{name}")
        return F.col(f"_{name}")

    drop_rows = 0
    for step in steps:
        if step == "Multiply by -1":
            df = df.withColumn("value", -x)
        elif step == "Add 1":
            df = df.withColumn("value", x + 1)
        elif step == "Log":
            df = df.withColumn("value", X.log(x))
        elif step == "Box-Cox":
            lam = guerrero_lambda(df.select("id", "date", "value"), period or 1)
            df = df.join(lam.withColumnRenamed("lambda", "_lambda"), "id", "left")
            kept["lambda"] = F.first("_lambda")
            df = df.withColumn("value", X.box_cox(x, F.col("_lambda")))
        elif step == "Log-Interval":
            high = remember("li_high", 1.2 * F.max(x).over(whole()))
            df = df.withColumn("value", X.log_interval(x, F.lit(0.0), high))
        elif step == "Min-Max":
            low, high = remember("mm_low", F.min(x).over(whole())), remember("mm_high", F.max(x).over(whole()))
            df = df.withColumn("value", X.min_max(x, low, high))
        elif step == "Standardization":
            mean = remember("z_mean", F.avg(x).over(whole()))
            sd = remember("z_sd", F.stddev_samp(x).over(whole()))
            df = df.withColumn("value", X.standardise(x, mean, sd))
        else:
            lag = 1 if step == "Differencing" else (period or 1)
            name = "d" if step == "Differencing" else "sd"
            df = df.withColumn("_pos", F.row_number().over(by_date()) - drop_rows).withColumn(
                "_back", F.row_number().over(by_date_desc()))
            seed = F.struct(F.col("date").alias("date"), x.alias("value"))
            df = df.withColumn(f"_{name}_first", F.when(F.col("_pos").between(1, lag), seed)).withColumn(
                f"_{name}_last", F.when(F.col("_back") <= lag, seed))
            for side in ("first", "last"):
                kept[f"{name}_{side}"] = F.array_sort(F.collect_list(f"_{name}_{side}"))
            df = df.withColumn("value", x - F.lag(x, lag).over(by_date())).drop("_pos", "_back")
            drop_rows += lag
    params = df.groupBy("id").agg(F.lit(period or 1).alias("period"), *[c.alias(n) for n, c in kept.items()])
    out = df
    if drop_rows:
        out = out.withColumn("_pos", F.row_number().over(by_date())).where(F.col("_pos") > drop_rows)
    return out.select(*panel.columns), params


def params_long(params: DataFrame) -> DataFrame:
    """Parameters as (id, transform, params map)."""
    groups = {
        "Box-Cox": ["lambda"], "Log-Interval": ["li_high"], "Min-Max": ["mm_low", "mm_high"],
        "Standardization": ["z_mean", "z_sd"],
    }
    rows = [
        F.struct(F.lit(step).alias("transform"), F.lit(TRANSFORMATIONS.index(step) + 1).alias("step"),
                 F.create_map(*[y for n in names for y in (F.lit(n), F.col(n))]).alias("params"))
        for step, names in groups.items() if names[0] in params.columns
    ]
    return params.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*")


def invert_values(df: DataFrame, params: DataFrame, steps: list[str], columns: list[str]) -> DataFrame:
    """Undo all steps but the differences on the given columns; interval bounds swap under a change of sign."""
    steps = ordered_steps(steps)
    joined = df.join(params.select("id", *[F.col(c).alias(f"_p_{c}") for c in params.columns if c != "id"]),
                     "id", "left")
    p = {c: F.col(f"_p_{c}") for c in params.columns}
    undo = {
        "Multiply by -1": lambda c: -c,
        "Add 1": lambda c: c - 1,
        "Log": F.exp,
        "Box-Cox": lambda c: X.inverse_box_cox(c, p["lambda"]),
        "Log-Interval": lambda c: X.inverse_log_interval(c, F.lit(0.0), p["li_high"]),
        "Min-Max": lambda c: X.inverse_min_max(c, p["mm_low"], p["mm_high"]),
        "Standardization": lambda c: X.inverse_standardise(c, p["z_mean"], p["z_sd"]),
    }
    for step in reversed(steps):
        if step in undo:
            joined = joined.withColumns({c: undo[step](F.col(c)) for c in columns})
    if "Multiply by -1" in steps and {"conf_lo", "conf_hi"} <= set(columns):
        joined = joined.withColumns({"conf_lo": F.col("conf_hi"), "conf_hi": F.col("conf_lo")})
    return joined.select(*df.columns)


def seed_rows(params: DataFrame, name: str, side: str = "first") -> DataFrame:
    """Seed values of a difference step in the shape of forecast rows."""
    seeds = params.select("id", F.explode(f"{name}_{side}").alias("s"))
    return seeds.select(
        "id", F.lit(None).cast("int").alias("model_id"), F.lit("ACTUAL").alias("model_desc"),
        F.lit("actual").alias("key"), F.col("s.date").alias("date"), F.col("s.value").alias("value"),
        F.lit(None).cast("double").alias("conf_lo"), F.lit(None).cast("double").alias("conf_hi"),
        F.lit(None).cast("decimal(3,2)").alias("conf_lvl"))


def undo_difference(
    df: DataFrame, params: DataFrame, name: str, columns: list[str] = ("value",), keys: list[str] = ("id",),
    side: str = "first", seed_keys: list[str] = ("id",),
) -> DataFrame:
    """Running sums over date from the seed: 'first' for the history, 'last' for rows after the last observation.

    ``name`` is d (lag 1) or sd (one season); a seasonal difference is summed within each phase. ``params`` has one row
    for each value of ``seed_keys``.
    """
    lag = F.size(F.col("_seed"))
    seeded = df.join(params.select(*seed_keys, F.col(f"{name}_{side}").alias("_seed")), list(seed_keys), "left")
    seeded = seeded.withColumn("_i", F.row_number().over(by_date(*keys)) - 1)
    seeded = seeded.withColumn("_phase", F.pmod("_i", lag))
    w = by_date(*keys, "_phase").rowsBetween(Window.unboundedPreceding, 0)
    start = F.element_at(F.col("_seed"), (F.col("_phase") + 1).cast("int"))["value"]
    return seeded.withColumns({c: start + F.sum(c).over(w) for c in columns}).select(*df.columns)


def restore_history(df: DataFrame, params: DataFrame, name: str) -> DataFrame:
    """Undo a difference on the history, with its seed rows back in place."""
    seeds = seed_rows(params, name).select("id", "date", "value")
    return seeds.unionByName(undo_difference(df, params, name).select("id", "date", "value"))


def invert_panel(df: DataFrame, params: DataFrame, steps: list[str]) -> DataFrame:
    """Undo all steps on a transformed history (id, date, value)."""
    steps = ordered_steps(steps)
    if "Seasonal Differencing" in steps:
        df = restore_history(df, params, "sd")
    if "Differencing" in steps:
        df = restore_history(df, params, "d")
    return invert_values(df, params, steps, ["value"])


def invert_forecast(df: DataFrame, params: DataFrame, steps: list[str], keys: list[str]) -> DataFrame:
    """Undo all steps on forecast rows after the last observation (value, conf_lo, conf_hi)."""
    steps = ordered_steps(steps)
    columns = [c for c in ("value", "conf_lo", "conf_hi") if c in df.columns]
    for step, name in (("Seasonal Differencing", "sd"), ("Differencing", "d")):
        if step in steps:
            df = undo_difference(df, params, name, columns, keys, "last")
    return invert_values(df, params, steps, columns)


def history_levels(data: DataFrame, params: DataFrame, steps: list[str]) -> list[tuple[str, DataFrame]]:
    """For each difference step, last one first, its name and the history (id, date, value, lag) with the step undone."""
    steps, out, df = ordered_steps(steps), [], data.select("id", "date", "value")
    for step, name in (("Seasonal Differencing", "sd"), ("Differencing", "d")):
        if step in steps:
            df = restore_history(df, params, name)
            lag = F.col("period").cast("int") if name == "sd" else F.lit(1)
            out.append((name, df.join(params.select("id", lag.alias("lag")), "id")))
    return out


def invert_ahead(df: DataFrame, levels: list[tuple[str, DataFrame]], columns: list[str], keys: list[str],
                 starts: list[str] = ("id",)) -> DataFrame:
    """Undo the differences on rows ahead: running sums from the last values before the first row of each ``starts``.

    So a hold-out continues the history before it, and the future the last observation. ``keys`` tell series of rows
    apart, ``starts`` those that begin at one date.
    """
    for name, level in levels:
        first = df.groupBy(*starts).agg(F.min("date").alias("_first"))
        before = level.join(first, "id").where(F.col("date") < F.col("_first"))
        rank = F.row_number().over(Window.partitionBy(*starts).orderBy(F.desc("date")))
        seeds = before.withColumn("_r", rank).where(F.col("_r") <= F.col("lag")).groupBy(*starts).agg(
            F.array_sort(F.collect_list(F.struct("date", "value"))).alias(f"{name}_last"))
        df = undo_difference(df, seeds, name, columns, keys, "last", starts)
    return df


def invert_predictions(df: DataFrame, data: DataFrame, params: DataFrame, steps: list[str]) -> DataFrame:
    """Undo all steps on actual and prediction of predicted rows (id, run, model_desc, date, ahead, ...).

    A fitted row is one step from the known values before it; rows ahead follow each other.
    """
    columns, levels = df.columns, history_levels(data, params, steps)
    ahead = invert_ahead(df.where("ahead"), levels, ["prediction"], ["id", "run", "model_desc"], ["id", "run"])
    fit = df.where("NOT ahead")
    known = None
    for _, level in levels:
        order = F.row_number().over(by_date())
        numbered = level.withColumn("_n", order)
        back = numbered.select("id", (F.col("_n") + F.col("lag")).alias("_n"), F.col("value").alias("_before"))
        known = numbered.join(back, ["id", "_n"], "left").select("id", "date", F.col("value").alias("_known"), "_before")
        fit = fit.join(known.drop("_known"), ["id", "date"], "left").withColumn(
            "prediction", F.col("prediction") + F.col("_before")).drop("_before")
    out = fit.select(*columns).unionByName(ahead.select(*columns))
    if known is not None:
        out = out.join(known.drop("_before"), ["id", "date"], "left").withColumn(
            "actual", F.when(F.col("actual").isNotNull(), F.col("_known"))).select(*columns)
    return invert_values(out, params, steps, ["actual", "prediction"])
