"""Projections, filters, reshaping, joins and unions."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("id", "date", "value", "is_future")


def pick_columns(
    df: DataFrame,
    keep: list[str] | None = None,
    drop_pattern: str | None = None,
    rename: dict[str, str] | None = None,
    first: list[str] | None = None,
) -> DataFrame:
    """Select, drop by pattern, rename and reorder; names that are absent are skipped."""
    names = [c for c in (keep or df.columns) if c in df.columns]
    if drop_pattern:
        names = [c for c in names if not re.search(drop_pattern, c)]
    if first:
        names = [c for c in first if c in names] + [c for c in names if c not in first]
    return df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in names])


def between_dates(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows with start <= date <= stop."""
    return df.where(F.col("date").between(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")))


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns) if columns else df.na.drop()


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, levels: list[str]) -> DataFrame:
    """Long to wide; levels are given so that Spark need not scan for them first."""
    return df.groupBy(*ids).pivot(name, levels).agg(F.first(value))


def apply_to_columns(df: DataFrame, columns: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return apply_to_columns(df, floats, lambda c: F.round(c, digits))


def feature_columns(df: DataFrame, keep_date: bool = False) -> list[str]:
    """Names of the feature columns: all but the keys and the target."""
    names = [c for c in df.columns if c not in KEYS]
    return ["date"] + names if keep_date and "date" in df.columns else names


def predictor_matrix(df: DataFrame, columns: list[str] | None = None, out: str = "features") -> DataFrame:
    """Assemble the feature columns into one vector column next to the keys and the target."""
    from pyspark.ml.feature import VectorAssembler

    columns = columns or feature_columns(df)
    vectors = VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip").transform(df)
    return vectors.select(*[c for c in KEYS if c in df.columns], out)


def is_constant(column: str) -> Column:
    """Aggregate: does a column hold one single value (nulls aside)? min = max needs no distinct."""
    return F.min(column).eqNullSafe(F.max(column))


def constant_flags(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Does each column hold one single value? One pass, one row per column to the driver; empty without rows.

    The columns are unpivoted in front of a partial aggregate with two buffers, which Spark compiles well for any
    number of columns; an aggregate with two buffers per column is not compiled beyond a hundred of them.
    """
    if not columns:
        return {}
    types = dict(df.dtypes)
    kind = "string" if any(types[c] in ("string", "timestamp_ntz", "date") for c in columns) else "double"
    long = df.select([F.col(c).cast(kind).alias(c) for c in columns]).unpivot([], columns, "variable", "x")
    found = long.groupBy("variable").agg(is_constant("x").alias("constant")).collect()
    return {r["variable"]: r["constant"] for r in found}


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Names of columns without variance."""
    columns = columns or feature_columns(df)
    flags = constant_flags(df, columns)
    return [c for c in columns if flags.get(c)]


def constant_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: variable, is_constant."""
    flags = df.agg(*[is_constant(c).alias(c) for c in columns])
    return flags.unpivot([], columns, "variable", "is_constant")


def drop_constant(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


def near_zero_variance(
    df: DataFrame, columns: list[str], freq_cut: float = 95 / 5, unique_cut: float = 5.0
) -> DataFrame:
    """Per column: ratio of the two commonest values, share of distinct values, and the screening flags."""
    as_text = df.select([F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        as_text.unpivot([], columns, "variable", "level")
        .where(F.col("level").isNotNull())
        .groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("n_rows"))
    # Spark keeps only two rows per variable and task before this window is shuffled
    place = F.row_number().over(Window.partitionBy("variable").orderBy(F.col("n").desc()))
    top = counts.withColumn("place", place).where(F.col("place") <= 2).groupBy("variable").agg(
        F.max(F.when(F.col("place") == 1, F.col("n"))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second"),
    )
    ratio = F.when(F.col("second").isNull(), F.lit(0.0)).otherwise(F.col("first") / F.col("second"))
    unique = F.col("n_levels") / F.col("n_rows") * 100
    out = top.join(totals, "variable").select(
        "variable", ratio.alias("freq_ratio"), unique.alias("percent_unique"),
        (F.col("n_levels") == 1).alias("zero_var"))
    flag = F.col("zero_var") | ((F.col("freq_ratio") > freq_cut) & (F.col("percent_unique") <= unique_cut))
    return out.withColumn("nzv", flag)


def one_hot(df: DataFrame, column: str, levels: list[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns for known levels; the first level is the reference."""
    kept = levels[1:] if drop_first else levels
    names = {f"{column}_{re.sub('[^0-9A-Za-z]+', '_', lv).strip('_').lower()}": lv for lv in kept}
    return df.withColumns({n: (F.col(column) == lv).cast("int") for n, lv in names.items()}).drop(column)


def join_regressors(panel: DataFrame, regressors: DataFrame) -> DataFrame:
    """Left join of regressors (or features, or cleaned values) on id and date."""
    return panel.join(regressors, ["id", "date"], "left")


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing in one frame become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def levels_of(conf_min: float, conf_max: float | None = None, by: float = 0.05) -> list[float]:
    """Confidence levels from min to max, both included."""
    if conf_max is None or conf_max <= conf_min:
        return [round(conf_min, 6)]
    steps = int((conf_max - conf_min) / by + 1e-9)
    return sorted({round(conf_min + k * by, 6) for k in range(steps + 1)} | {round(conf_max, 6)})


def with_levels(df: DataFrame, levels: list[float], out: str = "conf_lvl") -> DataFrame:
    """Repeat every row once per level; a literal array, so no join.

    Levels are decimals with two places, or as many as they need.
    """
    places = max([2, *[-Decimal(str(lv)).normalize().as_tuple().exponent for lv in levels]])
    array = F.array(*[F.lit(Decimal(str(lv))).cast(f"decimal({places + 1},{places})") for lv in levels])
    return df.withColumn(out, F.explode(array))


def keep_models(df: DataFrame, pattern: str, column: str = "model_desc") -> DataFrame:
    return df.where(F.col(column).rlike(pattern))
