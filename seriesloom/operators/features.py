"""Feature columns of a panel: one exchange by id, everything else is a projection or a window over it.

Features of the place in a series are windows and come first, over narrow rows; features of the date alone are put beside them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import periods
from seriesloom.functions.calendar import LABELS, easter_steps, holidays, signature
from seriesloom.operators.panel import by_date, spread, whole
from seriesloom.operators.reshape import constant_columns, constant_flags, feature_columns
from seriesloom.session import materialise

#: One series in so many is looked at first for columns that vary.
LOOK = 1024

#: Up to so many dates are a table of their own, sent to every task (five years of half hours).
MOST_DAYS = 90_000


@dataclass
class FeatureParams:
    """Which feature families to build."""

    calendar: bool = True
    holiday: bool = False
    fourier_periods: list[float] = field(default_factory=list)
    fourier_k: int = 1
    spline_degrees: list[int] = field(default_factory=list)
    lags: list[int] = field(default_factory=list)
    rolls: list[int] = field(default_factory=list)
    interactions: list[str] = field(default_factory=list)


def append_future(panel: DataFrame, n_future: int, grain: str) -> DataFrame:
    """Future rows without an aggregate or a union: the last row of each id expands into itself and the rows after.

    The partitioning by id is kept, so later windows by id need no further exchange.
    """
    panel = spread(panel)
    last = F.lead("date").over(by_date()).isNull()
    own = F.array(F.struct(F.col("date"), F.lit(False).alias("is_future")))
    ahead = F.transform(
        periods.dates_after(F.col("date"), n_future, grain),
        lambda d: F.struct(d.alias("date"), F.lit(True).alias("is_future")))
    rows = panel.withColumn("_last", last).withColumn(
        "_row", F.explode(F.when(F.col("_last"), F.concat(own, ahead)).otherwise(own)))
    others = [c for c in panel.columns if c not in ("id", "date")]
    return rows.select(
        "id", F.col("_row.date").alias("date"),
        *[F.when(~F.col("_row.is_future"), F.col(c)).alias(c) for c in others],
        F.col("_row.is_future").alias("is_future"))


def add_trend(df: DataFrame) -> DataFrame:
    return df.withColumn("time_trend", F.row_number().over(by_date()))


def add_calendar(df: DataFrame) -> DataFrame:
    return add_trend(df).withColumns(signature(F.col("date")))


def add_holidays(df: DataFrame) -> DataFrame:
    """Holiday indicators and ``holiday``, which is 1 on any of them."""
    steps = easter_steps(F.year("date"))
    for name, col in steps:
        df = df.withColumn(name, col)
    flags = holidays(F.col("date"), F.col("_easter"))
    df = df.withColumns(flags).withColumn("holiday", F.greatest(*flags))
    return df.drop(*[name for name, _ in steps])


def fourier_columns(t: Column, season_lengths: list[float], k: int) -> dict[str, Column]:
    out = {}
    for p in season_lengths:
        label = int(p) if float(p).is_integer() else p
        for order in range(1, k + 1):
            angle = t * (2 * math.pi * order / p)
            out[f"sin{label}_K{order}"] = F.sin(angle)
            out[f"cos{label}_K{order}"] = F.cos(angle)
    return out


def add_fourier(df: DataFrame, season_lengths: list[float], k: int = 1) -> DataFrame:
    t = F.row_number().over(by_date())
    return df.withColumn("_t", t).withColumns(fourier_columns(F.col("_t"), season_lengths, k)).drop("_t")


def add_splines(df: DataFrame, degrees: list[int]) -> DataFrame:
    """Polynomial spline basis without inner knots: Bernstein polynomials of the position in the whole frame."""
    s = periods.epoch_seconds(F.col("date")).cast("double")
    df = df.withColumn("_s", s).withColumn(
        "_u", F.try_divide(F.col("_s") - F.min("_s").over(whole()),
                           F.max("_s").over(whole()) - F.min("_s").over(whole())))
    u = F.col("_u")
    columns = {
        f"spline_{j}_{d}": F.lit(float(math.comb(d, j))) * F.pow(u, F.lit(j)) * F.pow(1 - u, F.lit(d - j))
        for d in degrees for j in range(1, d + 1)
    }
    return df.withColumns(columns).drop("_s", "_u")


def add_lags(df: DataFrame, lags: list[int], value: str = "value") -> DataFrame:
    return df.withColumns({f"lag{k}": F.lag(value, k).over(by_date()) for k in lags})


def add_rolls(df: DataFrame, lag: int, rolls: list[int], value: str = "value") -> DataFrame:
    """Mean and sd of the ``p`` values ending ``lag`` rows back; only full windows count."""
    columns = {}
    for p in rolls:
        w = by_date().rowsBetween(-(lag + p - 1), -lag)
        full = F.count(value).over(w) == p
        columns[f"roll_mean_{p}"] = F.when(full, F.avg(value).over(w))
        columns[f"roll_sd_{p}"] = F.when(full, F.stddev_samp(value).over(w))
    return df.withColumns(columns)


def add_interactions(df: DataFrame, terms: list[str]) -> DataFrame:
    """Products such as ``week2 * wday_lbl``; label columns count by their calendar number."""
    numeric = {"month_lbl": "month", "wday_lbl": "wday"}
    out = {}
    for i, term in enumerate(terms, 1):
        names = [numeric.get(n.strip().replace(".", "_"), n.strip().replace(".", "_")) for n in term.split("*")]
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise ValueError(f"interaction {term!r} uses unknown columns {missing}")
        product = F.lit(1.0)
        for n in names:
            product = product * F.col(n).cast("double")
        out[f"inter_{i}"] = product
    return df.withColumns(out)


def dummies_of(name: str) -> dict[str, str]:
    """Names of the 0/1 columns of a calendar label and their levels; the first level is the reference."""
    return {f"{name}_{i:02d}": level for i, level in enumerate(LABELS[name][1:], 2)}


DUMMIES = [c for name in LABELS for c in dummies_of(name)]


def add_dummies(df: DataFrame) -> DataFrame:
    """0/1 columns for the calendar labels but their first level."""
    columns = {}
    for name in LABELS:
        if name in df.columns:
            columns |= {c: (F.col(name) == level).cast("int") for c, level in dummies_of(name).items()}
    return df.withColumns(columns).drop(*LABELS)


def add_place(df: DataFrame, params: FeatureParams) -> DataFrame:
    """The families that depend on the place in a series, but for the trend."""
    if params.fourier_periods:
        df = add_fourier(df, params.fourier_periods, params.fourier_k)
    if params.spline_degrees:
        df = add_splines(df, params.spline_degrees)
    if params.lags:
        df = add_lags(df, params.lags)
        if params.rolls:
            df = add_rolls(df, max(params.lags), params.rolls)
    return df


def add_days(df: DataFrame, params: FeatureParams) -> DataFrame:
    """The families that depend on the date alone, but for interactions and dummies."""
    if params.calendar:
        df = df.withColumns(signature(F.col("date")))
    return add_holidays(df) if params.holiday else df


def days_of(panel: DataFrame, params: FeatureParams, n_future: int, grain: str) -> DataFrame:
    """One row per date of the frame, future ones too, with the features of the date alone."""
    dates = append_future(panel.select("id", "date"), n_future, grain).select("date").distinct()
    return materialise(add_dummies(add_days(dates, params)))


def look_up(df: DataFrame, days: DataFrame) -> DataFrame:
    """Features of the date from a small table of dates; a null date is a date as well."""
    names = [c for c in days.columns if c != "date"]
    known = F.broadcast(days.withColumnRenamed("date", "_date"))
    return df.drop(*names).join(known, F.col("date").eqNullSafe(F.col("_date")), "left").drop("_date")


def feature_frame(
    panel: DataFrame, params: FeatureParams, n_future: int, grain: str, days: DataFrame | None = None
) -> DataFrame:
    """Panel with future rows and all feature families, before constant columns are dropped. One plan.

    With ``days`` (``days_of``) the features of a date are worked out once, not in every row that has the date.
    """
    df = append_future(panel, n_future, grain)
    if params.calendar:
        df = add_trend(df)
    first = df.columns
    df = add_place(df, params)
    place = [c for c in df.columns if c not in first]
    if days is None:
        df = add_days(df, params)
    else:
        df = look_up(df.drop(*LABELS) if params.calendar else df, days)
    dummies = [c for c in df.columns if c in DUMMIES and c not in first]
    of_date = [c for c in df.columns if c not in first + place + dummies]
    if params.interactions:
        df = add_interactions(df, params.interactions)
    first = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in first + of_date + place + dummies]
    return add_dummies(df.select(*[F.col(f"`{c}`") for c in first + of_date + place + rest + dummies]))


def generate_features(panel: DataFrame, params: FeatureParams, n_future: int, grain: str) -> DataFrame:
    """Feature frame without its constant columns.

    A column varies as soon as two values differ, so one series in LOOK settles most columns that stay. A column is
    dropped only after all of its rows were seen: all dates for features of the date, the whole frame for the others.
    """
    df = feature_frame(panel, params, n_future, grain)
    names = feature_columns(df)
    seen = constant_flags(df.where(F.pmod(F.xxhash64("id"), F.lit(LOOK)) == 0), names)
    left = [c for c in names if seen.get(c, True)]
    days = days_of(panel, params, n_future, grain)
    if len(days.columns) > 1 and days.count() <= MOST_DAYS:
        df = feature_frame(panel, params, n_future, grain, days)
    flat = constant_flags(days, [c for c in left if c in days.columns])
    flat |= constant_flags(df, [c for c in left if c not in days.columns])
    return df.drop(*[c for c in names if flat.get(c)])


def columns_for(method: str, columns: list[str]) -> list[str]:
    """Which feature columns a method may use; ``date`` stands for regressing on time only."""
    from seriesloom.constants import method_family

    family = method_family(method)
    names = [c for c in columns if c not in ("id", "date", "value", "is_future")]
    if not names:
        auto = [c for c in signature(F.lit(None).cast("timestamp_ntz")) if c not in LABELS]
        return {"ts": ["date"], "ml": auto, "dl": auto}.get(family, auto + ["date"])
    if family == "ts":
        if method == "SARIMA":
            return ["date"] + [c for c in names if "lag" not in c]
        return ["date"] + names if method == "Prophet" else ["date"]
    if family in ("ml", "dl"):
        return [c for c in names if "spline" not in c] if method == "MARS" else names
    return ["date"] + names
