"""Column builders for calendar grains. All work on TIMESTAMP_NTZ and do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ["year", "semester", "quarter", "month", "week", "business_day", "day", "hour", "half_hour"]

_STEP = {
    "year": "INTERVAL 1 YEAR",
    "semester": "INTERVAL 6 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "month": "INTERVAL 1 MONTH",
    "week": "INTERVAL 7 DAY",
    "business_day": "INTERVAL 1 DAY",
    "day": "INTERVAL 1 DAY",
    "hour": "INTERVAL 1 HOUR",
    "half_hour": "INTERVAL 30 MINUTE",
}

SEASON_OF_GRAIN = {
    "year": 1, "semester": 2, "quarter": 4, "month": 12, "week": 52,
    "business_day": 5, "day": 7, "hour": 24, "half_hour": 48,
}


def check_grain(grain: str) -> str:
    if grain not in _STEP:
        raise ValueError(f"unknown grain {grain!r}; one of {GRAINS}")
    return grain


def step(grain: str) -> Column:
    return F.expr(_STEP[check_grain(grain)])


def truncate(col: Column, grain: str) -> Column:
    """Start of the period a time stamp falls in; a weekend belongs to the business day before it."""
    check_grain(grain)
    if grain in ("year", "quarter", "month", "week"):
        return F.trunc(col.cast("date"), grain).cast("timestamp_ntz")
    if grain == "semester":
        first = F.when(F.month(col) <= 6, 1).otherwise(7)
        return F.make_date(F.year(col), first, F.lit(1)).cast("timestamp_ntz")
    day = col.cast("date").cast("timestamp_ntz")
    if grain == "day":
        return day
    if grain == "business_day":
        after = F.weekday(col) - 4  # days since Friday, above 0 on Saturday and Sunday
        return F.date_sub(col.cast("date"), F.greatest(after, F.lit(0))).cast("timestamp_ntz")
    seconds = F.hour(col) * 3600
    if grain == "half_hour":
        seconds = seconds + F.when(F.minute(col) >= 30, 1800).otherwise(0)
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def epoch_seconds(col: Column) -> Column:
    """Seconds since 1970-01-01 read from the calendar fields."""
    days = F.datediff(col.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + (F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)).cast("bigint")


def dates_between(start: Column, stop: Column, grain: str) -> Column:
    """Array of period starts from start to stop, both included."""
    out = F.sequence(start, stop, step(grain))
    if grain == "business_day":
        out = F.filter(out, lambda d: ~F.dayofweek(d).isin(1, 7))
    return out


def dates_after(last: Column, n: int, grain: str) -> Column:
    """Array of the n period starts following last."""
    reach = n if grain != "business_day" else 2 * n + 7
    days = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: _advance(last, k, grain))
    if grain == "business_day":
        days = F.slice(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, n)
    return days


def _advance(col: Column, k: Column, grain: str) -> Column:
    months = {"year": 12, "semester": 6, "quarter": 3, "month": 1}.get(grain)
    if months:
        return col + F.make_ym_interval(F.lit(0), k * months)
    seconds = {"week": 604800, "day": 86400, "business_day": 86400, "hour": 3600, "half_hour": 1800}[grain]
    return col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * seconds).cast("decimal(18,6)"))
