"""Calendar parts and holidays as Column builders: no lookup table, no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month and weekday names in calendar order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def signature(d: Column) -> dict[str, Column]:
    """The calendar parts of a time stamp."""
    month, day, hour = F.month(d), F.dayofmonth(d), F.hour(d)
    yday, wday = F.dayofyear(d), F.dayofweek(d)
    week = F.floor((yday - 1) / 7).cast("int") + 1
    quarter_start = F.trunc(d.cast("date"), "quarter")
    first_wday = F.dayofweek(F.trunc(d.cast("date"), "month"))
    names = lambda labels, i: F.element_at(F.array(*[F.lit(x) for x in labels]), i)
    return {
        "year": F.year(d),
        "half": F.when(month <= 6, 1).otherwise(2),
        "quarter": F.quarter(d),
        "month": month,
        "month_lbl": names(MONTHS, month),
        "day": day,
        "hour": hour,
        "minute": F.minute(d),
        "second": F.second(d).cast("int"),
        "hour12": F.pmod(hour + 11, F.lit(12)) + 1,
        "am_pm": F.when(hour < 12, 1).otherwise(2),
        "wday": wday,
        "wday_lbl": names(WEEKDAYS, wday),
        "mday": day,
        "qday": F.datediff(d.cast("date"), quarter_start) + 1,
        "yday": yday,
        "mweek": F.floor((day + first_wday - 2) / 7).cast("int") + 1,
        "week": week,
        "week2": F.pmod(week, F.lit(2)),
        "week3": F.pmod(week, F.lit(3)),
        "week4": F.pmod(week, F.lit(4)),
        "mday7": F.floor((day - 1) / 7).cast("int") + 1,
    }


LABELS = {"month_lbl": MONTHS, "wday_lbl": WEEKDAYS}


def easter_steps(year: Column) -> list[tuple[str, Column]]:
    """Gregorian Easter by the anonymous (Meeus) rule as a list of (name, column) to be added in turn.

    Each step refers to the names before it, so Spark evaluates the shared parts once.
    """
    div = lambda a, b: F.floor(a / b).cast("int")
    golden, century, rest = (F.col(f"_{n}") for n in ("golden", "century", "rest"))
    moon, weekday, days = (F.col(f"_{n}") for n in ("moon", "weekday", "days"))
    skipped = div(century - div(century + 8, 25) + 1, 3)
    return [
        ("_golden", F.pmod(year, F.lit(19))),
        ("_century", div(year, 100)),
        ("_rest", F.pmod(year, F.lit(100))),
        ("_moon", F.pmod(19 * golden + century - div(century, 4) - skipped + 15, F.lit(30))),
        ("_weekday", F.pmod(32 + 2 * F.pmod(century, F.lit(4)) + 2 * div(rest, 4) - moon - F.pmod(rest, F.lit(4)),
                            F.lit(7))),
        ("_days", moon + weekday - 7 * div(golden + 11 * moon + 22 * weekday, 451) + 114),
        ("_easter", F.make_date(year, div(days, 31), F.pmod(days, F.lit(31)) + 1)),
    ]


def holidays(d: Column, easter: Column) -> dict[str, Column]:
    """0/1 indicators of United States holidays on the day of a time stamp."""
    month, day, wday = F.month(d), F.dayofmonth(d), F.dayofweek(d)
    date = d.cast("date")

    def nth(m: int, weekday: int, n: int) -> Column:
        return (month == m) & (wday == weekday) & day.between(7 * n - 6, 7 * n)

    flags = {
        "new_years_day": (month == 1) & (day == 1),
        "martin_luther_king_day": nth(1, 2, 3),
        "presidents_day": nth(2, 2, 3),
        "good_friday": date == F.date_sub(easter, 2),
        "easter_sunday": date == easter,
        "memorial_day": (month == 5) & (wday == 2) & (day >= 25),
        "independence_day": (month == 7) & (day == 4),
        "labor_day": nth(9, 2, 1),
        "columbus_day": nth(10, 2, 2),
        "veterans_day": (month == 11) & (day == 11),
        "thanksgiving_day": nth(11, 5, 4),
        "christmas_day": (month == 12) & (day == 25),
    }
    out = {f"holiday_{k}": v.cast("int") for k, v in flags.items()}
    return out
