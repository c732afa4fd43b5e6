"""Panels of series: building, checking, regular grids, future rows, splits and folds.

A panel has the columns id, date, value with one row per id and period. Raw rows reach that shape by a partial
aggregate on (id, period), so an id holding a third of the raw rows shrinks before the shuffle; afterwards the
length of a series is bounded by the calendar (at most 17,568 half hours a year), and windows by id are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.constants import SEED
from seriesloom.functions import periods
from seriesloom.operators.ranks import exact_quantiles

KEY = ["id", "date"]

#: Raw rows of a panel for each part that windows by id work on.
ROWS_A_TASK = 250_000


def by_date(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("id",))).orderBy("date")


def by_date_desc(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("id",))).orderBy(F.col("date").desc())


def whole(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("id",)))


def spread(panel: DataFrame) -> DataFrame:
    """Hash the panel by id into spark.sql.shuffle.partitions parts, ahead of work that is heavy per row.

    It takes the place of the exchange that the windows by id need anyway. Adaptive execution sizes partitions by
    bytes and would run a small but CPU-bound panel in one task; a given number of partitions is left alone. Panels that
    know their raw rows (``build_series``) get more parts as they grow, so a task holds about ROWS_A_TASK rows at any size.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = panel.schema["id"].metadata.get("rows", 0)
    return panel.repartition(max(parts, panel.sparkSession.sparkContext.defaultParallelism, parts_for(known)), "id")


def parts_for(rows: int) -> int:
    return -(-rows // ROWS_A_TASK)


def build_series(
    df: DataFrame,
    id_col: str | Column,
    time_col: str,
    measure: str | Column,
    grain: str,
    agg: str = "sum",
    decimals: int | None = None,
    where: Column | None = None,
    rows: int = 0,
) -> DataFrame:
    """Aggregate raw rows to one row per id and period.

    With ``decimals`` the measure is summed as DECIMAL, so the total does not depend on the order of the tasks. ``rows``
    is the number of raw rows, where a table tells it cheaply: a panel too large for spark.sql.shuffle.partitions parts is
    spread by id into more of them. Its id column keeps the number, so that ``spread`` does the same further on.
    """
    if where is not None:
        df = df.where(where)
    large = parts_for(rows) > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {"metadata": {"rows": rows}} if large else {}
    raw = df.select(
        (F.col(id_col).cast("string") if isinstance(id_col, str) else id_col).alias("id", **named),
        periods.truncate(F.col(time_col), grain).alias("date"),
        (F.col(measure) if isinstance(measure, str) else measure).alias("value"),
    )
    x = F.col("value")
    exact = x.cast(f"decimal(18,{decimals})") if decimals is not None else x.cast("double")
    how = {
        "sum": F.sum(exact).cast("double"),
        "mean": (F.sum(exact).cast("double") / F.count(x)),
        "count": F.count(x).cast("double"),
        "min": F.min(x).cast("double"),
        "max": F.max(x).cast("double"),
    }
    if agg == "median":
        return exact_quantiles(raw, KEY, "value", {"value": 0.5})
    if agg not in how:
        raise ValueError(f"unknown aggregation {agg!r}")
    panel = raw.groupBy("id", "date").agg(how[agg].alias("value"))
    return spread(panel) if large else panel


def check_panel(panel: DataFrame, grain: str) -> DataFrame:
    """One row per id: rows, null dates, null values, repeated keys and missing periods."""
    dates = F.col("date")
    report = panel.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(dates.isNull()).alias("n_null_dates"),
        F.count_if(F.col("value").isNull()).alias("n_null_values"),
        F.count_distinct(dates).alias("n_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    expected = F.size(periods.dates_between(F.col("first_date"), F.col("last_date"), grain)).cast("bigint")
    return report.select(
        "id", "n_rows", "n_null_dates", "n_null_values",
        (F.col("n_rows") - F.col("n_null_dates") - F.col("n_dates")).alias("n_duplicates"),
        (expected - F.col("n_dates")).alias("n_gaps"),
    )


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """Last n rows of each series. Spark cuts each map task to its own last n rows before the shuffle."""
    ranked = panel.withColumn("_r", F.row_number().over(by_date_desc()))
    return ranked.where(F.col("_r") <= n).drop("_r")


def all_but_last_rows(panel: DataFrame, n: int) -> DataFrame:
    ranked = panel.withColumn("_r", F.row_number().over(by_date_desc()))
    return ranked.where(F.col("_r") > n).drop("_r")


def first_rows(panel: DataFrame, n: int) -> DataFrame:
    ranked = panel.withColumn("_r", F.row_number().over(by_date()))
    return ranked.where(F.col("_r") <= n).drop("_r")


def calendar_of(df: DataFrame, time_col: str, grain: str) -> DataFrame:
    """All periods between the first and last time stamp of a table."""
    span = df.agg(
        periods.truncate(F.min(time_col), grain).alias("a"), periods.truncate(F.max(time_col), grain).alias("b")
    )
    return span.select(F.explode(periods.dates_between(F.col("a"), F.col("b"), grain)).alias("date"))


def date_sequence(spark: SparkSession, start: str, stop: str, grain: str) -> DataFrame:
    """Calendar sequence between two dates given as text."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(periods.dates_between(a, b, grain)).alias("date"))


def regular_grid(panel: DataFrame, grain: str) -> DataFrame:
    """Every period between the first and last date of each id; missing ones carry null values.

    Each row expands into itself and the empty periods up to the next row, so there is no second scan and no join.
    Dates should lie on the grain, as ``build_series`` leaves them; a row that does not keeps its own date.
    """
    after = F.lead("date").over(by_date())
    dates = F.filter(periods.dates_between(F.col("date"), F.col("_next"), grain), lambda d: d < F.col("_next"))
    own = F.array(F.col("date"))
    rows = panel.withColumn("_next", after).withColumn(
        "_d", F.explode(F.when(F.col("_next").isNull(), own).otherwise(F.array_union(own, dates))))
    others = [c for c in panel.columns if c not in KEY]
    return rows.select("id", F.col("_d").alias("date"), *[
        F.when(F.col("_d") == F.col("date"), F.col(c)).alias(c) for c in others])


def add_future(panel: DataFrame, n_future: int, grain: str) -> DataFrame:
    """Append n_future rows per id with null values; ``is_future`` marks them."""
    last = panel.groupBy("id").agg(F.max("date").alias("b"))
    ahead = last.select("id", F.explode(periods.dates_after(F.col("b"), n_future, grain)).alias("date"))
    return panel.withColumn("is_future", F.lit(False)).unionByName(
        ahead.withColumn("is_future", F.lit(True)), allowMissingColumns=True
    )


def split_last(panel: DataFrame, n_assess: int) -> DataFrame:
    """Column split: the last n_assess rows of each id are 'test', the others 'train'."""
    rank = F.row_number().over(by_date_desc())
    return panel.withColumn("split", F.when(rank <= n_assess, "test").otherwise("train"))


def time_folds(
    panel: DataFrame, n_assess: int, n_folds: int = 5, expanding: bool = True, skip: int | None = None
) -> DataFrame:
    """Time-series slices (id, fold, role, date), fold 1 being the most recent.

    Each slice tests ``assess`` rows after ``n - n_assess`` training rows (rolling) or all earlier rows (expanding).
    """
    assess = max(1, n_assess // n_folds)
    skip = assess if skip is None else skip
    w = by_date_desc()
    ranked = panel.select(
        "id", "date", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(whole()).alias("n")
    )
    folds = F.array(*[F.lit(k) for k in range(1, n_folds + 1)])
    rows = ranked.withColumn("fold", F.explode(folds))
    newest = (F.col("fold") - 1) * skip
    initial = F.col("n") - n_assess
    role = F.when((F.col("r") > newest) & (F.col("r") <= newest + assess), "test").when(
        (F.col("r") > newest + assess) & (F.lit(expanding) | (F.col("r") <= newest + assess + initial)), "train"
    )
    rows = rows.withColumn("role", role)
    enough = F.col("n") >= newest + assess + (1 if expanding else initial)
    return rows.where(F.col("role").isNotNull() & enough).select("id", "fold", "role", "date")


def random_folds(panel: DataFrame, n_folds: int = 5, seed: int = SEED) -> DataFrame:
    """K-fold assignment by a hash of the key: the same on every run, no shuffle."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.col("date").cast("string")))
    fold = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_folds).cast("int") + 1
    return panel.withColumn("fold", fold)
