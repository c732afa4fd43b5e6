"""Helpers shared by the corpus operators: registry, staging, word counts and skew-safe joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Word characters are all but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A class is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot classes.
HOT_SHARE = 4096
#: Rows of a batch sent to Python; texts can be long, so batches are short.
BATCH_ROWS = 512


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with its SQL twin if SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep the batches that Python gets small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def word_count(text: Column) -> Column:
    """Number of words, without building a list of them: each word shrinks to one letter with the blanks around it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    blank = r"[\x20\x09-\x0D]"
    shrunk = F.regexp_replace(text, rf"{blank}*+[^\x20\x09-\x0D]++{blank}*+", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(shrunk)).otherwise(F.lit(0)).cast("long")


def staged(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again, so that it is computed once and survives lost executors."""
    return materialise(df)


def attach(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with the one row of their class, whose number of rows is in column ``size``.

    Hot classes hold more than 1/HOT_SHARE of all rows each, so they are fewer than HOT_SHARE: these, and only these, are
    broadcast, and their rows are never shuffled. ``classes`` is read three times: pass a staged frame.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * F.lit(HOT_SHARE) > F.lit(total)
    hot = classes.where(is_hot)
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes.where(~is_hot), keys)
    return near.unionByName(rest)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns that clash with result columns (Spark resolves names without regard to case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
