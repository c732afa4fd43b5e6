"""Registration of queries and the panels they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.operators import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the operators of the inventory it shows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Panels built from the driver tables, and the same panels in SQL.


def orders_monthly(spark, sf):
    return P.build_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "month",
                          decimals=2)


def orders_daily(spark, sf):
    return P.build_series(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "day",
                          decimals=2)


def ship_monthly(spark, sf):
    lines = table(spark, sf, "lineitem")  # the ends of its files tell the number of rows
    return P.build_series(lines, "l_partkey", "l_shipdate", "l_quantity", "month", decimals=2, rows=lines.count())


def flag_monthly(spark, sf):
    return P.build_series(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity", "month",
                          decimals=2)


def events_hourly(spark, sf):
    return P.build_series(table(spark, sf, "events"), "event_type", "ts", "value", "hour", decimals=2)


def _series_sql(source, id_col, time_col, measure, grain):
    return (
        f"SELECT CAST({id_col} AS VARCHAR) AS id, CAST(date_trunc('{grain}', {time_col}) AS TIMESTAMP) AS date, "
        f"CAST(sum(CAST({measure} AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {source} GROUP BY 1, 2"
    )


ORDERS_M = _series_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "month")
ORDERS_D = _series_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "day")
SHIP_M = _series_sql("lineitem", "l_partkey", "l_shipdate", "l_quantity", "month")
FLAG_M = _series_sql("lineitem", "l_returnflag", "l_shipdate", "l_quantity", "month")
EVENTS_H = _series_sql("events", "event_type", "ts", "value", "hour")


def with_sql(base: str, *steps: str) -> str:
    """WITH p AS (base), s1 AS (...), ... SELECT: the last step is the final select."""
    ctes = [f"p AS ({base})"] + list(steps[:-1])
    return "WITH " + ",\n".join(ctes) + "\n" + steps[-1]
