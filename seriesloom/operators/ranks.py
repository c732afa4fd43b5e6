"""Exact order statistics of groups of any size.

Equal values are counted first, then the distinct (group, value) pairs are range-partitioned, so neither a hot
group nor a hot value ends up in one task. Partition totals give every pair its place in the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import materialise


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct (keys, value) with their count ``n`` and the rank ``hi`` of the last of the equal values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered)  # the ranges must not change between the two passes below
    totals = ordered.groupBy(*keys, "part").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("part_n").over(before), F.lit(0)))
    totals = totals.withColumn("total", F.sum("part_n").over(Window.partitionBy(*keys)))
    running = Window.partitionBy(*keys, "part").orderBy(value)
    return (
        ordered.withColumn("hi", F.sum("n").over(running))
        .join(totals.drop("part_n"), [*keys, "part"])
        .withColumn("hi", F.col("hi") + F.col("offset"))
        .drop("part", "offset")
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``probs``."""
    ranked = ranked_values(df, keys, value).withColumn("lo", F.col("hi") - F.col("n") + 1)
    aggs, outs = [], []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p)) + 1
        for side, place in (("a", F.floor(at)), ("b", F.ceil(at))):
            inside = (F.col("lo") <= place) & (place <= F.col("hi"))
            aggs.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
        a, b, w = (F.col(f"_{name}_{s}") for s in "abw")
        outs.append((a + (b - a) * w).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)
