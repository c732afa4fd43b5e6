"""Automatic choice among a budget of candidates, per series and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.constants import default_params
from seriesloom.operators.accuracy import accuracy_table
from seriesloom.operators.frames import BASE, RUN_KEYS, Context
from seriesloom.operators.models import neighbours, regression
from seriesloom.operators.panel import whole
from seriesloom.session import materialise

CHECK = "|check"
TOP = 3

# Candidate grids: (penalty, mixture) and numbers of neighbours.
NET_GRID = [(0.01, 0.0), (0.01, 1.0), (1.0, 0.5), (10.0, 1.0)]
NEIGHBOUR_GRID = [3, 5, 9]


def with_check_rows(frame: DataFrame) -> DataFrame:
    """The frame plus, for every run, a copy whose last fitted rows (a fifth, at most 12) are held out."""
    last = F.max("t").over(whole(*RUN_KEYS))
    known = frame.where(~F.col("ahead")).withColumn("_nf", last)
    held = F.greatest(F.lit(1), F.least(F.lit(12), F.floor(F.col("_nf") / 5))).cast("int")
    h = F.col("t") - (F.col("_nf") - held)
    copy = known.withColumn("run", F.concat("run", F.lit(CHECK))).withColumn(
        "h", F.greatest(h, F.lit(0)).cast("int")).withColumn("ahead", h > 0).withColumn(
        "y", F.when(~F.col("ahead"), F.col("y"))).drop("_nf")
    return frame.unionByName(copy)


def candidate_rows(frame: DataFrame, ctx: Context) -> DataFrame:
    """Predictions of all candidates, marked by ``candidate``."""
    net = regression.net_path(frame, ctx, NET_GRID).withColumn(
        "candidate", F.concat(F.lit("net"), F.col("choice"))).drop("choice")
    near = neighbours.knn_path(frame, ctx, NEIGHBOUR_GRID).withColumn(
        "candidate", F.concat(F.lit("near"), F.col("choice"))).drop("choice")
    parts = [net, near]
    for name, fn, method in (("linear", regression.linear, "Linear Regression"),
                             ("hinge", regression.hinges, "MARS"), ("net-1", regression.feed_forward, "Feed-Forward")):
        parts.append(fn(frame, ctx, default_params(method)).withColumn("candidate", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def automatic(frame: DataFrame, ctx: Context, params: dict) -> DataFrame:
    """Mean of the best candidates by their error on held-out fitted rows."""
    rows = materialise(with_check_rows(frame))  # read by every candidate
    preds = materialise(candidate_rows(rows, ctx))  # read twice: scores, then the chosen ones
    check = F.col("run").endswith(CHECK)
    metric = str(params["h2o_metric"]).lower()
    scored = preds.where(check & F.col("ahead")).withColumn("run", F.regexp_replace("run", r"\|check$", ""))
    scores = accuracy_table(scored, ["id", "run", "candidate"], [metric])
    place = F.row_number().over(Window.partitionBy("id", "run").orderBy(metric, "candidate"))
    best = scores.where(F.col(metric).isNotNull()).withColumn("_p", place).where(F.col("_p") <= TOP)
    chosen = preds.where(~check).join(best.select("id", "run", "candidate"), ["id", "run", "candidate"], "left_semi")
    first = [F.first(c).alias(c) for c in ("t", "h", "ahead", "actual")]
    rows = chosen.groupBy("id", "run", "date").agg(*first, F.avg("prediction").alias("prediction"))
    return rows.select(*BASE, F.lit("H2O AutoML").alias("model_desc"), "prediction")
