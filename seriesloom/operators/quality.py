"""Edits, filling, imputation and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.describe import decompose
from seriesloom.operators.panel import by_date, regular_grid, whole


def apply_edits(panel: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace values by those of an edits table (id, date, value); ``edited`` marks the changed rows."""
    changed = edits.select("id", "date", F.col("value").alias("_edit"))
    return panel.join(changed, ["id", "date"], "left").withColumn(
        "value", F.coalesce("_edit", "value")).withColumn("edited", F.col("_edit").isNotNull()).drop("_edit")


def forward_fill(panel: DataFrame, column: str = "value") -> DataFrame:
    """Carry the last known value forward."""
    return panel.withColumn(column, F.last(column, ignorenulls=True).over(by_date()))


def interpolate(panel: DataFrame, column: str = "value") -> DataFrame:
    """Linear interpolation by row position; the ends carry the nearest value.

    Lag and lead past nulls cost one step per row; a frame to the end of the partition would cost quadratic time.
    """
    t = F.row_number().over(by_date())
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(column).alias("v")))
    out = panel.withColumn("_t", t).withColumn("_k", known)
    out = out.withColumns({
        "_a": F.expr("lag(_k) IGNORE NULLS OVER (PARTITION BY id ORDER BY date)"),
        "_b": F.expr("lead(_k) IGNORE NULLS OVER (PARTITION BY id ORDER BY date)")})
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_t") - a["t"], b["t"] - a["t"])
    filled = F.coalesce(F.col(column), line, a["v"], b["v"])
    return out.withColumn(column, filled).drop("_t", "_k", "_a", "_b")


def impute(panel: DataFrame, grain: str, period: int, box_cox: bool = False) -> DataFrame:
    """Fill the gaps of a regular grid.

    Series with at least two seasons are interpolated after taking the season out, the others linearly; with
    ``box_cox`` this happens on the Box-Cox scale of each series. ``imputed`` marks the filled rows.
    """
    grid = regular_grid(panel, grain)
    lam = None
    if box_cox:
        from seriesloom.functions import transforms as X
        from seriesloom.operators.transform import guerrero_lambda

        grid = grid.join(guerrero_lambda(panel, period), "id", "left")
        lam = F.when(F.min("value").over(whole()) > 0, F.col("lambda"))
        grid = grid.withColumn("lambda", lam).withColumn(
            "value", F.when(F.col("lambda").isNull(), F.col("value")).otherwise(
                X.box_cox(F.col("value"), F.col("lambda"))))
    parts = decompose(grid.withColumn("_n", F.count(F.lit(1)).over(whole())), period)
    season = F.when(F.col("_n") >= 2 * period, F.coalesce("season", F.lit(0.0))).otherwise(F.lit(0.0))
    adjusted = parts.withColumn("_s", season).withColumn("imputed", F.col("value").isNull()).withColumn(
        "value", F.col("value") - F.col("_s"))
    filled = interpolate(adjusted).withColumn("value", F.col("value") + F.col("_s"))
    if box_cox:
        filled = filled.withColumn("value", F.when(F.col("lambda").isNull(), F.col("value")).otherwise(
            X.inverse_box_cox(F.col("value"), F.col("lambda"))))
    return filled.select("id", "date", "value", "imputed")


def detect_anomalies(
    panel: DataFrame, period: int, alpha: float = 0.02, max_share: float = 0.1, clean_alpha: float = 0.75
) -> DataFrame:
    """Flag remainders outside the inter-quartile limits, at most a share of each series, and propose clean values."""
    parts = decompose(panel.where(F.col("value").isNotNull()), period)
    r = F.col("remainder")
    quart = parts.withColumn("_q", F.percentile(r, [0.25, 0.75]).over(whole())).withColumn(
        "_n", F.count(F.lit(1)).over(whole()))
    q25, q75 = F.col("_q")[0], F.col("_q")[1]
    factor = 0.15 / alpha
    limits = quart.withColumn("_lo", q25 - factor * (q75 - q25)).withColumn("_hi", q75 + factor * (q75 - q25))
    centre = (F.col("_lo") + F.col("_hi")) / 2
    scored = limits.withColumn("anomaly_score", F.abs(r - centre))
    rank = F.row_number().over(whole().orderBy(F.round("anomaly_score", 6).desc(), F.col("date")))
    tolerance = (F.abs("trend") + F.abs("season")) * 1e-9  # rounding noise is no anomaly
    outside = (r < F.col("_lo") - tolerance) | (r > F.col("_hi") + tolerance)
    flag = outside & (rank <= F.floor(F.col("_n") * max_share))
    base = F.col("season") + F.col("trend")
    low, high = base + F.col("_lo"), base + F.col("_hi")
    side = F.when(r < F.col("_lo"), F.col("_lo")).otherwise(F.col("_hi"))
    out = scored.withColumn("_flag", flag)
    return out.select(
        "id", "date", F.col("value").alias("observed"), "season", "trend", "remainder",
        (F.col("value") - F.col("season")).alias("seasadj"),
        F.when(F.col("_flag"), "Yes").otherwise("No").alias("anomaly"),
        F.when(~F.col("_flag"), 0).when(r < F.col("_lo"), -1).otherwise(1).alias("anomaly_direction"),
        "anomaly_score", low.alias("recomposed_l1"), high.alias("recomposed_l2"),
        F.when(F.col("_flag"), base + clean_alpha * side).otherwise(F.col("value")).alias("observed_clean"))


def anomaly_report(anomalies: DataFrame, digits: int = 2) -> DataFrame:
    """Flagged rows only, rounded, for display."""
    return anomalies.where(F.col("anomaly") == "Yes").select(
        "id", "date", F.round("observed", digits).alias("observed"),
        F.round("observed_clean", digits).alias("cleaned"), "anomaly_direction")


def clean_anomalies(panel: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Replace flagged values by their clean value."""
    clean = anomalies.select("id", "date", "observed_clean")
    return panel.join(clean, ["id", "date"], "left").withColumn(
        "value", F.coalesce("observed_clean", "value")).drop("observed_clean")
