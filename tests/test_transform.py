import pytest
from pyspark.sql import functions as F

from seriesloom.operators import transform as T
from seriesloom.operators.features import append_future
from tests.conftest import panel_of, seasonal

STEPS = [
    ["Multiply by -1"], ["Add 1"], ["Log"], ["Box-Cox"], ["Log-Interval"], ["Min-Max"], ["Standardization"],
    ["Differencing"], ["Seasonal Differencing"], ["Differencing", "Seasonal Differencing"],
    ["Add 1", "Log", "Box-Cox", "Min-Max", "Standardization", "Differencing"],
]


@pytest.mark.parametrize("steps", STEPS, ids=lambda s: "+".join(s))
def test_round_trip(panel, steps):
    moved, params = T.transform_panel(panel, steps, 12)
    back = T.invert_panel(moved, params, steps)
    both = panel.join(back.withColumnRenamed("value", "back"), ["id", "date"])
    assert both.count() == panel.count()
    worst = both.agg(F.max(F.abs(F.col("value") - F.col("back")) / F.abs(F.col("value")))).first()[0]
    assert worst < 1e-6


def test_future_rows_continue_from_the_last_level(spark, panel):
    moved, params = T.transform_panel(panel, ["Differencing", "Seasonal Differencing"], 12)
    # a perfect forecast on the differenced scale of the next 12 months of the same curve is zero change of change
    ahead = append_future(moved, 12, "month").where("is_future").withColumn("value", F.lit(0.0)).select(
        "id", "date", "value")
    back = T.invert_forecast(ahead, params, ["Differencing", "Seasonal Differencing"], ["id"])
    longer = panel_of(spark, {"a": seasonal(96)[84:]})
    got = [r["value"] for r in back.where("id = 'a'").orderBy("date").collect()]
    assert got == pytest.approx([r["value"] for r in longer.orderBy("date").collect()], rel=1e-6)


def test_unknown_step(panel):
    with pytest.raises(ValueError):
        T.transform_panel(panel, ["Square"])
    assert T.ordered_steps(["Log", "Add 1"]) == ["Add 1", "Log"]


def test_negation_swaps_bounds(spark):
    df = spark.createDataFrame([("a", -5.0, -6.0, -4.0)], "id string, value double, conf_lo double, conf_hi double")
    params = spark.createDataFrame([("a", 1)], "id string, period int")
    row = T.invert_values(df, params, ["Multiply by -1"], ["value", "conf_lo", "conf_hi"]).first()
    assert (row["value"], row["conf_lo"], row["conf_hi"]) == (5.0, 4.0, 6.0)
