"""Explaining a model on feature rows.

A model here is any function that adds a column ``prediction`` to a DataFrame with the feature columns (an ml model's
transform, or coefficients joined by id). Every explanation is one set of changed copies of the rows, scored by one
prediction job: the copies differ in one feature, one grid value or one step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.constants import SEED
from seriesloom.operators.linear import features_array, fitted, grouped_ols
from seriesloom.operators.panel import whole

Predict = Callable[[DataFrame], DataFrame]


def linear_model(rows: DataFrame, features: list[str], target: str = "actual") -> Predict:
    """Least squares per id as a prediction function."""
    x = features_array(features)
    fit = grouped_ols(rows, ["id"], x, F.col(target)).select("id", "beta")

    def predict(df: DataFrame) -> DataFrame:
        return df.join(fit, "id").withColumn("prediction", fitted(x)).drop("beta")

    return predict


def ml_model(model, features: list[str]) -> Predict:
    """A fitted pyspark.ml regression model as a prediction function."""
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(vectors.transform(df)).drop("features")

    return predict


def prepared(frame: DataFrame, features: list[str], split: str = "test") -> DataFrame:
    """Rows of the hold-out (or the training part) of the test run with their features."""
    part = F.col("ahead") if split == "test" else ~F.col("ahead")
    return frame.where((F.col("run") == "test") & part).select("id", "date", "actual", *features)


def observation(frame: DataFrame, date: str, features: list[str]) -> DataFrame:
    """The test row of a date, one per id."""
    return prepared(frame, features).where(F.col("date") == F.lit(date).cast("timestamp_ntz"))


def _rmse(squared: Column) -> Column:
    return F.sqrt(F.avg(squared))


def permutation_importance(
    rows: DataFrame, features: list[str], predict: Predict, repeats: int = 10, seed: int = SEED
) -> DataFrame:
    """Rise of the RMSE per id when one feature is shuffled among the rows of the id, averaged over repeats."""
    base = rows.withColumn("_place", F.row_number().over(whole().orderBy("date")))
    copies = base.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    shuffled = F.row_number().over(Window.partitionBy("id", "_rep").orderBy(
        F.xxhash64("date", "_rep", F.lit(seed)), "date"))
    donors = copies.select("id", "_rep", shuffled.alias("_place"), F.struct(*features).alias("_donor"))
    joined = copies.join(donors, ["id", "_rep", "_place"])
    # feature 0 is the untouched copy
    joined = joined.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    changed = joined.select(
        "id", "date", "actual", "_rep", "_j",
        *[F.when(F.col("_j") == i, F.col(f"_donor.{f}")).otherwise(F.col(f)).alias(f)
          for i, f in enumerate(features, 1)])
    error = F.pow(F.col("actual") - F.col("prediction"), 2)
    losses = predict(changed).groupBy("id", "_rep", "_j").agg(_rmse(error).alias("loss"))
    plain = F.max(F.when(F.col("_j") == 0, F.col("loss"))).over(Window.partitionBy("id", "_rep"))
    names = F.array(*[F.lit(f) for f in features])
    return losses.withColumn("_base", plain).where(F.col("_j") > 0).groupBy(
        "id", F.element_at(names, F.col("_j")).alias("variable")
    ).agg(F.avg("loss").alias("loss"), F.avg(F.col("loss") - F.col("_base")).alias("importance"))


def partial_dependence(rows: DataFrame, feature: str, features: list[str], predict: Predict,
                       points: int = 101) -> DataFrame:
    """Mean prediction per id with the feature set to each value of a grid over its range."""
    low, high = F.min(feature).over(whole()), F.max(feature).over(whole())
    wide = rows.withColumn("_lo", low).withColumn("_hi", high)
    wide = wide.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / F.lit(max(points - 1, 1))
    changed = wide.withColumn(feature, value)
    return predict(changed).groupBy("id", F.col("_k").alias("point")).agg(
        F.min(feature).alias("x"), F.avg("prediction").alias("prediction")).withColumn("variable", F.lit(feature))


def break_down(rows: DataFrame, chosen: DataFrame, features: list[str], predict: Predict) -> DataFrame:
    """Contributions of the features to the prediction of one observation per id.

    Features are fixed to the observation one after the other, in order of the size of their single effect; the
    differences of the mean prediction are the contributions, starting at the overall mean.
    """
    target = chosen.select("id", F.struct(*features).alias("_obs"))
    both = rows.join(target, "id")
    count = len(features)
    single = both.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(count)))).select(
        "id", "_j", *[F.when(F.col("_j") == i, F.col(f"_obs.{f}")).otherwise(F.col(f)).alias(f)
                      for i, f in enumerate(features, 1)])
    means = predict(single).groupBy("id", "_j").agg(F.avg("prediction").alias("mean"))
    base = F.max(F.when(F.col("_j") == 0, F.col("mean"))).over(Window.partitionBy("id"))
    effects = means.withColumn("_effect", F.abs(F.col("mean") - base)).where(F.col("_j") > 0)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("_effect", 9).desc(), "_j"))
    order = effects.select("id", "_j", place.alias("_p")).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("_j", "_p"))).alias("_order"))
    steps = both.join(order, "id").withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(count)))).select(
        "id", "_step", "_order",
        *[F.when(F.col("_order")[i] <= F.col("_step"), F.col(f"_obs.{f}")).otherwise(F.col(f)).alias(f)
          for i, f in enumerate(features, 1)])
    path = predict(steps).groupBy("id", "_step").agg(
        F.avg("prediction").alias("cumulative"), F.first("_order").alias("_order"))
    before = F.lag("cumulative").over(Window.partitionBy("id").orderBy("_step"))
    names = F.array(*[F.lit(f) for f in features])
    index = F.filter(F.map_entries("_order"), lambda e: e["value"] == F.col("_step"))[0]["key"]
    variable = F.when(F.col("_step") == 0, F.lit("intercept")).otherwise(F.element_at(names, index))
    return path.select("id", F.col("_step").alias("step"), variable.alias("variable"),
                       (F.col("cumulative") - F.coalesce(before, F.lit(0.0))).alias("contribution"), "cumulative")


def nearest_rows(rows: DataFrame, chosen: DataFrame, features: list[str], count: int = 50) -> DataFrame:
    """The rows of each id that are closest to its observation, by standardised distance."""
    target = chosen.select("id", F.struct(*features).alias("_obs"))
    both = rows.join(target, "id")
    parts = []
    for f in features:
        sd = F.stddev_samp(f).over(whole())
        parts.append(F.coalesce(F.pow(F.try_divide(F.col(f) - F.col(f"_obs.{f}"), sd), 2), F.lit(0.0)))
    squared = reduce(lambda a, b: a + b, parts)
    both = both.withColumn("distance", F.sqrt(squared)).drop("_obs")
    place = F.row_number().over(whole().orderBy(F.round("distance", 9), "date"))
    return both.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")


def local_stability(rows: DataFrame, chosen: DataFrame, features: list[str], predict: Predict, count: int = 50
                    ) -> DataFrame:
    """Residual quantiles of the neighbours of an observation next to those of all rows."""
    near = nearest_rows(rows, chosen, features, count).drop("distance").withColumn("part", F.lit("neighbours"))
    both = rows.withColumn("part", F.lit("all")).unionByName(near)
    residual = F.col("actual") - F.col("prediction")
    q = F.percentile(residual, [0.0, 0.25, 0.5, 0.75, 1.0])
    out = predict(both).groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"), q.alias("_q"))
    return out.select("id", "part", "n", *[
        F.col("_q")[i].alias(c) for i, c in enumerate(("p0", "p25", "p50", "p75", "p100"))])


def neighbour_profiles(rows: DataFrame, chosen: DataFrame, feature: str, features: list[str], predict: Predict,
                       count: int = 50, points: int = 11) -> DataFrame:
    """Prediction of every neighbour along the grid of one feature."""
    near = nearest_rows(rows, chosen, features, count)
    low, high = F.min(feature).over(whole()), F.max(feature).over(whole())
    wide = near.withColumn("_lo", low).withColumn("_hi", high).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    changed = wide.withColumn(feature, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / (points - 1))
    return predict(changed).select("id", "date", F.lit(feature).alias("variable"), F.col("_k").alias("point"),
                                   F.col(feature).alias("x"), "prediction")
