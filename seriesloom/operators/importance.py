"""Importance of features for the target per series, and selecting features by it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.constants import SEED
from seriesloom.functions import trees as T
from seriesloom.operators.linear import elastic_net, features_array, fit_series
from seriesloom.operators.panel import all_but_last_rows, last_rows, whole
from seriesloom.operators.reshape import feature_columns, stack

METHODS = ["Correlation", "PPS", "LASSO", "Random Forest"]


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select("id", "date", "value", *features).na.drop()


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2.0


def safe_corr(a: Column, b: Column) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def correlations(df: DataFrame, features: list[str], method: str = "spearman") -> DataFrame:
    """Correlation of each feature with the value per id, zero ones removed.

    Ranks are columns next to each other: the rows are sorted once a column, and the ranks of the value serve all features.
    """
    rows = complete_rows(df, features).select("id", "value", *[F.col(f).cast("double").alias(f) for f in features])
    if method == "spearman":
        rows = rows.select("id", *[average_rank(c, ["id"]).alias(c) for c in ["value", *features]])
    wide = rows.groupBy("id").agg(*[safe_corr(F.col(f), F.col("value")).alias(f) for f in features])
    out = wide.unpivot("id", features, "variable", "importance")
    return out.where(F.abs("importance") > 1e-12).withColumn("type", F.lit("Correlation"))


def correlation_matrix(df: DataFrame, features: list[str], method: str = "spearman") -> DataFrame:
    """Full matrix per id in long form (id, var_x, var_y, corr)."""
    names = ["value", *features]
    rows = complete_rows(df, features)
    if method == "spearman":
        rows = rows.select("id", *[average_rank(c, ["id"]).alias(c) for c in names])
    pairs = [(a, b) for a in names for b in names]
    wide = rows.groupBy("id").agg(*[
        safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)
        if a <= b])
    index = {p: i for i, p in enumerate(pairs)}
    entries = F.array(*[
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"c{index[min(a, b), max(a, b)]}").alias("corr"))
        for a, b in pairs])
    return wide.select("id", F.inline(entries))


def _per_series(df: DataFrame, features: list[str], kind: str, score) -> DataFrame:
    """Positive scores score(x, y) of the features, one job group per series."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        found = score(part[features].to_numpy(float), part["value"].to_numpy(float))
        return pd.DataFrame({"id": part["id"].iloc[0], "variable": features, "importance": found})

    rows = complete_rows(df, features).select("id", "date", "value", *[F.col(c).cast("double").alias(c) for c in features])
    scores = rows.groupBy("id").applyInPandas(run, "id string, variable string, importance double")
    return scores.where(F.col("importance") > 0).select("id", "variable", "importance", F.lit(kind).alias("type"))


def predictive_power(df: DataFrame, features: list[str], min_leaf: int = 7, min_share: float = 0.01) -> DataFrame:
    """max(0, 1 - MAE of a tree on one feature / MAE of the median) per id, in sample.

    A split must take ``min_share`` of the squared error around the mean and leave ``min_leaf`` rows on each side.
    """

    def score(x, y):
        plain = np.abs(y - np.median(y)).mean()
        least = min_share * ((y - y.mean()) ** 2).sum()
        out = []
        for j in range(x.shape[1]):
            codes = T.binned(x[:, [j]])
            guess = T.Tree(codes, y, np.arange(len(y)), min_leaf, min_gain=least).predict(codes)
            out.append(max(0.0, 1 - np.abs(y - guess).mean() / plain) if plain > 0 else 0.0)
        return out

    return _per_series(df, features, "PPS", score)


def lasso(df: DataFrame, features: list[str], penalty: float = 1.0) -> DataFrame:
    """Coefficients of a lasso per id, the non-zero ones."""
    rows = complete_rows(df, features).withColumn("x", features_array(features))
    fit = fit_series(rows, ["id"], F.col("x"), F.col("value"), ["date"], solver=elastic_net, grid=[(penalty, 1.0)])
    names = F.array(*[F.lit(f) for f in features])
    coefs = fit.select("id", F.posexplode(F.slice("beta", 2, len(features))).alias("j", "importance"))
    return coefs.where(F.abs("importance") > 0).select(
        "id", F.element_at(names, F.col("j") + 1).alias("variable"), "importance", F.lit("LASSO").alias("type"))


def forest(df: DataFrame, features: list[str], trees: int = 500, repeats: int = 10, min_leaf: int = 5) -> DataFrame:
    """Permutation importance in a random forest of each id: the mean rise of the RMSE when a feature is shuffled."""

    def score(x, y):
        codes, rows = T.binned(x), np.ones(len(y), bool)
        model = T.forest(codes, y, rows, trees, max(1, x.shape[1] // 3), min_leaf, SEED)
        random = np.random.default_rng(SEED)
        rmse = lambda c: float(np.sqrt(((y - T.forest_predict(model, c)) ** 2).mean()))
        base, out = rmse(codes), []
        for j in range(x.shape[1]):
            rise = 0.0
            for _ in range(repeats):
                moved = codes.copy()
                moved[:, j] = random.permutation(moved[:, j])
                rise += rmse(moved) - base
            out.append(rise / repeats)
        return out

    return _per_series(df, features, "Random Forest", score)


def importance(df: DataFrame, methods: list[str], features: list[str] | None = None) -> DataFrame:
    """Importances of the chosen methods, stacked: id, variable, importance, type."""
    features = features or feature_columns(df)
    build = {"Correlation": correlations, "PPS": predictive_power, "LASSO": lasso, "Random Forest": forest}
    unknown = set(methods) - set(build)
    if unknown:
        raise ValueError(f"unknown importance methods {sorted(unknown)}")
    return stack(*[build[m](df, features).select("id", "variable", "importance", "type") for m in methods])


def normalise(scores: DataFrame) -> DataFrame:
    """Importances between 0 and 1 within each type: absolute correlation, PPS as is, the others over their maximum."""
    size = F.abs("importance")
    most = F.max(size).over(Window.partitionBy("id", "type"))
    scaled = F.when(F.col("type").isin("Correlation", "PPS"), size).otherwise(F.try_divide(size, most))
    return scores.withColumn("importance", F.when(F.col("type") == "PPS", F.col("importance")).otherwise(scaled))


def keep_important(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows at or above the threshold of their type; types without a threshold go."""
    keep = F.lit(False)
    for kind, limit in thresholds.items():
        keep = keep | ((F.col("type") == kind) & (F.col("importance") >= limit))
    return scores.where(keep)


def selection_summary(scores: DataFrame, digits: int = 3) -> DataFrame:
    """Per id and variable: number of methods, average importance and the methods, most important first."""
    order = F.array(*[F.lit(m) for m in METHODS])
    kinds = F.collect_set("type")
    return scores.groupBy("id", "variable").agg(
        F.count(F.lit(1)).alias("n_methods"), F.round(F.avg("importance"), digits).alias("average_importance"),
        F.array_join(F.filter(order, lambda m: F.array_contains(kinds, m)), ", ").alias("methods"),
    )


def selected_names(scores: DataFrame) -> list[str]:
    """Variables kept for at least one id: at most the number of features."""
    return sorted(r["variable"] for r in scores.select("variable").distinct().collect())


def select_features(
    df: DataFrame, scores: DataFrame, thresholds: dict[str, float], n_future: int
) -> dict[str, DataFrame]:
    """History and future rows with the selected features, the summary, and the importances that passed.

    Selection is per id: a column that some ids keep is null in the rows of the others, whose history does not miss it.
    """
    kept = keep_important(scores, thresholds)
    names = [n for n in selected_names(kept) if n in df.columns]
    own = kept.groupBy("id").agg(F.collect_set("variable").alias("_own"))
    with_own = df.join(own, "id", "left")
    mine = {n: F.coalesce(F.array_contains("_own", n), F.lit(False)) for n in names}
    whole_row = reduce(lambda a, b: a & b, [~mine[n] | F.col(n).isNotNull() for n in names], F.col("value").isNotNull())
    chosen = with_own.withColumn("_whole", whole_row).select(
        "id", "date", "value", *[F.when(mine[n], F.col(n)).alias(n) for n in names], "_whole")
    return {
        "data": all_but_last_rows(chosen, n_future).where("_whole").drop("_whole"),
        "future_data": last_rows(chosen.drop("_whole"), n_future),
        "summary": selection_summary(kept),
        "importance": kept,
    }
