"""Stacking: a second model per series on the out-of-fold predictions of the members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.constants import default_params
from seriesloom.operators.frames import BASE
from seriesloom.operators.linear import elastic_net, features_array, fit_series, fitted, least_squares
from seriesloom.operators.models.trees import boosting


def member_columns(preds: DataFrame, members: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per (id, run, date) with the prediction of every member as a column m1, m2, ..."""
    names = [f"m{i}" for i in range(1, len(members) + 1)]
    first = [F.first(c).alias(c) for c in ("t", "h", "ahead", "actual")]
    columns = [F.first(F.when(F.col("model_desc") == m, F.col("prediction")), ignorenulls=True).alias(n)
               for m, n in zip(members, names)]
    return preds.groupBy("id", "run", "date").agg(*first, *columns), names


def stack(preds: DataFrame, members: list[str], methods: list[str]) -> DataFrame:
    """Fit on the predicted rows of the fold runs, predict the other runs."""
    wide, names = member_columns(preds, members)
    out_of_fold = F.col("run").startswith("fold") & F.col("ahead")
    wide = wide.withColumn("y", F.when(out_of_fold, F.col("actual"))).withColumn("x", features_array(names))
    columns = ["run", "date", "t", "h", "ahead", "actual", "x"]
    out = None
    for method in methods:
        if method == "Boosted Trees":
            rows = _boosted(wide, names)
        else:
            if method == "Linear Regression":
                fit = fit_series(wide, ["id"], F.col("x"), F.col("y"), columns, solver=least_squares,
                                 penalty=[0.0] + [1e-6] * len(names))
            elif method == "Elastic Net":
                fit = fit_series(wide, ["id"], F.col("x"), F.col("y"), columns, solver=elastic_net, grid=[(1.0, 0.5)])
            else:
                raise ValueError(f"unknown stacking method {method!r}")
            rows = fit.select("id", "beta", F.inline("rows")).withColumn("prediction", fitted(F.col("x")))
        rows = rows.where(~F.col("run").startswith("fold")).select(
            *BASE, F.lit(f"Stk - {method}").alias("model_desc"), "prediction")
        out = rows if out is None else out.unionByName(rows)
    return out


def _boosted(wide: DataFrame, names: list[str]) -> DataFrame:
    """A boosted model of each series on the predictions of the members; rows without one of them get null."""
    predict = boosting(default_params("Boosted Trees"), "boost")
    rows = wide.select(*BASE, "y", *names)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["run", "date"])
        x, y = part[names].to_numpy(float), part["y"].to_numpy(float)
        whole_row, out = np.isfinite(x).all(1), np.full(len(part), np.nan)
        known = np.isfinite(y)[whole_row]
        if known.sum() >= 2:
            out[whole_row] = predict(x[whole_row], np.where(known, y[whole_row], 0.0), known)
        return part[list(BASE)].assign(prediction=out)

    schema = rows.select(*BASE, F.lit(None).cast("double").alias("prediction")).schema
    return rows.groupBy("id").applyInPandas(run, schema)
