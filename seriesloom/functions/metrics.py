"""Forecast error measures as aggregate Column builders over actual (a) and prediction (p)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def me(a: Column, p: Column) -> Column:
    return F.avg(p - a)


def mae(a: Column, p: Column) -> Column:
    return F.avg(F.abs(a - p))


def mape(a: Column, p: Column) -> Column:
    return F.avg(F.abs(F.try_divide(a - p, a))) * 100


def smape(a: Column, p: Column) -> Column:
    return F.avg(F.try_divide(F.abs(p - a), (F.abs(a) + F.abs(p)) / 2)) * 100


def mse(a: Column, p: Column) -> Column:
    return F.avg((a - p) * (a - p))


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(mse(a, p))


def rmspe(a: Column, p: Column) -> Column:
    share = F.try_divide(a - p, a)
    return F.sqrt(F.avg(share * share)) * 100


def rsq(a: Column, p: Column) -> Column:
    """Squared correlation; null for constant actuals or predictions (but for rounding)."""
    moves = lambda c: F.var_pop(c) > 1e-12 * F.avg(c * c)
    return F.when(moves(a) & moves(p), F.try_divide(F.pow(F.covar_pop(a, p), 2), F.var_pop(a) * F.var_pop(p)))


def mase(a: Column, p: Column, step: Column) -> Column:
    """``step`` is the absolute change of the actual from the row before."""
    return F.try_divide(mae(a, p), F.avg(step))


METRIC_BUILDERS = {"me": me, "mae": mae, "mape": mape, "smape": smape, "mse": mse, "rmse": rmse, "rmspe": rmspe,
                   "rsq": rsq, "mase": mase}


def metric(name: str, a: Column, p: Column, step: Column) -> Column:
    name = name.lower()
    if name not in METRIC_BUILDERS:
        raise ValueError(f"unknown metric {name!r}")
    return mase(a, p, step) if name == "mase" else METRIC_BUILDERS[name](a, p)
