"""Scalar transforms and their inverses as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log(x: Column) -> Column:
    return F.ln(x)


def box_cox(x: Column, lam: Column) -> Column:
    power = (F.signum(x) * F.pow(F.abs(x), lam) - 1) / F.nullif(lam, F.lit(0.0))
    return F.when(lam == 0, F.when(x > 0, F.ln(x))).otherwise(power)


def inverse_box_cox(x: Column, lam: Column) -> Column:
    base = x * lam + 1
    power = F.signum(base) * F.pow(F.abs(base), 1 / F.nullif(lam, F.lit(0.0)))
    return F.when(lam == 0, F.exp(x)).otherwise(power)


def log_interval(x: Column, low: Column, high: Column) -> Column:
    """Scaled logit; values outside (low, high) become null."""
    ratio = F.try_divide(x - low, high - x)
    return F.when(ratio > 0, F.ln(ratio))


def inverse_log_interval(x: Column, low: Column, high: Column) -> Column:
    # 1/(1+e^-x) does not overflow for large x
    return (high - low) / (1 + F.exp(-x)) + low


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def inverse_min_max(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def standardise(x: Column, mean: Column, sd: Column) -> Column:
    return F.try_divide(x - mean, sd)


def inverse_standardise(x: Column, mean: Column, sd: Column) -> Column:
    return x * sd + mean
