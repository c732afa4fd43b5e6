"""Tail probabilities of test statistics, as Spark column functions over small helpers."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Published critical values. Rows: sample sizes; columns: probabilities.
ADF_SIZES = [25, 50, 100, 250, 500, 100000]
ADF_PROBS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
ADF_VALUES = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]
PP_VALUES = [
    [-22.5, -19.9, -17.9, -15.6, -3.66, -2.51, -1.53, -0.43],
    [-25.7, -22.4, -19.8, -16.8, -3.71, -2.60, -1.66, -0.65],
    [-27.4, -23.6, -20.7, -17.5, -3.74, -2.62, -1.73, -0.75],
    [-28.4, -24.4, -21.3, -18.0, -3.75, -2.64, -1.78, -0.82],
    [-28.9, -24.8, -21.5, -18.1, -3.76, -2.65, -1.78, -0.84],
    [-29.5, -25.1, -21.8, -18.3, -3.77, -2.66, -1.79, -0.87],
]
KPSS_VALUES = [0.347, 0.463, 0.574, 0.739]
KPSS_PROBS = [0.10, 0.05, 0.025, 0.01]


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x), by the finite series for whole df."""
    if x is None or math.isnan(x) or df < 1:
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return total


def table_p(stat: float, n: int, values: list[list[float]]) -> float:
    """Interpolate a p-value in a table by sample size, then by statistic; ends are clipped."""
    row = [np.interp(n, ADF_SIZES, [r[j] for r in values]) for j in range(len(ADF_PROBS))]
    return float(np.interp(stat, row, ADF_PROBS))


@lru_cache(maxsize=4096)
def shapiro_weights(n: int) -> np.ndarray:
    """Weights of the ordered sample (Royston 1992)."""
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = float(m @ m)
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    u = 1 / math.sqrt(n)
    # Published polynomial coefficients.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ss)], u)
    a = np.zeros(n)
    if n > 5:
        before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ss)], u)
        phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = before, -before
    else:
        phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = last, -last
    return a


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and its p-value."""
    n = len(x)
    x = np.sort(x)
    spread = float(((x - x.mean()) ** 2).sum()) if n else 0.0
    if n < 3 or spread <= 0:
        return float("nan"), float("nan")
    w = min(float(shapiro_weights(n) @ x) ** 2 / spread, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    # Published normal approximations of ln(1 - W).
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = -math.log(max(gamma - math.log(max(1 - w, 1e-300)), 1e-300))
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        ln = math.log(n)
        y = math.log(max(1 - w, 1e-300))
        mu = 0.0038915 * ln**3 - 0.083751 * ln**2 - 0.31082 * ln - 1.5861
        sd = math.exp(0.0030302 * ln**2 - 0.082676 * ln - 0.4803)
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def chi2_p(stat: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_tail(a, int(b)) if a == a else None for a, b in zip(x, k)])

    return tail(stat.cast("double"), df.cast("int"))


def kpss_p(stat: Column) -> Column:
    """Piecewise linear in the published table, clipped at its ends."""
    out = F.when(stat <= KPSS_VALUES[0], KPSS_PROBS[0])
    for (a, b), (p, q) in zip(zip(KPSS_VALUES, KPSS_VALUES[1:]), zip(KPSS_PROBS, KPSS_PROBS[1:])):
        out = out.when(stat <= b, p + (stat - a) * ((q - p) / (b - a)))
    return F.when(stat.isNotNull(), out.otherwise(KPSS_PROBS[-1]))
