"""Least squares for every group at once.

Spark sums the cross products X'X and X'y per group with a partial aggregate in front of the shuffle, so a hot group
costs no more than any other and only one small matrix per group travels. A vectorised helper then solves those
matrices: plain or ridge least squares, a choice among subsets of columns by AICc, or the elastic net. One pass over
the rows serves all candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.text import dot

NARROW = 6  # columns of x up to which cross products are sums of their own
FIT_SCHEMA = "beta array<double>, se array<double>, sse double, choice int, aicc double"


def features_array(names: list[str], intercept: bool = True) -> Column:
    columns = [F.col(n).cast("double") for n in names]
    return F.array(*([F.lit(1.0)] + columns if intercept else columns))


def cross_products(df: DataFrame, keys: list[str], x: Column, y: Column, weight: Column | None = None, width: int = 0
                   ) -> DataFrame:
    """Per group: n and the upper triangle of z z' summed over rows, z = (x, y). Rows with a null are left out.

    With the ``width`` of a narrow x, each sum is a buffer of its own, which Spark compiles.
    """
    rows = df.select(*keys, F.concat(x, F.array(y.cast("double"))).alias("z"), *(
        [weight.cast("double").alias("w")] if weight is not None else []))
    rows = rows.where(~F.exists("z", lambda v: v.isNull() | F.isnan(v)))
    z = F.col("z")
    scale = (lambda v: v * F.col("w")) if weight is not None else (lambda v: v)
    size = F.size(z)
    triangle = F.flatten(F.transform(
        z, lambda a, i: F.transform(F.slice(z, i + 1, size - i), lambda b: scale(a * b))))
    if 0 < width <= NARROW:
        at = [F.get("z", F.lit(i)) for i in range(width + 1)]
        sums = [F.sum(scale(at[i] * at[j])) for i in range(width + 1) for j in range(i, width + 1)]
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("gram"))
    rows = rows.select(*keys, array_to_vector(triangle).alias("v"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("v")).alias("v")
    ).select(*keys, "n", vector_to_array("v").alias("gram"))


def _square(flat: np.ndarray) -> np.ndarray:
    """Stacked upper triangles (N, L) to symmetric matrices (N, q, q)."""
    q = int((np.sqrt(8 * flat.shape[1] + 1) - 1) / 2)
    out = np.zeros((len(flat), q, q))
    i, j = np.triu_indices(q)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _least_squares(a: np.ndarray, b: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve (A + diag(penalty)) x = b for stacked A; columns are scaled and dependent ones get the shortest x."""
    a = a + np.eye(a.shape[1]) * penalty
    d = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0))
    d = np.where(d > 0, d, 1.0)
    inverse = np.linalg.pinv(a / d[:, :, None] / d[:, None, :], rcond=1e-11, hermitian=True)
    inverse = inverse / d[:, :, None] / d[:, None, :]
    return np.einsum("nij,nj->ni", inverse, b), np.diagonal(inverse, axis1=1, axis2=2)


def _solve_all(m: np.ndarray, rows: np.ndarray, penalty: list[float] | None, subsets: list[list[int]] | None) -> pd.DataFrame:
    """Least squares of a batch of groups: of each the subset of columns with the smallest AICc."""
    p = m.shape[1] - 1
    ridge = np.zeros(p) if penalty is None else np.asarray(penalty, dtype=float)
    best = None
    for choice, subset in enumerate(subsets or [list(range(p))]):
        s = np.asarray(subset, dtype=int)
        a, b, yy = m[:, s[:, None], s[None, :]], m[:, s, p], m[:, p, p]
        beta, inverse = _least_squares(a, b, ridge[s])
        sse = yy - 2 * (beta * b).sum(1) + np.einsum("ni,nij,nj->n", beta, a, beta)
        sse = np.maximum(sse, 1e-12 * np.maximum(yy, 1e-300))
        k = len(s) + 1
        room = np.maximum(rows - k - 1, 1e-9)
        spread = np.maximum(sse, 1e-300) / np.maximum(rows, 1)
        aicc = rows * np.log(spread) + 2 * k + 2 * k * (k + 1) / room
        aicc = np.where(rows > k + 1, aicc, 1e300 + k)
        free = np.maximum(rows - len(s), 1)
        full = np.zeros((len(m), p))
        full[:, s] = beta
        se = np.full((len(m), p), np.nan)
        se[:, s] = np.sqrt(np.maximum(inverse, 0) * (sse / free)[:, None])
        now = [full, se, sse, np.full(len(m), choice), aicc]
        if best is None:
            best = now
        else:
            better = aicc < best[4]
            best = [np.where(better[:, None] if x.ndim == 2 else better, x, y) for x, y in zip(now, best)]
    return pd.DataFrame({"beta": list(best[0]), "se": list(best[1]), "sse": best[2],
                         "choice": best[3].astype("int32"), "aicc": best[4]})


def least_squares(
    sums: DataFrame, penalty: list[float] | None = None, subsets: list[list[int]] | None = None,
    carry: list[str] = (),
) -> DataFrame:
    """Solve every group of ``cross_products``; with ``subsets`` the one with the smallest AICc wins.

    Result columns: beta (zeros outside the subset), se, sse, choice (index of the subset), aicc.
    """

    @F.pandas_udf(FIT_SCHEMA)
    def solve(gram: pd.Series, n: pd.Series) -> pd.DataFrame:
        return _solve_all(_square(np.stack(gram.to_numpy())), n.to_numpy(dtype=float), penalty, subsets)

    keys = [c for c in sums.columns if c not in ("n", "gram", *carry)]
    solved = sums.select(*keys, *carry, "n", solve("gram", "n").alias("f"))
    return solved.select(*keys, *carry, "n", "f.*")


def elastic_net(
    sums: DataFrame, grid: list[tuple[float, float]], rounds: int = 200, carry: list[str] = ()
) -> DataFrame:
    """Elastic net for every group and every (penalty, mixture) of the grid, by coordinate descent on the sums.

    The first column is the intercept. Features are standardised and the target is scaled to unit sd. Result: one row
    per group and grid entry with ``choice`` (its index) and ``beta`` on the original scale.
    """

    @F.pandas_udf("array<array<double>>")
    def solve(gram: pd.Series, n: pd.Series) -> pd.Series:
        m = _square(np.stack(gram.to_numpy()))
        rows = n.to_numpy(dtype=float)[:, None]
        p = m.shape[1] - 1
        mean = m[:, 0, 1:] / rows
        cov = m[:, 1:, 1:] / rows[:, :, None] - mean[:, :, None] * mean[:, None, :]
        sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
        sd = np.where(sd > 1e-9 * np.maximum(np.abs(mean), 1e-9), sd, np.inf)
        corr = cov / sd[:, :, None] / sd[:, None, :]
        out = []
        for penalty, mixture in grid:
            # the penalty is meant for the target's own scale, as in a plain Gaussian fit
            lam = np.where(np.isfinite(sd[:, -1]), penalty / sd[:, -1], 0.0)[:, None]
            b = np.zeros((len(m), p - 1))
            for _ in range(rounds):
                change = 0.0
                for j in range(p - 1):
                    pull = corr[:, j, -1] - (corr[:, j, :-1] * b).sum(1) + b[:, j] * corr[:, j, j]
                    soft = np.sign(pull) * np.maximum(np.abs(pull) - lam[:, 0] * mixture, 0)
                    new = np.where(corr[:, j, j] > 0, soft / (1 + lam[:, 0] * (1 - mixture)), 0.0)
                    change = max(change, float(np.abs(new - b[:, j]).max(initial=0)))
                    b[:, j] = new
                if change < 1e-9:
                    break
            ysd = np.where(np.isfinite(sd[:, -1]), sd[:, -1], 0.0)[:, None]
            slope = b * ysd / sd[:, :-1]
            intercept = mean[:, -1] - (slope * mean[:, :-1]).sum(1)
            out.append(np.concatenate([intercept[:, None], slope], axis=1))
        return pd.Series([[o[i] for o in out] for i in range(len(m))])

    keys = [c for c in sums.columns if c not in ("n", "gram", *carry)]
    return sums.select(*keys, *carry, "n", F.posexplode(solve("gram", "n")).alias("choice", "beta"))


# Rounds of descent over all columns before the signs are searched, and most steps of that search.
DESCENT_ROUNDS, SIGN_STEPS = 25, 500


def _by_signs(a: np.ndarray, b: np.ndarray, beta: np.ndarray, soft: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, int]:
    """The exact optimum from a near one, by a search over signs (Lee and others 2007), and the steps it took.

    For given signs the optimum is linear. Where the way there crosses zero, it stops at the first crossing and that column
    leaves; where all signs hold, the column whose gradient beats its penalty most comes in.
    """
    d = np.sqrt(np.maximum(np.diagonal(a) + keep, 0))
    d = np.where(d > 0, d, 1.0)
    beta, sign = beta.copy(), np.sign(beta) * (soft > 0)
    active = (beta != 0) | (soft == 0)
    for step in range(1, SIGN_STEPS + 1):
        s = np.flatnonzero(active)
        left = (a[s[:, None], s[None, :]] + np.diag(keep[s])) / d[s][:, None] / d[s][None, :]
        goal = np.linalg.pinv(left, rcond=1e-11, hermitian=True) @ ((b[s] - soft[s] * sign[s]) / d[s]) / d[s]
        crossed = (sign[s] != 0) & (goal * sign[s] < 0)
        if crossed.any():
            now = beta[s]
            share = np.where(crossed, now / np.where(crossed, now - goal, 1.0), np.inf)
            first = int(share.argmin())
            beta[s] = now + share[first] * (goal - now)
            beta[s[first]], active[s[first]], sign[s[first]] = 0.0, False, 0.0
            continue
        beta[s] = goal
        slope = a @ beta - b + keep * beta
        over = np.where(active, -np.inf, np.abs(slope) - soft * (1 + 1e-7) - 1e-10 * d)
        worst = int(over.argmax())
        if not over[worst] > 0:
            return beta, step
        active[worst], sign[worst] = True, -np.sign(slope[worst])
    return beta, SIGN_STEPS


def sparse_least_squares(sums: DataFrame, l1: list[float], l2: list[float], carry: list[str] = ()) -> DataFrame:
    """Least squares with a penalty l1 * |b| + l2 * b^2 / 2 for each column (zero for none): Laplace and normal priors.

    Coordinate descent on the cross products for all groups of a batch at once, then an exact search over signs; coefficients
    that the penalty holds are exactly zero. Adds ``beta`` and ``rounds`` (SIGN_STEPS where the search did not end).
    """

    @F.pandas_udf("beta array<double>, rounds int")
    def solve(gram: pd.Series) -> pd.DataFrame:
        m = _square(np.stack(gram.to_numpy()))
        a, b = m[:, :-1, :-1], m[:, :-1, -1]
        p = a.shape[1]
        keep, soft = np.asarray(l2, dtype=float), np.asarray(l1, dtype=float)
        curve = np.diagonal(a, axis1=1, axis2=2) + keep
        beta, _ = _least_squares(a, b, keep + soft + 1e-8)
        for _ in range(DESCENT_ROUNDS):
            for j in range(p):
                pull = b[:, j] - (a[:, j] * beta).sum(1) + a[:, j, j] * beta[:, j]
                beta[:, j] = np.where(curve[:, j] > 0, np.sign(pull) * np.maximum(np.abs(pull) - soft[j], 0) / np.where(
                    curve[:, j] > 0, curve[:, j], 1.0), 0.0)
        found = [_by_signs(*row, soft, keep) for row in zip(a, b, beta)]
        return pd.DataFrame({"beta": [x for x, _ in found], "rounds": np.array([k for _, k in found], "int32")})

    keys = [c for c in sums.columns if c not in ("n", "gram", *carry)]
    return sums.select(*keys, *carry, "n", solve.asNondeterministic()("gram").alias("f")).select(*keys, *carry, "n", "f.*")


def forward_selection(sums: DataFrame, terms: int, prune: str = "backward", carry: list[str] = ()) -> DataFrame:
    """Grow a regression term by term (largest drop of the squared error), then prune it by generalised
    cross-validation; column 0 is the intercept. Adds ``beta`` with zeros for unused columns."""

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_grow_and_prune(m, r, terms, prune) for m, r in zip(_square(np.stack(gram.to_numpy())), n)])

    keys = [c for c in sums.columns if c not in ("n", "gram", *carry)]
    # marked so that the plan neither repeats the call nor moves it into the lambdas that read its result
    return sums.select(*keys, *carry, "n", solve.asNondeterministic()("gram", "n").alias("beta"))


def _grow_and_prune(m: np.ndarray, rows: int, terms: int, prune: str) -> np.ndarray:
    """Greedy growth on the cross products of one series, then removal of terms while the GCV score improves.

    Each added column is swept out of the cross products, which leaves the drop in error of all others in sight; the
    rise in error from removing a term is beta^2 over its entry in the inverse.
    """
    p = len(m) - 1
    left = m.copy()
    scale = np.maximum(np.diagonal(m), 1e-300)
    chosen: list[int] = []
    most = min(terms, max(int(rows) // 3, 1))
    while len(chosen) < most:
        spread = np.diagonal(left)[:p]
        usable = spread > 1e-9 * scale[:p]
        usable[chosen] = False
        if not chosen:
            pick = 0  # the intercept comes first
        else:
            gain = np.where(usable, left[:p, p] ** 2 / np.where(usable, spread, 1.0), 0.0)
            pick = int(gain.argmax())
            if gain[pick] <= 1e-4 * max(left[p, p], 1e-300):
                break
        if left[pick, pick] <= 0:
            break
        chosen.append(pick)
        left = left - np.outer(left[:, pick], left[pick]) / left[pick, pick]

    def fit(columns):
        s = np.array(columns)
        beta, inverse = _least_squares(m[None, s[:, None], s[None, :]], m[None, s, p], np.zeros(len(s)))
        return max(float(m[p, p] - beta[0] @ m[s, p]), 0.0), beta[0], inverse[0]

    def gcv(error, size):
        return error / max(1 - 1.5 * size / max(rows, 1), 1e-3) ** 2

    full = np.zeros(p)
    if not chosen:
        return full
    error, beta, inverse = fit(chosen)
    while prune == "backward" and len(chosen) > 1:
        rise = beta[1:] ** 2 / np.maximum(inverse[1:], 1e-300)
        worst = int(rise.argmin())
        if gcv(error + rise[worst], len(chosen) - 1) > gcv(error, len(chosen)):
            break
        del chosen[worst + 1]
        error, beta, inverse = fit(chosen)
    full[chosen] = beta
    return full


def fit_series(
    df: DataFrame, keys: list[str], x: Column, y: Column, columns: list[str], solver=least_squares,
    cells: list[Column] | None = None, **options
) -> DataFrame:
    """Least squares (or another solver of this module) per series together with its rows: keys, rows (array in order of columns), n, beta and so on.

    For keys whose groups are single series, which the calendar bounds: rows and sums come from one aggregate over the
    partitioning by id, so there is no second pass over the input and no join. ``cross_products`` is the variant for
    groups without such a bound. Where the entries of x are known one by one, ``cells`` names them, which Spark compiles.
    """
    gap = F.lit(float("nan"))
    if cells is None:
        z = F.transform(F.concat(x, F.array(y.cast("double"))), lambda v: F.coalesce(v, gap))
    else:
        z = F.array(*[F.coalesce(c.cast("double"), gap) for c in [*cells, y]])
    grouped = df.withColumn("_z", z).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*columns, "_z"))).alias("rows"))
    flat = F.flatten(F.transform("rows", lambda r: r["_z"]))
    width = F.size(F.element_at("rows", 1)["_z"])
    if solver is least_squares:  # sums and solution in one call: one Python worker a task
        inputs = grouped.select(*keys, F.transform("rows", lambda r: r.dropFields("_z")).alias("rows"), flat.alias("_flat"),
                                width.alias("_width"))
        return inputs.withColumn("f", _series_fit(F.col("_flat"), F.col("_width"), **options)).select(*keys, "rows", "f.*")
    sums = grouped.withColumn("s", series_products(flat, width)).select(
        *keys, F.transform("rows", lambda r: r.dropFields("_z")).alias("rows"), "s.n", "s.gram")
    return solver(sums, carry=["rows"], **options)


def series_products(flat: Column, width: Column) -> Column:
    """Cross products (n, gram) of one series; rows with a missing entry are left out."""

    @F.pandas_udf("n bigint, gram array<double>")
    def products(flat: pd.Series, width: pd.Series) -> pd.DataFrame:
        counts, grams = _products(flat, width)
        return pd.DataFrame({"n": counts, "gram": [g[np.triu_indices(len(g))] for g in grams]})

    return products.asNondeterministic()(flat, width)


def _products(flat: pd.Series, width: pd.Series) -> tuple[list[int], list[np.ndarray]]:
    counts, grams = [], []
    for values, q in zip(flat, width):
        z = np.asarray(values, dtype=float).reshape(-1, q)
        z = z[np.isfinite(z).all(axis=1)]
        counts.append(len(z))
        grams.append(z.T @ z)
    return counts, grams


def _series_fit(flat: Column, width: Column, penalty: list[float] | None = None, subsets: list[list[int]] | None = None) -> Column:
    """``series_products`` and ``least_squares`` of one series in one call."""

    @F.pandas_udf(f"n bigint, {FIT_SCHEMA}")
    def fit(flat: pd.Series, width: pd.Series) -> pd.DataFrame:
        counts, grams = _products(flat, width)
        found = _solve_all(np.stack(grams), np.asarray(counts, dtype=float), penalty, subsets)
        found.insert(0, "n", counts)
        return found

    return fit.asNondeterministic()(flat, width)


def fit_in_place(df: DataFrame, keys: list[str], x: Column, y: Column, out: str = "beta", **options) -> DataFrame:
    """``fit_series`` back in row form: the input with the coefficients of its series as a column."""
    columns = [c for c in df.columns if c not in keys]
    fit = fit_series(df, keys, x, y, columns, **options)
    return fit.select(*keys, F.col("beta").alias(out), F.inline("rows"))


def fitted(x: Column, beta: Column = None, width: int = 0) -> Column:
    """x . beta, null when any of them is null; with the ``width`` of x as a sum that Spark compiles."""
    beta = F.col("beta") if beta is None else beta
    if width:
        terms = [F.get(x, F.lit(i)) * F.get(beta, F.lit(i)) for i in range(width)]
        return sum(terms[1:], F.lit(0.0) + terms[0])
    return F.when(~F.exists(x, lambda v: v.isNull()), dot(x, beta))


def grouped_ols(df: DataFrame, keys: list[str], x: Column, y: Column, **options) -> DataFrame:
    return least_squares(cross_products(df, keys, x, y), **options)


def fitted_by_formula(df: DataFrame, formula: str) -> DataFrame:
    """Regression of a panel on a formula such as ``value ~ time_trend + month``, one fit per id."""
    target, right = (part.strip() for part in formula.split("~"))
    names = [n.strip() for n in right.split("+")]
    missing = [n for n in names + [target] if n not in df.columns]
    if missing:
        raise ValueError(f"formula uses unknown columns {missing}")
    x = features_array(names)
    fit = grouped_ols(df, ["id"], x, F.col(target)).select("id", "beta")
    return df.join(fit, "id").select("id", "date", F.col(target), fitted(x).alias("fitted"))
