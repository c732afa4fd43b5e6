"""Successive halving against the same steps over the errors of the full grid."""

import math

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import frames as M
from seriesloom.operators.accuracy import accuracy_table
from seriesloom.operators.features import append_future
from seriesloom.plans import tuning

CONTEXT = M.Context(12, ("month", "year"))


@pytest.fixture(scope="module")
def future(panel):
    return append_future(panel, 12, "month").withColumns({"month": F.month("date").cast("double"),
                                                          "year": F.year("date").cast("double")})


def by_hand(errors, points, folds, keep):
    """(point, mean error, folds seen, fits) of one series; errors by (point, fold)."""
    left, fits, mean = list(range(points)), 0, {}
    for k in range(1, folds + 1):
        if len(left) == 1:
            break
        fits += len(left)
        mean = {i: (sum(errors[i, f] for f in range(1, k + 1)) / k, k) for i in left}
        left = sorted(left, key=lambda i: (mean[i][0], i))[:math.ceil(len(left) * keep)]
    best = min(left, key=lambda i: (mean[i][0], i))
    return best, *mean[best], fits


@pytest.mark.parametrize("method,points,folds,keep", [("Elastic Net", 10, 4, 0.5), ("KNN", 6, 3, 0.4),
                                                      ("Elastic Net", 1, 2, 0.5), ("Feed-Forward", 3, 2, 0.6)])
def test_halving_equals_steps_by_hand(future, method, points, folds, keep):
    got = {r["id"]: r for r in tuning.tune_by_halving(future, method, CONTEXT, 12, folds, points, keep=keep).collect()}
    grid = tuning.space_filling(tuning.TUNED_BY_DEFAULT[method], points)
    frame = M.model_frame(future, M.fold_runs(12, folds))
    rows = tuning.candidate_predictions(frame, method, CONTEXT, grid).where("ahead")
    errors = {}
    for r in accuracy_table(rows, ["id", "choice", "run"], ["rmse"]).collect():
        errors.setdefault(r["id"], {})[r["choice"], int(r["run"][4:])] = r["rmse"]
    assert set(got) == set(errors) and len(got) > 1
    for k, e in errors.items():
        if points == 1:
            assert got[k]["score"] == pytest.approx(sum(e.values()) / folds) and got[k]["fits"] == folds
            continue
        best, score, seen, fits = by_hand(e, points, folds, keep)
        assert got[k]["params"] == pytest.approx(grid[best])
        assert got[k]["score"] == pytest.approx(score, rel=1e-6)
        assert (got[k]["folds"], got[k]["fits"]) == (seen, fits) and fits < points * folds


def test_empty_panel_and_wrong_shares(future):
    assert tuning.tune_by_halving(future.where("false"), "KNN", CONTEXT, 12, 2, 3).collect() == []
    with pytest.raises(ValueError):
        tuning.tune_by_halving(future, "KNN", CONTEXT, 12, keep=1.0)
    with pytest.raises(ValueError):
        tuning.tune_by_halving(future, "KNN", CONTEXT, 12, validation="none")
