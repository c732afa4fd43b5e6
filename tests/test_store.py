"""Models fitted once, saved, and scored on rows that the fit has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import frames as M
from seriesloom.operators.features import append_future
from seriesloom.operators.models import store as S
from seriesloom.operators.models.registry import fit_predict
from tests.conftest import panel_of, seasonal

CTX = M.Context(12, ("wave", "price"))
EXTRA = {"Prophet": {"growth": "logistic"}, "MARS": {"prod_degree": 2}}


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(0)
    noisy = {k: (np.array(seasonal(n, level, slope)) + r.normal(0, 4, n)).tolist()
             for k, n, level, slope in (("a", 84, 200, 1.0), ("b", 60, 500, -0.5), ("c", 30, 90, 0.2))}
    noisy["one"] = [5.0]
    df = append_future(panel_of(spark, noisy), 12, "month")
    month = F.month("date")
    return df.withColumns({"wave": F.sin(month / 2.0), "price": F.pmod(F.hash("date"), F.lit(50)) / 10.0}).cache()


@pytest.mark.parametrize("method", sorted(S.STATES))
def test_scores_equal_fit_and_predict(spark, panel, tmp_path, method):
    params = EXTRA.get(method)
    frame = M.model_frame(panel, [M.Run("future", 0, 12)])
    want = {(r.id, r.date): r.prediction for r in fit_predict(frame, method, CTX, params).where("ahead").collect()}
    known = frame.where("NOT ahead")  # the fit sees nothing of what is scored
    S.save_models(S.fit_models(known, [method], CTX, {method: params}, "v1"), str(tmp_path / "models"))
    models = S.load_models(spark, str(tmp_path / "models"), [method], "v1")
    rows = panel.where("is_future").select("id", "date", "wave", "price")
    got = {(r.id, r.date): r.prediction for r in S.score(models, rows).collect()}
    assert set(got) >= {k for k in want if k[0] != "one"}
    for k, v in got.items():
        assert (v is None) == (want[k] is None) and (v is None or np.isclose(v, want[k], rtol=1e-6, atol=1e-6)), (k, v, want[k])
    # fewer rows, other order, extra columns
    part = rows.where("id <> 'a' AND month(date) % 2 = 0").withColumn("H", F.lit("clash"))
    if method in S.ANY_ROW:
        part = part.join(frame.select("id", "date", "t"), ["id", "date"])
        for r in S.score(models, part).where("id <> 'one'").collect():
            assert np.isclose(r.prediction, want[r.id, r.date], rtol=1e-6)


def test_versions_and_parameters(spark, panel, tmp_path):
    frame = M.model_frame(panel, [M.Run("future", 0, 12)])
    folder, methods = str(tmp_path / "models"), sorted(S.STATES)
    S.save_models(S.fit_models(frame, methods, CTX, version="1"), folder)
    S.save_models(S.fit_models(frame, ["Elastic Net"], CTX, {"Elastic Net": {"penalty": 9.0}}, "2"), folder)
    every = S.load_models(spark, folder)
    report = S.parameters(every)
    assert {r.method for r in report.select("method").distinct().collect()} == set(methods)
    assert {r.version for r in S.load_models(spark, folder, ["Elastic Net"]).select("version").distinct().collect()} == {"1", "2"}
    one = S.score(S.load_models(spark, folder, ["Elastic Net"]), panel.where("is_future")).groupBy("id", "date").agg(
        F.count("*").alias("n"), F.countDistinct("prediction").alias("k")).where("id = 'a'").first()
    assert one.n == 2 and one.k == 2
    with pytest.raises(ValueError):
        S.fit_models(frame, ["Random Forest"], CTX)


def test_explanations_read_the_store(spark, panel):
    """Permutation importance and break-down of stored models by name."""
    from seriesloom.operators import explain as X

    frame = M.model_frame(panel.where("id IN ('a', 'b')"), M.standard_runs(12, 12))
    models = S.fit_models(frame, ["Elastic Net", "MARS"], CTX, {"Elastic Net": {"penalty": 0.1}}, run="test")
    rows = X.prepared(frame, ["wave", "price"])
    for method in ("Elastic Net", "MARS"):
        predict = S.predictor(models, method)
        plain = predict(rows).collect()
        assert len(plain) == rows.count() and all(r.prediction is not None for r in plain)
        table = X.permutation_importance(rows, ["wave", "price"], predict)
        assert table.count() >= 2
