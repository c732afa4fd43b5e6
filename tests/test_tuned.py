"""Tuned parameters reach the forecasts; names that nothing can vary are refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.constants import METHOD_DEFAULTS, default_params
from seriesloom.operators import frames as M
from seriesloom.operators.features import append_future
from seriesloom.operators.models.registry import fit_predict
from seriesloom.plans import tuning
from seriesloom.plans.forecast import forecast

CONTEXT = M.Context(12, ("month", "year"))


@pytest.fixture(scope="module")
def future(panel):
    return append_future(panel, 6, "month").withColumns({"month": F.month("date").cast("double"),
                                                         "year": F.year("date").cast("double")})


def test_tuned_values_change_forecasts_by_id(spark, future):
    frame = M.model_frame(future, M.standard_runs(6, 6))
    tuned = spark.createDataFrame([("a", "Random Forest", {"rf_trees": 3.0, "rf_min_n": 30.0}, 1.0)],
                                  "id string, method string, params map<string,double>, score double")
    plain = {"rf_trees": 5}
    got = tuning.predict_tuned(frame, "Random Forest", CONTEXT, tuned, plain)
    want = {"a": fit_predict(frame, "Random Forest", CONTEXT, {"rf_trees": 3, "rf_min_n": 30}),
            "b": fit_predict(frame, "Random Forest", CONTEXT, plain)}
    key = lambda df, i: {(r.run, r.date): r.prediction for r in df.where(F.col("id") == i).collect()}
    for i, df in want.items():
        a, b = key(got, i), key(df, i)
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
    result = forecast(future, ["Naive", "Random Forest"], CONTEXT, 6, 6, [0.8], {"Random Forest": plain}, tuned=tuned)
    made = key(result.predictions.where("model_desc = 'Random Forest'"), "a")
    assert all(np.isclose(made[k], v) for k, v in key(got, "a").items())
    assert result.predictions.where("model_desc = 'Naive'").count() > 0


def test_every_searchable_name_is_a_parameter():
    names = {n for p in METHOD_DEFAULTS.values() for n in p}
    assert set(tuning.RANGES) <= names
    points = tuning.space_filling(["boost_tree_depth", "boost_sample_size"], 5)
    assert len({p["boost_tree_depth"] for p in points}) == 5


def test_refusals():
    with pytest.raises(ValueError, match="boundary"):
        tuning.space_filling(["boundary"], 3)
    with pytest.raises(ValueError, match="ff_epochs"):
        default_params("Feed-Forward", {"ff_epochs": 7})
    assert default_params("Feed-Forward", {"ff_epochs": 100})["ff_epochs"] == 100
