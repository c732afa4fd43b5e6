"""Registered queries do the whole job of their operators: default settings, folds and features."""

import inspect

import pytest

from seriesloom.catalog import QUERIES, forecasting, models
from seriesloom.constants import METHOD_DEFAULTS
from seriesloom.operators import frames
from seriesloom.plans import tuning


class Called(Exception):
    pass


def settings(monkeypatch, place, name, query):
    """The arguments with which a query calls a function, its defaults included."""
    signature = inspect.signature(getattr(place, name))

    def called(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(place, name, called)
    monkeypatch.setattr(forecasting, "feature_panel", lambda spark, sf: None)
    monkeypatch.setattr(models, "feature_model_frame", lambda spark, sf: None)
    with pytest.raises(Called) as found:
        QUERIES[query](None, "")
    return found.value.args[0]


@pytest.mark.parametrize("query, name", [("tuned_forest", "tune"), ("automatic_leaderboard", "leaderboard")])
def test_searches_use_defaults(monkeypatch, query, name):
    defaults = {k: p.default for k, p in inspect.signature(getattr(tuning, name)).parameters.items()}
    got = settings(monkeypatch, tuning, name, query)
    assert got["ctx"] == models.FCTX
    assert all(got[k] == v for k, v in defaults.items() if v is not inspect.Parameter.empty)


def test_stacking_uses_five_folds(monkeypatch):
    got = settings(monkeypatch, frames, "model_frame", "stacked_boosted")
    assert len(got["runs"]) == len(frames.standard_runs(24, 12)) + 5


@pytest.mark.parametrize("query", ["model_feed_forward_ar", "model_hinge_basis"])
def test_models_are_not_smaller_than_default(monkeypatch, query):
    got = settings(monkeypatch, models, "fit_predict", query)
    defaults = METHOD_DEFAULTS[got["method"]]
    assert all(v >= defaults[k] for k, v in (got["params"] or {}).items())
