"""Registered queries: each runs an operator over the whole driver tables, most with the same result in SQL."""

from seriesloom.catalog import registry
from seriesloom.catalog import panels, reshaping, describing, quality, transforming  # noqa: F401
from seriesloom.catalog import features, statistics, importance, forecasting, models, explaining  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
COVERS = registry.COVERS
