"""Operators for training-data pipelines, with their registered queries and SQL twins."""

from seriesloom.llm.common import ORACLES, QUERIES
from seriesloom.llm import exact_dedup, impact, infill, mixing, negatives, packing, pii, quality_rules, simhash, substrings, token_files, toxicity, urls  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
