"""Forecast models. Each is a function (frame, context, params) -> predictions for all rows of all runs."""
