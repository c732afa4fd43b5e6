"""Column builders for text and numbers in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_label(col: Column) -> Column:
    """smooth_level -> Smooth Level."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def to_name(col: Column) -> Column:
    """Smooth Level -> smooth_level."""
    return F.lower(F.replace(col, F.lit(" "), F.lit("_")))


def parse_list(col: Column, kind: str = "numeric") -> Column:
    """Comma-separated text to an array of numbers or strings."""
    parts = F.split(F.replace(col, F.lit(" "), F.lit("")), ",")
    if kind == "numeric":
        return F.transform(parts, lambda x: x.try_cast("double"))
    if kind == "character":
        return parts
    raise ValueError(f"unknown kind {kind!r}")


def parse_list_text(text: str, kind: str = "numeric") -> list:
    """The same for one Python string, used for settings."""
    parts = [p for p in text.replace(" ", "").split(",") if p]
    return [float(p) if kind == "numeric" else p for p in parts]


def let(value: Column, body) -> Column:
    """Bind a value once inside higher-order functions; without it Spark evaluates it at every use."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
