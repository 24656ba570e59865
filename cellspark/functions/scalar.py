"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nuc_id(image: str = "image", label: str = "label") -> Column:
    """Object id: image and label joined by an underscore."""
    return F.concat_ws("_", F.col(image).cast("string"), F.col(label).cast("string"))


def safe_name(name: Column, dashes: bool = False) -> Column:
    """Name for files: blanks and slashes (or, with ``dashes``, blanks and dashes, in lower case) become underscores."""
    return F.lower(F.regexp_replace(name, "[ \\-]", "_")) if dashes else F.regexp_replace(name, "[ /]", "_")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def reciprocal(value: Column) -> Column:
    """1/value, with 0 for 0."""
    return F.when(value == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), value))


def p_stars(p: Column) -> Column:
    """Significance marks of a p-value; strict limits."""
    return F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def nan_to_null(value: Column) -> Column:
    """Spark orders NaN above all numbers; ingested data uses null for missing values."""
    return F.nanvl(value, F.lit(None).cast("double"))


def parse_channels(items: list[str]) -> dict[str, int]:
    """``name:index`` strings to a mapping."""
    out = {}
    for item in items:
        name, colon, index = item.partition(":")
        if not colon:
            raise ValueError(f"channel {item!r} is not of the form name:index")
        out[name.strip()] = int(index)
    return out
