"""Null-safe building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_active(price: Column) -> Column:
    """A price that was entered; 0, NULL and NaN all mean "not set"."""
    return F.coalesce(F.nanvl(price, F.lit(0.0)), F.lit(0.0)) != 0.0


def is_active_sql(price: str) -> str:
    """``is_active`` as SQL text, for use inside larger expressions."""
    return f"coalesce(nanvl({price}, 0D), 0D) != 0D"


def holds(condition: Column) -> Column:
    """The condition as a strict boolean: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def number_text(value: Column, pattern: str) -> Column:
    """A number as text. Ties round half to even; small negatives print as -0."""
    return F.call_function("format_number", value, F.lit(pattern))
