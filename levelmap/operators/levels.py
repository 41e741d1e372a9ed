"""A sheet's 25 slots as rows.

Arrays made by an expression are exploded with the outer form and filtered afterwards.
The plain form makes the optimizer test the array for emptiness first, which would compute
the expression twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmap.functions import predicates
from levelmap.schemas import SHEET_KEYS, SLOTS, Slot


def level_array_sql(*fields: str) -> str:
    """All slots of the sheet row as an array of structs in list order, with the fields named."""

    def entry(s: Slot) -> str:
        values = {
            "slot": str(s.slot),
            "family": f"'{s.family}'",
            "source": s.label_col or f"'{s.source}'",
            "label": s.label_col or (f"'{s.label}'" if s.label else "string(null)"),
            "price": s.price_col,
            "size_m": s.size_col or "double(null)",
        }
        return "struct(" + ", ".join(f"{values[f]} as {f}" for f in fields) + ")"

    return "array(" + ", ".join(entry(s) for s in SLOTS) + ")"


def level_array(*fields: str) -> Column:
    return F.expr(level_array_sql(*fields))


def level_rows(sheets: DataFrame) -> DataFrame:
    """One row per sheet and slot. A narrow step: no shuffle."""
    return sheets.select(*SHEET_KEYS, F.inline(level_array("slot", "family", "source", "price", "size_m")))


def active_levels(sheets: DataFrame) -> DataFrame:
    return level_rows(sheets).filter(predicates.is_active(F.col("price")))


def sorted_levels_sql() -> str:
    """The sheet row's active levels by price; equal prices stay in list order."""
    levels = level_array_sql("price", "slot", "source")
    return f"sort_array(filter({levels}, v -> {predicates.is_active_sql('v.price')}))"


def level_order(sheets: DataFrame) -> DataFrame:
    """Active levels with their 1-based position by (price, slot) within the sheet."""
    ordered = sheets.select(*SHEET_KEYS, F.posexplode_outer(F.expr(sorted_levels_sql())).alias("i", "v"))
    return ordered.filter("i is not null").select(
        *SHEET_KEYS, (F.col("i") + 1).alias("pos"), "v.slot", "v.source", "v.price"
    )
