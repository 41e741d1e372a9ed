"""The same-day band between put support and call resistance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.functions.predicates import holds, is_active, number_text


def pin_width(ps0: Column, cr0: Column) -> Column:
    """Width of the band, NULL unless both edges are set; crossed edges give a negative width."""
    return F.when(is_active(ps0) & is_active(cr0), cr0 - ps0)


def pin_mid(ps0: Column, cr0: Column) -> Column:
    return F.when(is_active(ps0) & is_active(cr0), (cr0 + ps0) / 2)


def pin_class(width: Column, narrow: Column, wide: Column) -> Column:
    return F.when(
        width.isNotNull(),
        F.when(width < narrow, fixed.PIN_NARROW).when(width < wide, fixed.PIN_NORMAL).otherwise(fixed.PIN_WIDE),
    )


def pin_box_text(width: Column, kind: Column) -> Column:
    return F.concat(
        F.lit(fixed.PIN_MARK + " "), kind, F.lit("  "), number_text(width, fixed.FORMAT_ONE_DECIMAL), F.lit(" pt")
    )


def pin_summary_text(width: Column, kind: Column) -> Column:
    text = F.concat(kind, F.lit(" ("), number_text(width, fixed.FORMAT_WHOLE), F.lit(" pt)"))
    return F.coalesce(text, F.lit(fixed.TEXT_UNSET))


def breaks_up(close: Column, cr0: Column, buf: Column) -> Column:
    """Needs the upper edge only, and holds on every bar beyond it."""
    return is_active(cr0) & holds(close > cr0 + buf)


def breaks_down(close: Column, ps0: Column, buf: Column) -> Column:
    return is_active(ps0) & holds(close < ps0 - buf)
