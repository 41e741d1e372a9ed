"""Breaks, flips, roles and labels of the sized nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.functions.predicates import holds, is_active, number_text


def breaks(green: Column, price: Column, buf: Column, low: Column, high: Column) -> Column:
    """Whether closes that range over low..high went beyond the node by more than buf.

    Support breaks below, resistance above. With one bar's close for both bounds this is
    the break of that bar. With the extremes of a session's closes so far it is the
    latched flip state, since a level was broken at some bar exactly if the extreme
    close lies beyond it.
    """
    beyond = F.when(green, low < price - buf).otherwise(high > price + buf)
    return is_active(price) & holds(beyond)


def size_class(size_m: Column) -> Column:
    small, medium, large = fixed.SIZE_CLASS_BOUNDS
    return (
        F.when(size_m >= large, 4).when(size_m >= medium, 3).when(size_m >= small, 2).otherwise(1)
    )


def role(green: Column, flipped: Column) -> Column:
    """A flipped node plays the opposite role."""
    return F.when(green != flipped, "support").otherwise("resistance")


def node_label(slot: Column, green: Column, size_m: Column, flipped: Column) -> Column:
    size_tag = F.when(
        holds(size_m > 0), F.concat(F.lit(" $"), number_text(size_m, fixed.FORMAT_SIZE), F.lit("M"))
    ).otherwise("")
    flip_tag = F.when(
        flipped, F.when(green, fixed.TAG_FLIPPED_GREEN).otherwise(fixed.TAG_FLIPPED_RED)
    ).otherwise("")
    return F.concat(
        F.when(green, "G").otherwise("R"), (slot % 4 + 1).cast("string"), size_tag, flip_tag
    )
