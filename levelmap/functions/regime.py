"""Regime of a bar against its zero-gamma pivot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.functions.predicates import holds, is_active, number_text


def regime_mode(net_gex_pos: Column, close: Column, zero_gamma: Column) -> Column:
    """FOLLOW needs negative gamma below the pivot, FADE positive gamma above it.

    A close on the pivot is a transition. An unset pivot compares as price 0.
    """
    pivot = F.coalesce(zero_gamma, F.lit(0.0))
    positive = F.coalesce(net_gex_pos, F.lit(True))
    return (
        F.when(positive & holds(close > pivot), fixed.MODE_FADE)
        .when(~positive & holds(close < pivot), fixed.MODE_FOLLOW)
        .otherwise(fixed.MODE_TRANSITION)
    )


def zg_distance(close: Column, zero_gamma: Column) -> Column:
    return F.when(is_active(zero_gamma), close - zero_gamma)


def mirror_target(close: Column, zero_gamma: Column) -> Column:
    """The close reflected at the pivot."""
    return F.when(is_active(zero_gamma), zero_gamma + (zero_gamma - close))


def net_gex_label(net_gex_pos: Column) -> Column:
    return F.when(net_gex_pos, fixed.NET_GEX_POSITIVE).otherwise(fixed.NET_GEX_NEGATIVE)


def max_change_bias(max_change: Column) -> Column:
    return (
        F.when(max_change == fixed.MAX_CHANGE_BULLISH, "bullish")
        .when(max_change == fixed.MAX_CHANGE_BEARISH, "bearish")
        .otherwise("neutral")
    )


def zg_text(close: Column, zero_gamma: Column) -> Column:
    """Pivot price with the signed distance, for the summary."""
    distance = F.concat(number_text(zg_distance(close, zero_gamma), fixed.FORMAT_SIGNED), F.lit(" pt"))
    return F.concat(
        number_text(F.coalesce(zero_gamma, F.lit(0.0)), fixed.FORMAT_PLAIN),
        F.lit("  ("),
        F.coalesce(distance, F.lit(fixed.TEXT_UNSET)),
        F.lit(")"),
    )


def mirror_text(close: Column, zero_gamma: Column) -> Column:
    return F.coalesce(
        number_text(mirror_target(close, zero_gamma), fixed.FORMAT_TWO_DECIMALS), F.lit(fixed.TEXT_UNSET)
    )
