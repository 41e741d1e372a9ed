"""Confluence zones: clustering of one sheet's levels and the rules on a zone.

A sheet has at most 25 levels, so clustering is an expression on one row and needs no
shuffle however many sheets there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.functions.predicates import holds, number_text


def zone_anchors(levels: str, tol: str = "tol") -> str:
    """Start prices of the clusters: a level more than tol above the last anchor starts anew.

    ``levels`` names an array of structs with price and source, sorted by price.
    """
    return f"""aggregate({levels}, cast(array() as array<double>), (found, v) ->
              if(size(found) = 0 or v.price - try_element_at(found, -1) > {tol},
                 array_append(found, v.price), found))"""


def zone_array(levels: str, tol: str = "tol") -> Column:
    """Clusters of two or more levels as structs in price order.

    ``levels`` is an array of structs with price and source, sorted by price. The members of a
    cluster are the levels from its anchor up to tol above it, both inclusive. The center is the
    mean of the members.
    """
    members = f"transform({zone_anchors('l')}, a -> filter(l, v -> v.price >= a and v.price - a <= {tol}))"
    kept = f"filter({members}, m -> size(m) >= {fixed.MIN_CONFLUENCE})"
    measured = f"""transform({kept}, (m, i) -> struct(
        i + 1 as zone_seq,
        get(m, 0).price as start,
        aggregate(m, 0D, (total, v) -> total + v.price) / size(m) as center,
        size(m) as n,
        array_join(transform(m, v -> v.source), '{fixed.SOURCE_SEPARATOR}') as sources))"""
    found = f"""transform({measured}, z -> struct(
              z.zone_seq as zone_seq, z.start as start, z.center as center, z.n as n, z.sources as sources,
              z.center - {tol} / 2 as bot, z.center + {tol} / 2 as top))"""
    # The levels are worked out once and bound to a name, within an array of one.
    return F.expr(f"get(transform(array({levels}), l -> {found}), 0)")


def entered_from_below(prev_close: Column, price: Column, bot: Column, top: Column) -> Column:
    return holds((prev_close < bot) & price.between(bot, top))


def entered_from_above(prev_close: Column, price: Column, bot: Column, top: Column) -> Column:
    return holds((prev_close > top) & price.between(bot, top))


def zone_side(center: Column, close: Column) -> Column:
    """A zone centred on the close counts as below."""
    return F.when(center > close, "above").otherwise("below")


def stars(n: Column) -> Column:
    count = F.greatest(F.lit(1), F.least(n, F.lit(fixed.MAX_STARS)))
    return F.repeat(F.lit(fixed.STAR), count)


def zone_label(n: Column, center: Column, sources: Column) -> Column:
    return F.concat(
        stars(n), F.lit("  "), number_text(center, fixed.FORMAT_TWO_DECIMALS), F.lit("\n"), sources
    )
