"""Flip state of the eight sized nodes.

A node is flipped once some close of the session lay beyond it, so its state follows from
the session's close extremes. Those are computed once per bar for all nodes together, and
nodes are unpivoted only afterwards, in a narrow step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmap.functions import nodes
from levelmap.functions.predicates import is_active
from levelmap.schemas import NODES


def node_array() -> Column:
    """The sheet row's nodes as an array of structs."""
    entries = [
        f"struct({s.slot} as slot, {s.family == 'green'} as green, "
        f"{s.price_col} as price, {s.size_col} as size_m)"
        for s in NODES
    ]
    return F.expr("array(" + ", ".join(entries) + ")")


def with_nodes(rows: DataFrame, *keep: str) -> DataFrame:
    """Repeats each row for every active node of its sheet."""
    return rows.select(*keep, F.inline(node_array())).filter(is_active(F.col("price")))


def _broken(low: str, high: str) -> Column:
    return nodes.breaks(F.col("green"), F.col("price"), F.col("buf"), F.col(low), F.col(high))


def node_breaks(bars: DataFrame) -> DataFrame:
    """Bars joined with their sheet: is this bar's close beyond the node?"""
    rows = with_nodes(bars, "symbol", "session_date", "ts", "close", "buf")
    return rows.select(
        "symbol", "session_date", "ts", "slot", "close", "price", _broken("close", "close").alias("is_break")
    )


def flip_states(context: DataFrame) -> DataFrame:
    """Bar context joined with the sheet: latched flip state after each bar."""
    extremes = context.withColumns(
        {"low_now": F.least("low_before", "close"), "high_now": F.greatest("high_before", "close")}
    )
    rows = with_nodes(extremes, "symbol", "session_date", "ts", "buf", "low_now", "high_now")
    return rows.select(
        "symbol", "session_date", "ts", "slot", "price", _broken("low_now", "high_now").alias("flipped")
    )


def flip_events(context: DataFrame) -> DataFrame:
    """The bar on which each node turned flipped: at most one per session and node."""
    rows = with_nodes(context, "symbol", "session_date", "ts", "close", "buf", "low_before", "high_before")
    return rows.filter(_broken("close", "close") & ~_broken("low_before", "high_before")).select(
        "symbol", "session_date", "slot", F.col("ts").alias("flip_ts"), "close", "price"
    )


def any_flip() -> Column:
    """True on a bar (context joined with the sheet) where at least one node turns flipped."""

    def turns(node: Column) -> Column:
        def broken(low: str, high: str) -> Column:
            return nodes.breaks(node["green"], node["price"], F.col("buf"), F.col(low), F.col(high))

        return broken("close", "close") & ~broken("low_before", "high_before")

    return F.exists(node_array(), turns)


def node_states(sessions: DataFrame) -> DataFrame:
    """Session statistics joined with the sheet: state, role, size class and label at the last bar."""
    rows = with_nodes(sessions, "symbol", "session_date", "buf", "low_close", "high_close")
    flipped = rows.withColumn("flipped", _broken("low_close", "high_close"))
    return flipped.select(
        "symbol",
        "session_date",
        "slot",
        "price",
        "size_m",
        "flipped",
        nodes.role(F.col("green"), F.col("flipped")).alias("role"),
        nodes.size_class(F.col("size_m")).alias("width"),
        nodes.node_label(F.col("slot"), F.col("green"), F.col("size_m"), F.col("flipped")).alias("label"),
    )
