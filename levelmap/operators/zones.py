"""Confluence zones and the bars that enter them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmap.functions import zones
from levelmap.operators.levels import sorted_levels_sql
from levelmap.schemas import SHEET_KEYS
from levelmap.sources.ticks import first_ticks_by_price


def with_zones(sheets: DataFrame) -> DataFrame:
    """Adds the sheet's zones as an array of structs (at most 12, as 25 levels pair up)."""
    return sheets.withColumn("zones", zones.zone_array(sorted_levels_sql()))


def each_zone(zoned: DataFrame, *keep: str) -> DataFrame:
    """Repeats each row for every zone of its sheet; rows without zones drop out."""
    return zoned.select(*keep, F.inline_outer("zones")).filter("zone_seq is not null")


def zone_rows(sheets: DataFrame) -> DataFrame:
    """One row per sheet and zone with bounds, stars and label."""
    rows = each_zone(with_zones(sheets), *SHEET_KEYS)
    return rows.withColumns(
        {
            "stars": zones.stars(F.col("n")),
            "label": zones.zone_label(F.col("n"), F.col("center"), F.col("sources")),
        }
    )


def zone_sides(sessions: DataFrame) -> DataFrame:
    """Session statistics joined with zoned sheets: each zone against the last close."""
    rows = each_zone(sessions, *SHEET_KEYS, "last_close")
    return rows.select(
        *SHEET_KEYS,
        "zone_seq",
        "center",
        "last_close",
        zones.zone_side(F.col("center"), F.col("last_close")).alias("side"),
    )


def count_above(close: str = "last_close") -> Column:
    """Zones centred above the close, from the array: no rows are made."""
    return F.size(F.filter("zones", lambda z: z["center"] > F.col(close)))


def count_below(close: str = "last_close") -> Column:
    return F.size(F.filter("zones", lambda z: z["center"] <= F.col(close)))


def zone_counts(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        *SHEET_KEYS, "last_close", count_above().alias("zones_above"), count_below().alias("zones_below")
    )


def _entry(kind) -> Column:
    return kind(F.col("prev_close"), F.col("close"), F.col("bot"), F.col("top"))


def zone_entries(context: DataFrame) -> DataFrame:
    """Bar context joined with zoned sheets: one row per bar and zone entered."""
    rows = each_zone(context, *SHEET_KEYS, "ts", "prev_close", "close")
    below, above = _entry(zones.entered_from_below), _entry(zones.entered_from_above)
    return rows.filter(below | above).select(
        *SHEET_KEYS,
        "ts",
        "zone_seq",
        F.when(below, "below").otherwise("above").alias("side"),
        "prev_close",
        "close",
        "bot",
        "top",
    )


def any_entry(kind) -> Column:
    """Does the bar enter at least one zone of its sheet in this direction?"""
    return F.exists("zones", lambda z: kind(F.col("prev_close"), F.col("close"), z["bot"], z["top"]))


def entry_flags(context: DataFrame) -> DataFrame:
    return context.select(
        *SHEET_KEYS,
        "ts",
        any_entry(zones.entered_from_below).alias("from_below"),
        any_entry(zones.entered_from_above).alias("from_above"),
    )


def touch_counts(sheets_with_zones: DataFrame, context: DataFrame) -> DataFrame:
    """Entries per zone over its session; zones never entered, or without bars, count 0.

    The join leaves rows spread by (symbol, session_date), which the grouping can use as is.
    """
    bars = sheets_with_zones.join(context, list(SHEET_KEYS), "left")
    rows = each_zone(bars, *SHEET_KEYS, "prev_close", "close")
    entered = _entry(zones.entered_from_below) | _entry(zones.entered_from_above)
    return rows.groupBy(*SHEET_KEYS, "zone_seq").agg(F.count_if(entered).alias("touches"))


def intrabar_entries(
    ticks: DataFrame, context: DataFrame, interval: str = "1 hour", tz: str = "UTC"
) -> DataFrame:
    """First tick of a bar inside a zone that the bar before closed outside of, per side.

    Ticks collapse to the first occurrence of each price in each bar before they move, so
    a crowded bar shuffles its distinct prices and not its ticks. Interval and time zone
    are those of the bars.
    """
    seen = first_ticks_by_price(ticks, interval, tz)
    return entries_of_first_ticks(seen, context, "symbol", "ts")


def entries_of_first_ticks(seen: DataFrame, context: DataFrame, *keys: str) -> DataFrame:
    """``intrabar_entries`` from the first tick of each price in each bar, joined on ``keys``.

    With the session among the keys, rows that come spread by it stay where they are.
    """
    outside = F.when(F.col("prev_close") < F.col("bot"), "below").when(F.col("prev_close") > F.col("top"), "above")
    bands = (
        each_zone(context, *SHEET_KEYS, "ts", "prev_close")
        .select(*SHEET_KEYS, "ts", outside.alias("side"), "bot", "top")
        .filter("side is not null")
    )
    hits = bands.join(seen.withColumnRenamed("bar", "ts"), list(keys)).filter("px between bot and top")
    first = hits.groupBy(*SHEET_KEYS, "ts", "side").agg(
        F.min("tick").alias("tick"), F.min_by("px", "tick").alias("px")
    )
    return first.select(
        *SHEET_KEYS, "ts", "side", F.col("tick.ts").alias("tick_ts"), F.col("tick.event_id").alias("event_id"), "px"
    )
