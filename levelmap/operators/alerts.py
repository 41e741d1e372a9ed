"""The five alerts, evaluated together on each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmap import fixed
from levelmap.functions import pin, zones
from levelmap.operators.nodes import any_flip
from levelmap.operators.zones import any_entry
from levelmap.schemas import SHEET_KEYS


ALERT_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("session_date", T.DateType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(n, T.DoubleType() if n == "close" else T.StringType()) for n in ("kind", "bias", "close", "title", "message")]
)


FEED_SCHEMA = T.StructType(
    [*ALERT_SCHEMA.fields[:6], T.StructField("tick_ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()), *ALERT_SCHEMA.fields[6:]]
)


def alerts(context: DataFrame, brand: str = fixed.DEFAULT_BRAND) -> DataFrame:
    """One row per bar and alert raised, from bar context joined with zoned sheets.

    All five conditions are read off the same row and unpivoted, so history is walked once
    and not once per alert. Works alike on a batch and on a stream of contexts.
    """
    close, buf = F.col("close"), F.col("buf")
    conditions = (
        any_entry(zones.entered_from_below),
        any_entry(zones.entered_from_above),
        any_flip(),
        pin.breaks_up(close, F.col("mq_cr0"), buf),
        pin.breaks_down(close, F.col("mq_ps0"), buf),
    )
    raised = F.array(
        *[
            F.struct(
                fired.alias("fired"),
                F.lit(kind).alias("kind"),
                F.lit(bias).alias("bias"),
                F.lit(title.format(brand=brand)).alias("title"),
                F.lit(message.format(brand=brand)).alias("message"),
            )
            for fired, (kind, bias, title, message) in zip(conditions, fixed.ALERTS)
        ]
    )
    rows = context.select(*SHEET_KEYS, "ts", "close", F.inline(raised)).filter("fired")
    return rows.select(*SHEET_KEYS, "ts", "kind", "bias", "close", "title", "message")


def alert_feed(context: DataFrame, entries: DataFrame, brand: str = fixed.DEFAULT_BRAND) -> DataFrame:
    """The alerts of closed bars and the zone entries of forming ones as one table of events.

    ``entries`` are intrabar entries, at most one for each bar and side; their kinds are those of the
    entry alerts with INTRABAR before, and they carry the tick that raised them. ``close`` is the price
    at which an event was raised.
    """
    return closed_events(context, brand).unionByName(intrabar_events(entries, brand))


def closed_events(context: DataFrame, brand: str = fixed.DEFAULT_BRAND) -> DataFrame:
    return alerts(context, brand).select(
        *SHEET_KEYS, "ts", "kind", "bias", "close", F.lit(None).cast("timestamp_ntz").alias("tick_ts"),
        F.lit(None).cast("long").alias("event_id"), "title", "message",
    )


INTRABAR = "intrabar_"


def intrabar_events(entries: DataFrame, brand: str = fixed.DEFAULT_BRAND) -> DataFrame:
    texts = {kind: (bias, title.format(brand=brand), message.format(brand=brand)) for kind, bias, title, message in fixed.ALERTS}
    below, above = texts["zone_entry_below"], texts["zone_entry_above"]
    of_side = [F.when(F.col("side") == "below", low).otherwise(high) for low, high in zip(below, above)]
    return entries.select(
        *SHEET_KEYS, "ts", F.concat(F.lit(f"{INTRABAR}zone_entry_"), "side").alias("kind"), of_side[0].alias("bias"),
        F.col("px").alias("close"), "tick_ts", "event_id", of_side[1].alias("title"), of_side[2].alias("message"),
    )
