"""Bar history: previous close, session extremes, session resets, last bar.

Windows over bars are keyed by (symbol, session_date), where a group holds no more bars
than fit in a day. What crosses sessions runs on a frame of one row per session. A long
history of one symbol is therefore never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_KEYS = ("symbol", "session_date")


def _history() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session_date")


def session_stats(bars: DataFrame) -> DataFrame:
    """One row per symbol and session: first and last bar time, last close, close extremes."""
    return bars.groupBy(*_KEYS).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("close", "ts").alias("last_close"),
        F.min("close").alias("low_close"),
        F.max("close").alias("high_close"),
    )


def bar_context(bars: DataFrame) -> DataFrame:
    """Each close with what the rules need to know of the past.

    prev_close is the close of the symbol's bar before, in whichever session that was.
    low_before and high_before are the extremes of this session's earlier closes.
    """
    closes = bars.select(*_KEYS, "ts", "close")
    carried = session_stats(closes).select(*_KEYS, F.lag("last_close").over(_history()).alias("carried_close"))
    in_session = Window.partitionBy(*_KEYS).orderBy("ts")
    earlier = in_session.rowsBetween(Window.unboundedPreceding, -1)
    within = closes.select(
        *_KEYS,
        "ts",
        "close",
        F.lag("close").over(in_session).alias("last_in_session"),
        F.min("close").over(earlier).alias("low_before"),
        F.max("close").over(earlier).alias("high_before"),
    )
    return within.join(carried, list(_KEYS), "left").select(
        *_KEYS,
        "ts",
        "close",
        F.coalesce("last_in_session", "carried_close").alias("prev_close"),
        "low_before",
        "high_before",
    )


def session_resets(bars: DataFrame) -> DataFrame:
    """New-session flag by day of month, and its running count per symbol.

    Only the first bar of a calendar day can differ in day of month from the bar before,
    so the flag and the count are settled per day and then handed to the bars.
    """
    day_no = F.dayofmonth("session_date")
    days = (
        session_stats(bars)
        .select("symbol", "session_date", "first_ts")
        .withColumn("turned", F.coalesce(day_no != F.lag(day_no).over(_history()), F.lit(True)))
        .withColumn(
            "session_seq",
            F.sum(F.col("turned").cast("int")).over(
                _history().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )
    return (
        bars.select(*_KEYS, "ts")
        .join(days, list(_KEYS))
        .select(
            "symbol",
            "ts",
            "session_date",
            (F.col("turned") & (F.col("ts") == F.col("first_ts"))).alias("is_new"),
            "session_seq",
        )
    )


def last_bar(bars: DataFrame) -> DataFrame:
    """The latest bar of each symbol and session. An aggregate, so nothing is sorted."""
    prices = ("open", "high", "low", "close", "ticks")
    return bars.groupBy(*_KEYS).agg(
        F.max("ts").alias("last_ts"), *[F.max_by(c, "ts").alias(c) for c in prices]
    ).withColumnRenamed("last_ts", "ts")
