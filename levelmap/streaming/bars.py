"""Bars of a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from levelmap.operators.snapshot import snapshot
from levelmap.schemas import EVENT_SCHEMA
from levelmap.sources.ticks import local_time, place, ticks_from_events, utc_time


def read_tick_stream(
    spark: SparkSession, folder: str, pattern: str = "events*.parquet", max_files: int | None = None
) -> DataFrame:
    """Ticks from event files as they arrive in a folder.

    Watermarks need a timestamp with time zone semantics, hence the cast. Files should
    arrive in time order: ticks older than the watermark are dropped.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ticks = ticks_from_events(reader.parquet(folder))
    return ticks.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, delay: str, interval: str = "1 hour", tz: str = "UTC") -> DataFrame:
    """Bars of a stream, cut on the exchange's clock like those of a batch.

    In append mode a bar comes out once the watermark has passed its end: it is confirmed
    and final. In update mode the forming bar comes out whenever it changes.

    Time and id of a tick are one number here, so ticks are reduced by hashing before they reach the state.

    The watermark trails the latest tick of any symbol by ``delay`` and older ticks are dropped,
    so the delay must cover how far one feed may run behind another, and, where clocks are
    set back, that hour as well. ``dropped_ticks`` counts what was lost.
    """
    order = F.expr(place("unix_micros(ts)", "event_id"))
    clock = F.col("ts") if tz == "UTC" else local_time(F.col("ts"), tz).cast("timestamp")
    timed = ticks.withColumn("clock", clock).withWatermark("clock", delay)
    grouped = timed.groupBy("symbol", F.window("clock", interval).alias("span"))
    start = F.col("span.start") if tz == "UTC" else utc_time(F.col("span.start"), tz).cast("timestamp")
    return grouped.agg(
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        F.count(F.lit(1)).alias("ticks"),
    ).select(
        "symbol",
        start.alias("ts"),
        F.to_date("span.start").alias("session_date"),
        "open",
        "high",
        "low",
        "close",
        "ticks",
    )


def dropped_ticks(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the query's recent progress. They are
    counted after reduction within a batch, so that one may stand for several ticks of a bar."""
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    return sum(o["numRowsDroppedByWatermark"] for o in operators)


def forming_view(bars: DataFrame, zoned_sheets: DataFrame) -> DataFrame:
    """The summary of each bar as it stands, confirmed or not. Stateless, for update mode."""
    joined = bars.join(zoned_sheets, ["symbol", "session_date"])
    return snapshot(joined.withColumnsRenamed({"ts": "last_ts", "close": "last_close"}))
