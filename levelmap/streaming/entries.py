"""Zone entries of the forming bar, raised as its ticks arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from levelmap.operators import joins, zones
from levelmap.operators.sessions import bar_context
from levelmap.schemas import SHEET_KEYS
from levelmap.sources.ticks import bar_start, session_day
from levelmap.streaming.context import Turns
from levelmap.streaming.sinks import SheetLoader, start_batches, zoned_sheets

OPEN_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("close", T.DoubleType()),
        T.StructField(
            "last",
            T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType())]),
        ),
        T.StructField("below", T.BooleanType()),
        T.StructField("above", T.BooleanType()),
    ]
)


def open_bars(ticks: DataFrame, before: DataFrame, tz: str) -> DataFrame:
    """The bars known before, brought up to date by these ticks (with their ``bar``)."""
    order = F.struct("ts", "event_id")
    fresh = ticks.groupBy("symbol", "bar").agg(F.max_by("px", order).alias("close"), F.max(order).alias("last"))
    fresh = fresh.select(
        "symbol",
        session_day(F.col("bar"), tz).alias("session_date"),
        F.col("bar").alias("ts"),
        "close",
        "last",
        F.lit(False).alias("below"),
        F.lit(False).alias("above"),
    )
    return (
        fresh.unionByName(before)
        .groupBy(*SHEET_KEYS, "ts")
        .agg(
            F.max_by("close", "last").alias("close"),
            F.max("last").alias("last"),
            F.bool_or("below").alias("below"),
            F.bool_or("above").alias("above"),
        )
    )


def sides_entered(bars: DataFrame) -> DataFrame:
    """(symbol, ts, side) for which a bar has raised its entry."""
    sides = F.array(*[F.struct(F.col(s).alias("fired"), F.lit(s).alias("side")) for s in ("below", "above")])
    return bars.select("symbol", "ts", F.inline(sides)).filter("fired").drop("fired")


def start_entries(
    ticks: DataFrame,
    load_sheets: SheetLoader,
    out: str,
    checkpoint: str,
    delay: str,
    interval: str = "1 hour",
    tz: str = "UTC",
    **options,
) -> StreamingQuery:
    """Writes the first tick of a bar inside a zone that the bar before closed outside of, once
    per bar and side, as soon as it arrives.

    Between batches stand the bars that ended within ``delay`` of the latest tick and, per
    symbol, the one before them. Ticks of older bars are passed over. The close held against
    a zone is the one known so far; a tick that comes later but belongs before it changes no
    entry already raised.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        state = Turns(batch.sparkSession, f"{checkpoint}/open", OPEN_SCHEMA)
        merged = Turns(batch.sparkSession, f"{checkpoint}/merged", OPEN_SCHEMA)
        before = state.before(batch_id)
        oldest = before.groupBy("symbol").agg(F.min("ts").alias("oldest"))
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        current = (
            timed.withColumn("bar", bar_start(interval, tz))
            .join(oldest, "symbol", "left")
            .filter("oldest is null or bar >= oldest")
            .drop("oldest")
        )
        bars = merged.put(open_bars(current, before, tz), batch_id)
        context = bar_context(bars)
        zoned = joins.by_session(context, zoned_sheets(bars, load_sheets))
        entries = zones.intrabar_entries(current.drop("bar"), zoned, interval, tz)
        folder = f"{out}/batch_id={batch_id}"
        entries.join(sides_entered(bars), ["symbol", "ts", "side"], "left_anti").write.mode("overwrite").parquet(folder)
        raised = (
            batch.sparkSession.read.schema(entries.schema)
            .parquet(folder)
            .groupBy("symbol", "ts")
            .agg(F.bool_or(F.col("side") == "below").alias("now_below"), F.bool_or(F.col("side") == "above").alias("now_above"))
        )
        latest = bars.agg(F.max("last.ts")).first()[0]
        is_open = F.col("ts") + F.expr(f"interval {interval}") > F.lit(latest) - F.expr(f"interval {delay}")
        newest = bars.filter(~is_open).groupBy("symbol").agg(F.max("ts").alias("newest"))
        left = bars.join(newest, "symbol", "left").filter(is_open | (F.col("ts") == F.col("newest")))
        state.put(
            left.join(raised, ["symbol", "ts"], "left")
            .withColumn("below", F.col("below") | F.coalesce("now_below", F.lit(False)))
            .withColumn("above", F.col("above") | F.coalesce("now_above", F.lit(False))),
            batch_id,
        )

    return start_batches(ticks, write, checkpoint, **options)
