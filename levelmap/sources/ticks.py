"""Price ticks and the bars built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmap.schemas import EVENT_SCHEMA

# Bits of a packed key, its sign left free, and the fewest of them worth packing ids into.
_KEY_BITS = 63
_LEAST_ID_BITS = 12
# A bar of local time lasts longer by what a clock is set back within it.
_SET_BACK = 3 * 3600 * 10**6
_MICROS = {
    "microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6,
    "day": 86400 * 10**6, "week": 7 * 86400 * 10**6,
}
_UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Reads an event table as price ticks on a quarter-point grid, one symbol per event type.

    Rows without a symbol, a time or a finite price are no ticks.
    """
    finite = events.filter(
        "event_type is not null and ts is not null and value > double('-infinity') and value < double('infinity')"
    )
    return finite.selectExpr("event_type as symbol", "ts", "event_id", "19000D + floor(value * 16) / 4 as px")


def read_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a folder's event table. The schema is given, so no file is opened to plan the read."""
    return ticks_from_events(spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def session_day(ts: Column, tz: str = "UTC") -> Column:
    """Calendar day of a UTC wall-clock time in the exchange's time zone."""
    if tz == "UTC":
        return F.to_date(ts)
    return F.to_date(local_time(ts, tz))


def local_time(ts: Column, tz: str) -> Column:
    """A UTC wall-clock time on the exchange's clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def utc_time(local: Column, tz: str) -> Column:
    """A time on the exchange's clock in UTC: the earlier one where the clock shows it twice."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local.cast("timestamp_ntz"))


def bar_start(interval: str, tz: str = "UTC") -> Column:
    """UTC start of the bar that a tick falls in. Bars are cut on the exchange's clock, hence none
    crosses its midnight unless it is longer than a day; an hour that the clock repeats is one hour."""
    if tz == "UTC":
        return F.window("ts", interval)["start"]
    return utc_time(F.window(local_time(F.col("ts"), tz), interval)["start"], tz)


def bars(
    ticks: DataFrame, interval: str = "1 hour", tz: str = "UTC", sequential_ids: bool = True
) -> DataFrame:
    """Tumbling bars. Open and close are the prices at the smallest and largest (ts, event_id).

    Ticks are reduced inside each scan task before anything moves, so a hot symbol costs no
    more than others. ``sequential_ids`` states that ids were handed out roughly in time
    order, as sequence numbers are. It changes speed only: see ``packed_order``.

    Bars come out spread by (symbol, session_date), the key of every later window, join and
    session aggregate, which then need no shuffle of their own. Such a group holds at most
    one day of bars.
    """
    session = session_day(F.col("bar"), tz).alias("session_date")
    bits = _id_bits(interval) if sequential_ids and in_utc(ticks.sparkSession) else None
    if bits:
        rows, keys, order = packed_order(ticks, interval, tz, bits), ["symbol", "bar", "id_block"], F.col("tick_key")
        first, last = packed_position("first_key", bits), packed_position("last_key", bits)
    else:
        rows = ticks.withColumn("bar", bar_start(interval, tz))
        keys, order = ["symbol", "bar"], F.struct("ts", "event_id")
        first, last = F.col("first_key"), F.col("last_key")
    parts = rows.groupBy(*keys).agg(
        F.min(order).alias("first_key"),
        F.max(order).alias("last_key"),
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        F.count(F.lit(1)).alias("ticks"),
    )
    # No session_date is NULL. Saying so here keeps a join from adding that test to one of two
    # uses of the bars, which would make their tick scans differ and so be run twice.
    spread = parts.select("*", session).filter("session_date is not null").repartition("symbol", "session_date")
    return spread.groupBy("symbol", "session_date", F.col("bar").alias("ts")).agg(
        F.min_by("open", first).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", last).alias("close"),
        F.sum("ticks").alias("ticks"),
    )


def _id_bits(interval: str) -> int | None:
    """Bits left for ids beside offsets into a bar of this length; None where too few are left, or
    where the interval is written in another way than as numbers and units."""
    parts = re.findall(r"(\d+)\s+([a-z]+?)s?(?![a-z])", interval.strip().lower())
    if not parts or any(unit not in _MICROS for _, unit in parts) or re.sub(r"\d+\s+[a-z]+", "", interval.lower()).strip():
        return None
    longest = sum(int(n) * _MICROS[unit] for n, unit in parts) + _SET_BACK
    bits = _KEY_BITS - longest.bit_length()
    return bits if bits >= _LEAST_ID_BITS else None


def packed_order(ticks: DataFrame, interval: str, tz: str, bits: int) -> DataFrame:
    """Ticks with their bar and their place in it as one long per block of ids.

    Spark aggregates by hashing only while its buffers are of fixed width. An extremum over
    the pair (ts, event_id) is not, and would sort all ticks. Within a block of 2**bits ids
    the offset into the bar followed by the low id bits sorts exactly like the pair, so
    blocks are reduced by hashing and the few results per bar are merged by the full pair.
    ``bits`` are what the interval's offsets leave of a long.
    """
    spans = ticks.select("symbol", "px", "ts", "event_id", bar_start(interval, tz).alias("bar"))
    offset = "unix_micros(timestamp(ts)) - unix_micros(timestamp(bar))"
    return spans.selectExpr(
        "symbol",
        "px",
        "bar",
        f"shiftright(event_id, {bits}) as id_block",
        f"shiftleft({offset}, {bits}) | (event_id & {(1 << bits) - 1}) as tick_key",
    )


def packed_position(key: str, bits: int) -> Column:
    """The pair (offset, id) of a packed key in sortable form."""
    return F.expr(f"struct(shiftright({key}, {bits}), id_block, {key})")


def unpacked(key: str, bits: int) -> tuple[Column, Column]:
    """Tick time and event id of a packed key."""
    return (
        F.expr(f"timestampadd(microsecond, shiftright({key}, {bits}), bar)"),
        F.expr(f"shiftleft(id_block, {bits}) | ({key} & {(1 << bits) - 1})"),
    )


def first_ticks_by_price(
    ticks: DataFrame, interval: str = "1 hour", tz: str = "UTC", sequential_ids: bool = True
) -> DataFrame:
    """First (ts, event_id) of each price in each bar; several rows per price where ids span blocks."""
    bits = _id_bits(interval) if sequential_ids and in_utc(ticks.sparkSession) else None
    if bits:
        first = packed_order(ticks, interval, tz, bits).groupBy("symbol", "bar", "id_block", "px").agg(
            F.min("tick_key").alias("first_key")
        )
        ts, event_id = unpacked("first_key", bits)
        return first.select("symbol", "bar", "px", F.struct(ts.alias("ts"), event_id.alias("event_id")).alias("tick"))
    spans = ticks.withColumn("bar", bar_start(interval, tz))
    return spans.groupBy("symbol", "bar", "px").agg(F.min(F.struct("ts", "event_id")).alias("tick"))


def price_cells(ticks: DataFrame, interval: str = "1 hour", tz: str = "UTC") -> DataFrame:
    """Ticks reduced once for all that is made of them: (symbol, session_date, px, cell), one row per price and
    bar (and block of ids), spread by session as bars are.

    ``cell`` holds the bar's start, time and id of the first and of the last tick at that price, and the
    number of ticks, times in microseconds. As one array it stays whole through the planner, which else
    drops a field for one use and another for the next: this way all uses share one scan and one exchange.
    """
    if not in_utc(ticks.sparkSession):
        raise ValueError("set spark.sql.session.timeZone to UTC: elsewhere wall clocks jump")
    bits = _id_bits(interval)
    bar = "unix_micros(timestamp(bar))"
    if bits:
        reduced = packed_order(ticks, interval, tz, bits).groupBy("symbol", "bar", "id_block", "px").agg(
            F.min("tick_key").alias("first"), F.max("tick_key").alias("last"), F.count(F.lit(1)).alias("n")
        )
        ends = [
            part
            for key in ("first", "last")
            for part in (f"{bar} + shiftright({key}, {bits})", f"shiftleft(id_block, {bits}) | ({key} & {(1 << bits) - 1})")
        ]
    else:
        pair = F.struct(F.expr("unix_micros(timestamp(ts))").alias("ts"), F.col("event_id").alias("id"))
        reduced = ticks.withColumn("bar", bar_start(interval, tz)).groupBy("symbol", "bar", "px").agg(
            F.min(pair).alias("first"), F.max(pair).alias("last"), F.count(F.lit(1)).alias("n")
        )
        ends = ["first.ts", "first.id", "last.ts", "last.id"]
    cells = reduced.select(
        "symbol", session_day(F.col("bar"), tz).alias("session_date"), "px", F.expr(f"array({bar}, {', '.join(ends)}, n)").alias("cell")
    )
    # All tests for null that joins add to one of the uses are said here, for all of them.
    said = " and ".join(f"{c} is not null" for c in ("session_date", "date_add(session_date, 1)", "px", _moment(0)))
    return cells.filter(said).repartition("symbol", "session_date")


def _moment(at: int) -> str:
    return f"cast(timestamp_micros(cell[{at}]) as timestamp_ntz)"


def place(micros: str, event_id: str) -> str:
    """Time and id of a tick as one number, which sorts like the pair. Unlike a pair it is of fixed width,
    so that extrema by it are taken by hashing; a missing id comes first."""
    return f"cast({micros} as decimal(20)) * 18446744073709551616 + cast(coalesce({event_id}, {-(1 << 63) + 1}) as decimal(20))"


def _place(at: int) -> str:
    return place(f"cell[{at}]", f"cell[{at + 1}]")


def bar_end(interval: str, tz: str = "UTC", ts: str = "ts") -> Column:
    """UTC end of the bar that starts at ``ts``."""
    span = F.expr(f"interval {interval}")
    if tz == "UTC":
        return F.col(ts) + span
    return utc_time(local_time(F.col(ts), tz) + span, tz)


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells of the same price and bar as one."""
    grouped = cells.selectExpr("symbol", "session_date", "px", "cell[0] as bar", "cell").groupBy("symbol", "session_date", "px", "bar")
    merged = grouped.agg(
        F.expr("min(struct(cell[1] as ts, cell[2] as id))").alias("first"),
        F.expr("max(struct(cell[3] as ts, cell[4] as id))").alias("last"),
        F.expr("sum(cell[5])").alias("n"),
    )
    return merged.selectExpr("symbol", "session_date", "px", "array(bar, first.ts, first.id, last.ts, last.id, n) as cell")


def bars_of_cells(cells: DataFrame) -> DataFrame:
    """``bars`` of the ticks that the cells came from."""
    parts = cells.selectExpr(
        "symbol", "session_date", "px", f"{_moment(0)} as ts", f"{_place(1)} as first", f"{_place(3)} as last", "cell[5] as n"
    )
    return parts.groupBy("symbol", "session_date", "ts").agg(
        F.min_by("px", "first").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "last").alias("close"),
        F.sum("n").alias("ticks"),
    )


def first_ticks_of_cells(cells: DataFrame) -> DataFrame:
    """``first_ticks_by_price`` of the ticks that the cells came from, with their session."""
    return cells.selectExpr(
        "symbol", "session_date", f"{_moment(0)} as bar", "px", f"struct({_moment(1)} as ts, cell[2] as event_id) as tick"
    )


def histogram_of_cells(cells: DataFrame) -> DataFrame:
    """Number of ticks at each price of a session."""
    return cells.groupBy("symbol", F.col("session_date").alias("day"), "px").agg(F.sum(F.col("cell")[5]).alias("weight"))


def in_utc(spark: SparkSession) -> bool:
    """Offsets are exact only where wall clocks never jump."""
    return spark.conf.get("spark.sql.session.timeZone") in _UTC_NAMES
