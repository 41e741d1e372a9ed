"""Named queries: each takes a session and a folder with an events table.

Bars and sheets are derived from the ticks of that table, so the work of every query grows
with it. A deployment would write both once (``levelmap.sources.sinks``) and start from
the tables; the operators are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from levelmap.functions import regime
from levelmap.operators import alerts, joins, levels, nodes, pin, sessions, snapshot, zones
from levelmap.schemas import BAR_SCHEMA, EVENT_SCHEMA
from levelmap.sources.sheets import sheets_from_histogram, sheets_from_ticks, stored_sheets, with_defaults
from levelmap.sources.sinks import write_by_session
from levelmap.sources.ticks import bars, bars_of_cells, first_ticks_of_cells, histogram_of_cells, price_cells, read_ticks
from levelmap.streaming import bars as stream
from levelmap.streaming import entries, live, sinks

# The whole table is one batch of the streams here, so no tick can come late.
NO_DELAY = "0 seconds"

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """Ticks of a folder with the bars, sheets and joins the queries share, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def ticks(self) -> DataFrame:
        return read_ticks(self.spark, self.sf_dir)

    @cached_property
    def bars(self) -> DataFrame:
        return bars(self.ticks)

    @cached_property
    def bar_context(self) -> DataFrame:
        return sessions.bar_context(self.bars)

    @cached_property
    def sheets(self) -> DataFrame:
        return with_defaults(sheets_from_ticks(self.ticks))

    @cached_property
    def zoned(self) -> DataFrame:
        return zones.with_zones(self.sheets)

    @cached_property
    def bars_with_sheet(self) -> DataFrame:
        return joins.by_session(self.bars, self.sheets)

    @cached_property
    def context(self) -> DataFrame:
        return joins.by_session(self.bar_context, self.sheets)

    @cached_property
    def zoned_context(self) -> DataFrame:
        return joins.by_session(self.bar_context, self.zoned)

    @cached_property
    def session_sheets(self) -> DataFrame:
        return joins.by_session(sessions.session_stats(self.bars), self.sheets)

    @cached_property
    def sessions(self) -> DataFrame:
        return joins.by_session(sessions.session_stats(self.bars), self.zoned)


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def _query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Registers a query under its function's name, less a trailing underscore."""
    _QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def queries() -> dict[str, Query]:
    def bind(fn: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


# --- sources ------------------------------------------------------------------


@_query
def bars_1h(i: Inputs) -> DataFrame:
    return i.bars.select(*BAR_SCHEMA.names)


@_query
def bars_local(i: Inputs) -> DataFrame:
    return bars(i.ticks, "1 day", "America/New_York").select(*BAR_SCHEMA.names)


@_query
def sheet_defaults(i: Inputs) -> DataFrame:
    return i.sheets


# --- joins of bars and sheets -------------------------------------------------

_SHEET_FIELDS = ("net_gex_pos", "zero_gamma", "max_change", "mq_cr0", "mq_ps0")


def _joined(df: DataFrame) -> DataFrame:
    return df.select("symbol", "ts", "session_date", "sheet_date", "close", *_SHEET_FIELDS)


@_query
def sheet_static(i: Inputs) -> DataFrame:
    return _joined(joins.static(i.bars, i.sheets))


@_query
def sheet_by_session(i: Inputs) -> DataFrame:
    return _joined(i.bars_with_sheet.withColumn("sheet_date", F.col("session_date")))


@_query
def sheet_asof(i: Inputs) -> DataFrame:
    return _joined(joins.as_of(i.bars, i.sheets))


# --- levels -------------------------------------------------------------------


@_query
def level_unpivot(i: Inputs) -> DataFrame:
    return levels.level_rows(i.sheets)


@_query
def active_levels(i: Inputs) -> DataFrame:
    return levels.active_levels(i.sheets)


@_query
def level_order(i: Inputs) -> DataFrame:
    return levels.level_order(i.sheets)


# --- regime -------------------------------------------------------------------


@_query
def regime_mode(i: Inputs) -> DataFrame:
    mode = regime.regime_mode(F.col("net_gex_pos"), F.col("close"), F.col("zero_gamma"))
    return i.bars_with_sheet.select(
        "symbol", "ts", "session_date", "close", "net_gex_pos", "zero_gamma", mode.alias("mode")
    )


@_query
def zg_distance(i: Inputs) -> DataFrame:
    distance = regime.zg_distance(F.col("close"), F.col("zero_gamma"))
    return i.bars_with_sheet.select(
        "symbol", "ts", "session_date", "close", "zero_gamma", distance.alias("zg_distance")
    )


@_query
def mirror_target(i: Inputs) -> DataFrame:
    target = regime.mirror_target(F.col("close"), F.col("zero_gamma"))
    return i.bars_with_sheet.select(
        "symbol", "ts", "session_date", "close", "zero_gamma", target.alias("mirror_target")
    )


@_query
def max_change_bias(i: Inputs) -> DataFrame:
    bias = regime.max_change_bias(F.col("max_change"))
    return i.sheets.select("symbol", "session_date", "max_change", bias.alias("bias"))


# --- bar history --------------------------------------------------------------


@_query
def prev_close(i: Inputs) -> DataFrame:
    return i.bar_context.select("symbol", "ts", "session_date", "close", "prev_close")


@_query
def session_reset_dom(i: Inputs) -> DataFrame:
    return sessions.session_resets(i.bars)


@_query
def last_bar(i: Inputs) -> DataFrame:
    return sessions.last_bar(i.bars)


# --- nodes --------------------------------------------------------------------


@_query
def node_break(i: Inputs) -> DataFrame:
    return nodes.node_breaks(i.bars_with_sheet)


@_query
def node_flip_state(i: Inputs) -> DataFrame:
    return nodes.flip_states(i.context)


@_query
def node_flip_event(i: Inputs) -> DataFrame:
    return nodes.flip_events(i.context)


@_query
def any_flip(i: Inputs) -> DataFrame:
    return i.context.select("symbol", "session_date", "ts", nodes.any_flip().alias("any_flip"))


@_query
def node_width(i: Inputs) -> DataFrame:
    return nodes.node_states(i.session_sheets).select("symbol", "session_date", "slot", "size_m", "width")


@_query
def node_role(i: Inputs) -> DataFrame:
    return nodes.node_states(i.session_sheets).select("symbol", "session_date", "slot", "flipped", "role")


@_query
def node_label(i: Inputs) -> DataFrame:
    return nodes.node_states(i.session_sheets).select("symbol", "session_date", "slot", "price", "label")


# --- zones --------------------------------------------------------------------


def _zone_columns(i: Inputs, *columns: str) -> DataFrame:
    return zones.zone_rows(i.sheets).select("symbol", "session_date", "zone_seq", *columns)


@_query
def zone_clusters(i: Inputs) -> DataFrame:
    return _zone_columns(i, "start", "center", "n", "sources")


@_query
def zone_bounds(i: Inputs) -> DataFrame:
    return _zone_columns(i, "center", "bot", "top")


@_query
def zone_stars(i: Inputs) -> DataFrame:
    return _zone_columns(i, "n", "stars")


@_query
def zone_label(i: Inputs) -> DataFrame:
    return _zone_columns(i, "label")


@_query
def zone_side(i: Inputs) -> DataFrame:
    return zones.zone_sides(i.sessions)


@_query
def zone_counts(i: Inputs) -> DataFrame:
    return zones.zone_counts(i.sessions)


@_query
def zone_entry(i: Inputs) -> DataFrame:
    return zones.zone_entries(i.zoned_context)


@_query
def zone_entry_any(i: Inputs) -> DataFrame:
    return zones.entry_flags(i.zoned_context)


@_query
def zone_entry_intrabar(i: Inputs) -> DataFrame:
    # Bars, sheets and entries all come from one reduction of the ticks.
    cells = price_cells(i.ticks)
    sheets = zones.with_zones(with_defaults(sheets_from_histogram(histogram_of_cells(cells))))
    context = joins.by_session(sessions.bar_context(bars_of_cells(cells)), sheets)
    return zones.entries_of_first_ticks(first_ticks_of_cells(cells), context, "symbol", "session_date", "ts")


@_query
def zone_touch_count(i: Inputs) -> DataFrame:
    return zones.touch_counts(i.zoned, i.bar_context)


# --- pin ----------------------------------------------------------------------


@_query
def pin_box(i: Inputs) -> DataFrame:
    return pin.pin_boxes(i.sheets).select("symbol", "session_date", "mq_ps0", "mq_cr0", "width", "mid")


@_query
def pin_class(i: Inputs) -> DataFrame:
    return pin.pin_boxes(i.sheets).select("symbol", "session_date", "width", "pin_class")


@_query
def pin_text(i: Inputs) -> DataFrame:
    return pin.pin_texts(i.sheets)


@_query
def pin_break(i: Inputs) -> DataFrame:
    return pin.pin_breaks(i.bars_with_sheet)


# --- outputs ------------------------------------------------------------------


@_query
def alerts_(i: Inputs) -> DataFrame:
    return alerts.alerts(i.zoned_context)


@_query
def snapshot_(i: Inputs) -> DataFrame:
    return snapshot.snapshot(i.sessions)


@_query
def snapshot_rows(i: Inputs) -> DataFrame:
    return snapshot.summary_rows(i.sessions)


@_query
def annotations(i: Inputs) -> DataFrame:
    return snapshot.annotations(i.sessions)


# --- streams, run to the end of the data on disk ------------------------------


def _run_out(
    i: Inputs,
    df: DataFrame,
    start: Callable[..., StreamingQuery],
    sheets: bool = True,
    read: Callable[[str], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Runs a stream to its end, against sheets published beforehand if it takes any."""
    folder = sinks.shared_folder(i.spark)
    options |= {"out": f"{folder}/out", "checkpoint": f"{folder}/cp", "partitions": i.spark.sparkContext.defaultParallelism}
    if sheets:
        write_by_session(sheets_from_ticks(i.ticks), f"{folder}/sheets")
        options["load_sheets"] = stored_sheets(i.spark, f"{folder}/sheets")
    start(df, availableNow=True, **options).awaitTermination()
    done = read(f"{folder}/out") if read else i.spark.read.parquet(f"{folder}/out")
    # Streams carry zoned timestamps, batch queries and tables wall-clock ones.
    return done.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in done.columns else done


def _live_ticks(i: Inputs) -> DataFrame:
    return stream.read_tick_stream(i.spark, i.sf_dir)


@_query
def stream_bars(i: Inputs) -> DataFrame:
    confirmed = stream.stream_bars(_live_ticks(i), delay=NO_DELAY)
    return _run_out(i, confirmed, sinks.start_table, sheets=False).select(*BAR_SCHEMA.names)


@_query
def stream_alerts(i: Inputs) -> DataFrame:
    confirmed = stream.stream_bars(_live_ticks(i), delay=NO_DELAY)
    return _run_out(i, confirmed, sinks.start_alerts).drop("batch_id")


@_query
def stream_forming(i: Inputs) -> DataFrame:
    forming = stream.stream_bars(_live_ticks(i), delay=NO_DELAY)
    schema = stream.forming_view(forming, i.zoned).schema
    return _run_out(i, forming, sinks.start_summary, read=lambda out: sinks.live_summary(i.spark, out, schema))


@_query
def stream_zone_entry(i: Inputs) -> DataFrame:
    return _run_out(i, _live_ticks(i), entries.start_entries, delay=NO_DELAY).drop("batch_id")


# --- one live query: alert feed, touch counts, sheets carried on, late ticks stated again ---------------


def _fed(i: Inputs, name: str, **options) -> DataFrame:
    """One table of a live query that has read all events."""

    def table(out: str) -> DataFrame:
        if name == "touches":
            return live.DayTables(i.spark, f"{out}/live").read("touches", live.TOUCH_SCHEMA)
        return i.spark.read.parquet(f"{out}/{name}").drop("batch_id")

    return _run_out(i, _live_ticks(i), live.start_feed, read=table, delay=NO_DELAY, **options)


@_query
def stream_alert_feed(i: Inputs) -> DataFrame:
    return _fed(i, "feed")


@_query
def stream_touch_count(i: Inputs) -> DataFrame:
    return _fed(i, "touches")


@_query
def stream_alerts_asof(i: Inputs) -> DataFrame:
    """Sheets are entered on every third day only; the days between have the last one."""
    folder = sinks.shared_folder(i.spark)
    write_by_session(sheets_from_ticks(i.ticks).filter("dayofmonth(session_date) % 3 = 1"), f"{folder}/sheets")
    return _fed(i, "feed", sheets=False, load_sheets=stored_sheets(i.spark, f"{folder}/sheets"), as_of=True)


@_query
def alert_feed(i: Inputs) -> DataFrame:
    cells = price_cells(i.ticks)
    sheets = zones.with_zones(with_defaults(sheets_from_histogram(histogram_of_cells(cells))))
    context = joins.by_session(sessions.bar_context(bars_of_cells(cells)), sheets)
    found = zones.entries_of_first_ticks(first_ticks_of_cells(cells), context, "symbol", "session_date", "ts")
    return alerts.alert_feed(context, found)


@_query
def stream_restated(i: Inputs) -> DataFrame:
    """The feed as published after one symbol's ticks of four sessions came in after all others."""
    folder = sinks.shared_folder(i.spark)
    write_by_session(sheets_from_ticks(i.ticks), f"{folder}/out/sheets")
    symbol = i.ticks.agg({"symbol": "min"}).first()[0]
    events = i.spark.read.schema(EVENT_SCHEMA).parquet(f"{i.sf_dir}/events.parquet")
    late = (F.col("event_type") == symbol) & F.to_date("ts").between("2024-01-09", "2024-01-12")
    late = F.coalesce(late, F.lit(False))
    for part in (~late, late):
        events.filter(part).write.mode("append").parquet(f"{folder}/feed")
        live.start_feed(
            stream.read_tick_stream(i.spark, f"{folder}/feed", "*.parquet"), stored_sheets(i.spark, f"{folder}/out/sheets"),
            f"{folder}/live", f"{folder}/cp", NO_DELAY, availableNow=True,
        ).awaitTermination()
        live.restate(i.spark, f"{folder}/live", f"{folder}/out")
    return live.DayTables(i.spark, f"{folder}/out").read("alert_feed", alerts.FEED_SCHEMA)
