"""The live path as one query: ticks to an alert feed, touch counts and an archive, with late ticks kept.

One micro-batch reduces its ticks once, to price cells, and everything follows from those: the cells of
bars not yet closed are carried, a bar is closed when its end lies ``delay`` behind the newest tick, and the
alerts of closed bars and the zone entries of forming ones go to one table of events. Ticks of bars that
are closed already are late: they are kept in the archive with all others and noted by session, and
``restate`` states those sessions again.

What is carried is one row per symbol (last close, session extremes, and with ``as_of`` the sheet in force),
the cells of open bars and the entries those have raised. All is written per batch, so that a repeated
batch starts from the same rows and stores nothing twice.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from levelmap import fixed
from levelmap.operators import alerts, joins, sessions, zones
from levelmap.plans import publish
from levelmap.schemas import SHEET_KEYS, Params
from levelmap.sources.sinks import write_by_session
from levelmap.sources.ticks import bar_end, bars_of_cells, first_ticks_of_cells, merged_cells, price_cells
from levelmap.sources.versions import DayTables, Files, days_of, read_days
from levelmap.streaming.context import Turns, seeded_context
from levelmap.streaming.sinks import SheetLoader, at_once, start_batches

RAISED_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("kind", T.StringType())])
TOUCH_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("session_date", T.DateType())]
    + [T.StructField("zone_seq", T.IntegerType()), T.StructField("touches", T.LongType())]
)
CONTEXT_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("session_date", T.DateType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(n, T.DoubleType()) for n in ("close", "prev_close", "low_before", "high_before")]
)


class _Mark:
    """Up to where bars are closed, in microseconds, after each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def before(self, batch_id: int) -> int | None:
        earlier = [n for n in map(int, self.files.names()) if n < batch_id]
        return int(self.files.text(str(max(earlier)))) if earlier else None

    def put(self, batch_id: int, micros: int) -> None:
        self.files.drop(str(batch_id))
        self.files.put(str(batch_id), str(micros))
        for stale in sorted(map(int, self.files.names()))[:-3]:
            self.files.drop(str(stale))


def _batches(spark: SparkSession, folder: str, schema: T.StructType, days: list[dt.date]) -> DataFrame:
    """The sessions' rows of all batches, from the folders of those sessions only."""
    files = Files(spark, folder)
    found = [f"{b}/session_date={d}" for b in files.names() for d in sorted(days_of(files, b) & set(days))]
    return read_days(spark, folder, schema, found)


def _ended(cells: DataFrame, interval: str, tz: str) -> DataFrame:
    """Cells with the end of their bar, in microseconds."""
    timed = cells.withColumn("bar", F.expr("cast(timestamp_micros(cell[0]) as timestamp_ntz)"))
    return timed.withColumn("ends", F.unix_micros(bar_end(interval, tz, "bar").cast("timestamp"))).drop("bar")


def start_feed(
    ticks: DataFrame,
    load_sheets: SheetLoader,
    out: str,
    checkpoint: str,
    delay: str,
    interval: str = "1 hour",
    tz: str = "UTC",
    brand: str = fixed.DEFAULT_BRAND,
    params: Params = Params(),
    as_of: bool = False,
    **options,
) -> StreamingQuery:
    """Writes ``feed`` (alert events), ``cells`` (the archive), ``late`` and ``contexts`` by batch, and ``touches``.

    An event is keyed by symbol, bar and kind and stored once. An intrabar entry is judged against the close
    before as known when it is raised. Touch counts are those of closed bars; a session's are counted again
    from its contexts when its bars go on, under its sheet of that moment, so that a corrected sheet re-bases
    them. With ``as_of`` a session without a sheet of its own has the symbol's last one.
    """
    day = "timestamp'2000-01-03'"
    wait = ticks.sparkSession.sql(f"select unix_micros({day} + interval {delay}) - unix_micros({day})").first()[0]
    schema = publish.carry_schema(params)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _Mark(spark, f"{checkpoint}/mark")
        opened = Turns(spark, f"{checkpoint}/open", publish.CELL_SCHEMA)
        carried = Turns(spark, f"{checkpoint}/carry", schema)
        raised = Turns(spark, f"{checkpoint}/raised", RAISED_SCHEMA)
        name, closed_before = f"batch_id={batch_id}", mark.before(batch_id)
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        write_by_session(price_cells(timed, interval, tz), f"{out}/cells/{name}", whole=True)
        days = sorted(days_of(Files(spark, out), f"cells/{name}"))
        if not days:
            return
        cells = read_days(spark, f"{out}/cells", publish.CELL_SCHEMA, [f"{name}/session_date={d}" for d in days])
        ended = _ended(cells, interval, tz)
        is_late = F.col("ends") <= F.lit(closed_before) if closed_before is not None else F.lit(False)
        newest, late = ended.agg(F.max(F.col("cell")[3]), F.count_if(is_late)).first()
        if late:
            write_by_session(ended.filter(is_late).select(*publish.CELL_SCHEMA.names), f"{out}/late/{name}", whole=True)
        closes = max(newest - wait, closed_before if closed_before is not None else newest - wait)
        held = _ended(opened.before(batch_id), interval, tz)
        if closed_before is not None:
            held = held.filter(F.col("ends") > F.lit(closed_before))
        now = opened.put(merged_cells(held.unionByName(ended.filter(~is_late)).drop("ends")), batch_id, by_session=True)
        days = opened.days(batch_id)
        if not days:
            return mark.put(batch_id, closes)
        before = carried.before(batch_id)
        bars = bars_of_cells(now)
        is_closed = F.unix_micros(bar_end(interval, tz).cast("timestamp")) <= F.lit(closes)
        sheets = load_sheets(days[0], days[-1])
        if as_of:
            sheets = publish.in_force(sessions.session_stats(bars), sheets, before, days)
        zoned = zones.with_zones(sheets)
        context = seeded_context(bars, before.filter("past is not null").select("symbol", "past.*"))
        judged = joins.by_session(context, zoned)
        entries = alerts.intrabar_events(zones.entries_of_first_ticks(first_ticks_of_cells(now), judged, *SHEET_KEYS, "ts"), brand)
        known = raised.before(batch_id)
        feed = alerts.closed_events(judged.filter(is_closed), brand).unionByName(entries.join(known, ["symbol", "ts", "kind"], "left_anti"))
        stats = sessions.session_stats(bars.filter(is_closed))
        on_closed = publish.carried_on(stats, load_sheets(days[0], days[-1]) if as_of else None, before, days)

        def keep_feed() -> None:
            feed.write.mode("overwrite").parquet(f"{out}/feed/{name}")
            fresh = spark.read.schema(feed.schema).parquet(f"{out}/feed/{name}").filter(F.col("kind").startswith(alerts.INTRABAR))
            both = known.unionByName(fresh.select(*RAISED_SCHEMA.names)).filter(~is_closed)
            raised.put(both, batch_id)

        def count_touches() -> None:
            write_by_session(context.filter(is_closed).select(*CONTEXT_SCHEMA.names), f"{out}/contexts/{name}", whole=True)
            closed_days = sorted(days_of(Files(spark, out), f"contexts/{name}"))
            if closed_days:
                told = zoned.filter(F.col("session_date").isin(closed_days))
                counts = zones.touch_counts(told, _batches(spark, f"{out}/contexts", CONTEXT_SCHEMA, closed_days))
                DayTables(spark, f"{out}/live").replace({"touches": counts.select(*TOUCH_SCHEMA.names)}, closed_days)

        at_once(keep_feed, count_touches, lambda: carried.put(on_closed, batch_id))
        mark.put(batch_id, closes)

    return start_batches(ticks, write, checkpoint, **options)


def late_days(spark: SparkSession, live: str) -> list[dt.date]:
    files = Files(spark, f"{live}/late")
    return sorted({d for b in files.names() for d in days_of(files, b)})


def restate(spark: SparkSession, live: str, out: str, **options) -> list[dt.date]:
    """Publishes, from the archive of a live query, the sessions that are not published yet and those that
    late ticks have come for since, and what follows from them; returns the days that were stated.

    ``options`` are those of ``publish_results``. Late ticks are thereby in bars, contexts and alerts as if
    they had come in time, and no other session is made again.
    """
    archive, tables = Files(spark, f"{live}/cells"), DayTables(spark, out)
    batches = {b: days_of(archive, b) for b in archive.names()}
    done = json.loads(tables.files.text("restated.json")) if "restated.json" in tables.files.names() else []
    late = Files(spark, f"{live}/late")
    behind = {d for b in late.names() if b not in done for d in days_of(late, b)}
    days = sorted((set().union(*batches.values()) - set(tables.days("cells"))) | behind)
    if not days:
        return []
    publish.publish_cells(tables, merged_cells(_batches(spark, f"{live}/cells", publish.CELL_SCHEMA, days)), days)
    stated = set()
    for first, last in _spans(days, tables.days("bars")):
        stated |= set(publish.publish_results(spark, out, first=first, last=last, **options))
    tables.files.drop("restated.json")
    tables.files.put("restated.json", json.dumps(late.names()))
    return sorted(stated)


def _spans(days: list[dt.date], known: list[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Runs of days with no other known day between them."""
    spans: list[list[dt.date]] = []
    for day in days:
        if spans and not any(spans[-1][1] < d < day for d in known):
            spans[-1][1] = day
        else:
            spans.append([day, day])
    return [(first, last) for first, last in spans]
