"""The daily job: ticks to tables.

Queries of the catalog start from ticks each time. Here ticks are reduced once, to price cells, and
bars are made of those; all results then come from these two tables and the sheets. Results are
published for a range of sessions: a run opens the days of the range and one carried row per symbol from
the day before, and its results replace those days by one switch (``levelmap.sources.versions``).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmap import fixed
from levelmap.operators import alerts, joins, sessions, snapshot, zones
from levelmap.schemas import BAR_SCHEMA, SHEET_KEYS, SHEET_SCHEMA, Params
from levelmap.sources.sheets import ENTERED_SCHEMA, latest, with_defaults
from levelmap.sources.sinks import write_by_session
from levelmap.sources.ticks import bars, bars_of_cells, first_ticks_of_cells, in_utc, price_cells
from levelmap.sources.versions import DayTables, days_of, read_days
from levelmap.streaming.context import CARRY_SCHEMA, seeded_context

CELL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("px", T.DoubleType()),
        T.StructField("cell", T.ArrayType(T.LongType())),
    ]
)
_PAST = ("session_date", "close", "low", "high")


def publish_bars(
    ticks: DataFrame, out: str, interval: str = "1 hour", tz: str = "UTC", days: list[dt.date] | None = None
) -> None:
    """Stores price cells and bars of the ticks' sessions, or of ``days``. Interval and time zone are kept
    with the tables, and a later run under others is refused.

    Without a session time zone of UTC there are bars only, and no intrabar entries in the alert feed.
    """
    tables = DayTables(ticks.sparkSession, out)
    _settle(tables, "bars.json", {"interval": interval, "tz": tz})
    if not in_utc(ticks.sparkSession):
        return tables.replace({"bars": bars(ticks, interval, tz)}, days)
    publish_cells(tables, price_cells(ticks, interval, tz), days)


def publish_cells(tables: DayTables, cells: DataFrame, days: list[dt.date] | None = None) -> None:
    tables.stage({"cells": cells}, days)
    stored = tables.read("cells", CELL_SCHEMA, staged=True) if days is None else tables.read("cells", CELL_SCHEMA, min(days), max(days), staged=True)
    tables.stage({"bars": bars_of_cells(stored.repartition(*SHEET_KEYS))}, days)
    tables.switch()


def _settle(tables: DayTables, name: str, wanted: dict) -> None:
    """Keeps settings with the tables that were made under them, and refuses others."""
    if name not in tables.files.names():
        tables.files.put(name, json.dumps(wanted))
    elif (kept := json.loads(tables.files.text(name))) != wanted:
        raise ValueError(f"{tables.folder} was published with {kept}, not with {wanted}")


def publish_sheets(sheets: DataFrame, out: str) -> None:
    """Stores sheets as entered; defaults are applied when they are read."""
    write_by_session(sheets, f"{out}/sheets")


def _sheets(tables: DayTables, days: list[dt.date], params: Params) -> DataFrame:
    entered = days_of(tables.files, "sheets")
    folders = [f"session_date={d}" for d in days if d in entered]
    raw = read_days(tables.spark, f"{tables.folder}/sheets", ENTERED_SCHEMA, folders)
    return with_defaults(latest(raw), params)


def carry_schema(params: Params = Params()) -> T.StructType:
    """One row per symbol and day: its last close by the end of that day, and the sheet then in force."""
    fields = [(n, t) for n, t in _complete_fields(params) if n not in SHEET_KEYS]
    sheet = T.StructType([T.StructField("sheet_date", T.DateType()), *(T.StructField(n, t) for n, t in fields)])
    past = T.StructType([f for f in CARRY_SCHEMA.fields if f.name in _PAST])
    return T.StructType([*SHEET_SCHEMA.fields[:2], T.StructField("past", past), T.StructField("sheet", sheet)])


def _complete_fields(params: Params) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in SHEET_SCHEMA.fields] + [("max_change_ok", T.BooleanType())]


def _carried(stats: DataFrame, sheets: DataFrame, before: DataFrame, days: list[dt.date]) -> DataFrame:
    """Carries rows on from the day before the first of these days to the end of each of them."""
    kinds = {f.name: f.dataType for f in before.schema.fields}
    fields = [n for n in kinds["sheet"].names if n != "sheet_date"]
    closes = F.struct("session_date", F.col("last_close").alias("close"), F.col("low_close").alias("low"), F.col("high_close").alias("high"))
    sheet = F.struct(F.col("session_date").alias("sheet_date"), *fields)
    none = {name: F.lit(None).cast(kinds[name]).alias(name) for name in ("past", "sheet")}
    moves = (
        stats.select(*SHEET_KEYS, closes.cast(kinds["past"]).alias("past"), none["sheet"])
        .unionByName(sheets.select(*SHEET_KEYS, none["past"], sheet.cast(kinds["sheet"]).alias("sheet")))
        .unionByName(before.withColumn("session_date", F.date_sub(F.lit(days[0]), 1)))
        .groupBy(*SHEET_KEYS).agg(F.max("past").alias("past"), F.max("sheet").alias("sheet"))
    )
    order = Window.partitionBy("symbol").orderBy("session_date")
    held = moves.select(
        "symbol", "session_date", F.lead("session_date").over(order).alias("until"),
        *(F.last(c, ignorenulls=True).over(order).alias(c) for c in ("past", "sheet")),
    )
    since = F.filter(F.lit(days), lambda d: (d >= F.col("session_date")) & (F.col("until").isNull() | (d < F.col("until"))))
    return held.select("symbol", F.explode(since).alias("session_date"), "past", "sheet")


def in_force(stats: DataFrame, sheets: DataFrame, before: DataFrame, days: list[dt.date]) -> DataFrame:
    """Each symbol's sheet on each of these days: the latest one, carried from before if need be."""
    carry = _carried(stats, sheets, before, days)
    return carry.filter("sheet is not null").select(*SHEET_KEYS, "sheet.*").drop("sheet_date")


def carried_on(stats: DataFrame, sheets: DataFrame | None, before: DataFrame, days: list[dt.date]) -> DataFrame:
    """The carried rows after the last of these days, of which ``stats`` may hold a part: one row per symbol."""
    kinds = {f.name: f.dataType for f in before.schema.fields}
    closes = F.struct("session_date", F.col("last_close").alias("close"), F.col("low_close").alias("low"), F.col("high_close").alias("high"))
    fresh = stats.select(*SHEET_KEYS, closes.cast(kinds["past"]).alias("past"), F.lit(True).alias("fresh"))
    # A session that goes on keeps its extremes: they are taken over the carried and the new ones.
    past = before.filter("past is not null").select("symbol", F.col("past.session_date").alias("session_date"), "past", F.lit(False).alias("fresh"))
    by_day = fresh.unionByName(past).groupBy(*SHEET_KEYS).agg(
        F.max_by("past.close", "fresh").alias("close"), F.min("past.low").alias("low"), F.max("past.high").alias("high")
    )
    closed = by_day.groupBy("symbol").agg(F.max(F.struct("session_date", "close", "low", "high")).cast(kinds["past"]).alias("past"))
    held = before.select("symbol", "sheet")
    if sheets is not None:
        sheet = F.struct(F.col("session_date").alias("sheet_date"), *[n for n in kinds["sheet"].names if n != "sheet_date"])
        held = held.unionByName(sheets.select("symbol", sheet.cast(kinds["sheet"]).alias("sheet")))
    held = held.groupBy("symbol").agg(F.max("sheet").alias("sheet"))
    return closed.join(held, "symbol", "full").select("symbol", F.lit(days[-1]).alias("session_date"), "past", "sheet")


def _stage(tables: DayTables, days: list[dt.date], before: DataFrame, brand: str, params: Params, as_of: bool) -> None:
    """Stages all results of these days. What is read: their bars, cells and sheets, and the carried rows."""
    spark, span = tables.spark, (days[0], days[-1])
    history = tables.read("bars", BAR_SCHEMA, *span)
    seen = first_ticks_of_cells(tables.read("cells", CELL_SCHEMA, *span))
    sheets = _sheets(tables, days, params)
    stats = sessions.session_stats(history)
    # Where sheets count for their own session only, none is carried.
    tables.stage({"carry": _carried(stats, sheets if as_of else sheets.limit(0), before, days)}, days)
    carry = tables.read("carry", before.schema, *span, staged=True)
    if as_of:
        sheets = carry.filter("sheet is not null").select(*SHEET_KEYS, "sheet.*").drop("sheet_date")
    zoned = zones.with_zones(sheets)
    past = before.filter("past is not null").select("symbol", "past.*")
    context = joins.by_session(seeded_context(history, past), zoned)
    at_last = joins.by_session(stats, zoned)
    entries = zones.entries_of_first_ticks(seen, context, *SHEET_KEYS, "ts")
    tables.stage(
        {
            "alerts": alerts.alerts(context, brand),
            "alert_feed": alerts.alert_feed(context, entries, brand),
            "snapshot": snapshot.snapshot(at_last),
            "summary": snapshot.summary_rows(at_last, brand),
            "annotations": snapshot.annotations(at_last),
            "touches": zones.touch_counts(zoned, seeded_context(history, past)),
        },
        days,
    )


def _differ(a: DataFrame, b: DataFrame) -> bool:
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def publish_results(
    spark: SparkSession,
    out: str,
    brand: str = fixed.DEFAULT_BRAND,
    params: Params = Params(),
    first: dt.date | None = None,
    last: dt.date | None = None,
    as_of: bool = False,
) -> list[dt.date]:
    """Writes alerts, alert_feed, snapshot, summary, annotations and touches of the sessions from first to
    last, of all of them by default, next to bars and sheets; returns the days that were stated.

    Days before that were never stated are included. Later days follow while what is carried into them
    differs from before: after a corrected bar until each symbol has traded again, and with ``as_of``, where
    a sheet stays in force until the next one, after a corrected sheet until then. All appear by one switch.
    Days that no longer hold anything are emptied.
    """
    tables, schema = DayTables(spark, out), carry_schema(params)
    _settle(tables, "results.json", {"as_of": as_of})
    stated = set(tables.days("carry"))
    known = sorted(set(tables.days("bars")) | days_of(tables.files, "sheets") | stated)
    days = [d for d in known if (first is None or d >= first) and (last is None or d <= last)]
    if not days:
        return []
    start = known.index(days[0])
    while start and known[start - 1] not in stated:
        start -= 1
    end, size, done = known.index(days[-1]) + 1, 1, []
    while start < end:
        before = tables.read("carry", schema, known[start - 1], known[start - 1], staged=True) if start else spark.createDataFrame([], schema)
        days = known[start:end]
        _stage(tables, days, before, brand, params, as_of)
        done += days
        if end < len(known):
            at = (schema, days[-1], days[-1])
            if days[-1] not in stated or _differ(tables.read("carry", *at), tables.read("carry", *at, staged=True)):
                start, end, size = end, min(len(known), end + size), 2 * size
                continue
        break
    tables.switch()
    return done


def published(spark: SparkSession, out: str, table: str, schema: T.StructType, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """A published table as it stands, or some of its sessions."""
    return DayTables(spark, out).read(table, schema, first, last)
