"""Literal frames for tests."""

from __future__ import annotations

import datetime as dt

from levelmap.operators import joins, sessions, zones
from levelmap.schemas import BAR_SCHEMA, SHEET_SCHEMA, TICK_SCHEMA, Params
from levelmap.sources.sheets import with_defaults

DAY = dt.date(2024, 1, 15)


def at(day: dt.date, hour: int) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(hour))


def make_bars(spark, closes, symbol="S"):
    """Bars from (day, hour, close); open, high and low repeat the close."""
    rows = [(symbol, at(d, h), d, float(c), float(c), float(c), float(c), 1) for d, h, c in closes]
    return spark.createDataFrame(rows, BAR_SCHEMA)


def make_ticks(spark, rows, symbol="S"):
    """Ticks from (ts, event_id, px)."""
    return spark.createDataFrame([(symbol, ts, i, float(px)) for ts, i, px in rows], TICK_SCHEMA)


def make_sheets(spark, *sheets, params=Params()):
    """Sheets from dicts of entered fields; the rest takes defaults."""
    names = SHEET_SCHEMA.names
    rows = [
        tuple({"symbol": "S", "session_date": DAY, **sheet}.get(name) for name in names) for sheet in sheets
    ]
    return with_defaults(spark.createDataFrame(rows, SHEET_SCHEMA), params)


def zone_list(spark, **fields):
    sheets = make_sheets(spark, fields)
    return [tuple(r) for r in zones.zone_rows(sheets).orderBy("zone_seq").collect()]


def context_with_sheets(bars, sheets):
    return joins.by_session(sessions.bar_context(bars), zones.with_zones(sheets))


def session_rows(bars, sheets):
    return joins.by_session(sessions.session_stats(bars), zones.with_zones(sheets))


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
