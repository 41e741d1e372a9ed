"""The live query: several batches, late ticks stated again, carried sheets, corrected sheets."""

from __future__ import annotations

import datetime as dt

from helpers import DAY, at, make_sheets, make_ticks
from pyspark.sql import functions as F

from levelmap.operators import alerts, joins, sessions, zones
from levelmap.sources.sinks import write_by_session
from levelmap.sources.ticks import bars
from levelmap.sources.versions import DayTables
from levelmap.streaming import bars as stream
from levelmap.streaming import live

NEXT = DAY + dt.timedelta(days=1)
MINUTE = dt.timedelta(minutes=1)
LEVELS = {"g1p": 19020.0, "g2p": 19022.0, "r1p": 19050.0, "mq_cr0": 19100.0, "mq_ps0": 19000.0}


def write_events(spark, ticks, folder, symbol="S"):
    rows = make_ticks(spark, ticks, symbol).selectExpr("event_id", "ts", "symbol as event_type", "(px - 19000) / 4 as value")
    rows.coalesce(1).write.mode("append").parquet(folder)
    return make_ticks(spark, ticks, symbol)


def run(spark, tmp_path, sheets, **options):
    def of_days(first, last):
        return sheets.filter(F.col("session_date").between(first, last))

    live.start_feed(
        stream.read_tick_stream(spark, str(tmp_path / "feed"), "*.parquet"), of_days, str(tmp_path / "live"),
        str(tmp_path / "cp"), "0 seconds", partitions=2, availableNow=True, **options,
    ).awaitTermination()


def events(df):
    return sorted(str(r) for r in df.select("symbol", "ts", "kind", "close", "event_id").collect())


def batch_feed(ticks, sheets, closed_at=None, as_of=False):
    join = joins.as_of if as_of else joins.by_session
    context = join(sessions.bar_context(bars(ticks)), zones.with_zones(sheets))
    feed = alerts.alert_feed(context, zones.intrabar_entries(ticks, context))
    if closed_at is None:
        return events(feed)
    return events(feed.filter(F.col("event_id").isNotNull() | (F.col("ts") + F.expr("interval 1 hour") <= F.lit(closed_at))))


def fed(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "live" / "feed"))


FIRST = [(at(DAY, 9), 1, 19010), (at(DAY, 9) + MINUTE, 2, 19012), (at(DAY, 10), 3, 19021), (at(DAY, 11), 4, 19005)]
SECOND = [(at(DAY, 11) + MINUTE, 5, 19120), (at(DAY, 12), 6, 19030), (at(NEXT, 9), 7, 19021), (at(NEXT, 10), 8, 18980)]


def test_batches_go_on_where_the_last_one_ended(spark, tmp_path):
    sheets = make_sheets(spark, LEVELS, {**LEVELS, "session_date": NEXT})
    ticks = write_events(spark, FIRST, str(tmp_path / "feed"))
    run(spark, tmp_path, sheets)
    assert events(fed(spark, tmp_path)) == batch_feed(ticks, sheets, at(DAY, 11))
    ticks = ticks.unionByName(write_events(spark, SECOND, str(tmp_path / "feed")))
    run(spark, tmp_path, sheets)
    assert fed(spark, tmp_path).select("batch_id").distinct().count() > 1
    assert events(fed(spark, tmp_path)) == batch_feed(ticks, sheets, at(NEXT, 10))
    assert live.late_days(spark, str(tmp_path / "live")) == []
    # The last batch, broken off before its commit, is run again and stores nothing twice.
    commits = [p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(spark, tmp_path, sheets)
    assert events(fed(spark, tmp_path)) == batch_feed(ticks, sheets, at(NEXT, 10))


def test_a_session_without_a_sheet_has_the_last_one(spark, tmp_path):
    sheets = make_sheets(spark, LEVELS)
    ticks = write_events(spark, FIRST, str(tmp_path / "feed"))
    run(spark, tmp_path, sheets, as_of=True)
    ticks = ticks.unionByName(write_events(spark, SECOND, str(tmp_path / "feed")))
    run(spark, tmp_path, sheets, as_of=True)
    got = events(fed(spark, tmp_path))
    assert got == batch_feed(ticks, sheets, at(NEXT, 10), as_of=True)
    assert any(f"{NEXT.day}, 9" in e for e in got)


def test_late_ticks_are_stated_again_for_their_sessions_only(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    third = NEXT + dt.timedelta(days=1)
    sheets = make_sheets(spark, *({**LEVELS, "session_date": d} for d in (DAY, NEXT, third)))
    write_by_session(sheets.drop("max_change_ok"), f"{out}/sheets")
    ticks = write_events(spark, FIRST + SECOND + [(at(third, 9), 9, 19021), (at(third, 10), 10, 19000)], feed)
    run(spark, tmp_path, sheets)
    assert live.restate(spark, str(tmp_path / "live"), out) == [DAY, NEXT, third]
    assert live.restate(spark, str(tmp_path / "live"), out) == []
    before = DayTables(spark, out).index()["alert_feed"]
    ticks = ticks.unionByName(write_events(spark, [(at(DAY, 9) + 5 * MINUTE, 11, 19200), (at(DAY, 13), 12, 19060)], feed))
    run(spark, tmp_path, sheets)
    assert live.late_days(spark, str(tmp_path / "live")) == [DAY]
    # The day's last close has changed, so the session after it is stated again too; the third is not.
    assert live.restate(spark, str(tmp_path / "live"), out) == [DAY, NEXT]
    assert events(DayTables(spark, out).read("alert_feed", alerts.FEED_SCHEMA)) == batch_feed(ticks, sheets)
    assert DayTables(spark, out).index()["alert_feed"][third] == before[third]


def test_touches_are_counted_again_under_a_corrected_sheet(spark, tmp_path):
    def touches():
        return sorted((r.zone_seq, r.touches) for r in DayTables(spark, str(tmp_path / "live" / "live")).read("touches", live.TOUCH_SCHEMA).collect())

    ticks = write_events(spark, FIRST, str(tmp_path / "feed"))
    run(spark, tmp_path, make_sheets(spark, LEVELS))
    assert touches() == [(1, 1)]
    sheets = make_sheets(spark, {**LEVELS, "g1p": 19005.0, "g2p": 19007.0, "r2p": 19052.0})
    ticks = ticks.unionByName(write_events(spark, [(at(DAY, 12), 5, 19051), (at(DAY, 13), 6, 19051)], str(tmp_path / "feed")))
    run(spark, tmp_path, sheets)
    context = sessions.bar_context(bars(ticks).filter(F.col("ts") < F.lit(at(DAY, 13))))
    want = sorted((r.zone_seq, r.touches) for r in zones.touch_counts(zones.with_zones(sheets), context).collect())
    assert touches() == want and len(want) == 2 and want != [(1, 0), (2, 0)]


def test_a_session_is_one_file_however_many_partitions(spark, tmp_path):
    """Folders of sessions times partitions would grow with the square of the input."""
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    ticks = [(at(d, 9 + h), 100 * i + h, 19000 + 2 * h) for i, d in enumerate(days) for h in range(8)]
    sheets = make_sheets(spark, *({**LEVELS, "session_date": d} for d in days))
    write_events(spark, ticks, str(tmp_path / "feed"), "S")
    write_events(spark, ticks, str(tmp_path / "feed"), "T")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run(spark, tmp_path, sheets)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table in ("live/cells/batch_id=0", "live/contexts/batch_id=0", "cp/open/turn-0"):
        found = sorted(p.parent.name for p in (tmp_path / table).rglob("*.parquet"))
        assert found == [f"session_date={d}" for d in days], table
