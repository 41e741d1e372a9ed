"""The live path against the batch result."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import DAY, at, make_sheets, make_ticks
from pyspark.sql import functions as F

from levelmap.operators import alerts, joins, sessions, zones
from levelmap.plans.catalog import Inputs
from levelmap.sources.sheets import sheets_from_ticks, stored_sheets
from levelmap.sources.sinks import write_by_session
from levelmap.sources.ticks import bars
from levelmap.streaming import bars as stream
from levelmap.streaming import entries, sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events in three files by time, cut inside bars and sessions."""
    folder = str(tmp_path_factory.mktemp("feed"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    cuts = ["2024-01-01 00:00:00", "2024-01-09 13:20:00", "2024-01-09 13:40:00", "2024-03-01 00:00:00"]
    for start, end in zip(cuts, cuts[1:]):
        part = events.filter(f"ts >= timestamp_ntz'{start}' and ts < timestamp_ntz'{end}'")
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def of_days(sheets):
    return lambda first, last: sheets.filter(F.col("session_date").between(first, last))


def start_contexts(confirmed, tmp_path, partitions):
    def store(context, batch_id):
        context.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch_id={batch_id}"))

    return sinks.start_contexts(confirmed, store, str(tmp_path / "cp"), partitions=partitions, availableNow=True)


def wall_clock(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_alerts_of_many_batches_equal_the_batch_result(spark, inputs, split_events, tmp_path):
    feed = stream.read_tick_stream(spark, split_events, "*.parquet", max_files=1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    sinks.start_alerts(
        stream.stream_bars(feed, "0 seconds"), of_days(inputs.sheets), out, checkpoint, partitions=2, availableNow=True
    ).awaitTermination()
    written = wall_clock(spark.read.parquet(out))
    assert written.select("batch_id").distinct().count() > 1
    columns = ["symbol", "session_date", "ts", "kind", "close", "title", "message"]
    last_tick = inputs.ticks.agg(F.max("ts")).first()[0]
    expected = alerts.alerts(inputs.zoned_context).filter(
        F.col("ts") + F.expr("interval 1 hour") <= F.lit(last_tick)
    )
    assert sorted(written.select(columns).collect()) == sorted(expected.select(columns).collect())


def write_events(spark, ticks, folder):
    """Ticks as an event file: prices go back through the grid rule."""
    rows = make_ticks(spark, ticks).selectExpr(
        "event_id", "ts", "symbol as event_type", "(px - 19000) / 4 as value"
    )
    rows.coalesce(1).write.mode("append").parquet(folder)


def run_bars(spark, folder, tmp_path, delay="0 seconds"):
    confirmed = stream.stream_bars(stream.read_tick_stream(spark, folder, "*.parquet"), delay=delay)
    start_contexts(confirmed, tmp_path, 2).awaitTermination()
    return wall_clock(spark.read.parquet(str(tmp_path / "out")))


def test_state_survives_a_restart_and_late_ticks_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "feed")
    next_day = at(DAY + dt.timedelta(days=1), 0)
    minute = dt.timedelta(minutes=1)
    write_events(spark, [(at(DAY, 9), 1, 19010), (at(DAY, 10), 2, 19020), (at(DAY, 11), 3, 19005)], folder)
    first = run_bars(spark, folder, tmp_path)
    assert sorted(r.ts for r in first.collect()) == [at(DAY, 9), at(DAY, 10)]
    late = (at(DAY, 9) + minute, 4, 19999)
    write_events(spark, [late, (at(DAY, 12), 5, 19030), (next_day, 6, 19040), (next_day + 61 * minute, 7, 19050)], folder)
    both = run_bars(spark, folder, tmp_path)
    got = sorted((r.ts, r.close, r.prev_close, r.low_before, r.high_before) for r in both.collect())
    assert got == [
        (at(DAY, 9), 19010.0, None, None, None),
        (at(DAY, 10), 19020.0, 19010.0, 19010.0, 19010.0),
        (at(DAY, 11), 19005.0, 19020.0, 19010.0, 19020.0),
        (at(DAY, 12), 19030.0, 19005.0, 19005.0, 19020.0),
        (next_day, 19040.0, 19030.0, None, None),
    ]


def test_delay_keeps_bars_open_for_late_ticks(spark, tmp_path):
    folder = str(tmp_path / "feed")
    write_events(spark, [(at(DAY, 9), 1, 19010), (at(DAY, 10), 2, 19020)], folder)
    assert run_bars(spark, folder, tmp_path, "2 hours").count() == 0
    write_events(spark, [(at(DAY, 9) + dt.timedelta(minutes=5), 3, 19015), (at(DAY, 13), 4, 19020)], folder)
    got = sorted((r.ts, r.close) for r in run_bars(spark, folder, tmp_path, "2 hours").collect())
    assert got == [(at(DAY, 9), 19015.0), (at(DAY, 10), 19020.0)]


def test_a_sheet_entered_while_running_applies_to_later_batches(spark, tmp_path):
    folder = str(tmp_path / "feed")
    hours = [(at(DAY, h), h, 19000 + h) for h in range(9, 12)]
    write_events(spark, hours, folder)
    entered = []

    def run():
        sinks.start_alerts(
            stream.stream_bars(stream.read_tick_stream(spark, folder, "*.parquet"), "0 seconds"),
            lambda first, last: make_sheets(spark, *entered),
            str(tmp_path / "out"),
            str(tmp_path / "cp"),
            partitions=2,
            availableNow=True,
        ).awaitTermination()
        return sorted((r.ts, r.kind) for r in wall_clock(spark.read.parquet(str(tmp_path / "out"))).collect())

    entered.append({"symbol": "none"})
    assert run() == []
    # The node was broken by the session's first bar already, so it raises nothing now: the
    # result is that of a recalculation of the session under the new sheet.
    entered.append({"symbol": "S", "mq_cr0": 19000.0, "g1p": 19100.0})
    write_events(spark, [(at(DAY, 13), 20, 19013)], folder)
    assert run() == [(at(DAY, 11), "pin_break_up")]


def test_forming_bar_changes_until_its_last_version(spark, tmp_path):
    folder = str(tmp_path / "feed")
    entered = [{"zero_gamma": 19005.0, "g1p": 19004.0}]

    def run():
        forming = stream.stream_bars(stream.read_tick_stream(spark, folder, "*.parquet"), "0 seconds")
        sinks.start_forming(
            forming,
            of_days(make_sheets(spark, *entered)),
            str(tmp_path / "out"),
            str(tmp_path / "cp"),
            partitions=2,
            availableNow=True,
        ).awaitTermination()
        updates = wall_clock(spark.read.parquet(str(tmp_path / "out")))
        rows = sinks.latest_versions(updates, "symbol", "ts").collect()
        return sorted((r.ts, r.spot, r.mode, r.zg_distance, r.mirror_target, r.zones_text) for r in rows)

    start = at(DAY, 9)
    write_events(spark, [(start, 1, 19010)], folder)
    assert run() == [(start, 19010.0, "FADE EDGES", 5.0, 19000.0, "▲ 0  ▼ 1")]
    write_events(spark, [(start + dt.timedelta(minutes=1), 2, 19001)], folder)
    assert run() == [(start, 19001.0, "TRANSIZIONE", -4.0, 19009.0, "▲ 1  ▼ 0")]
    # A sheet of the next day, entered while the stream runs, applies to that day's first bar.
    next_day = DAY + dt.timedelta(days=1)
    entered.append({"session_date": next_day, "zero_gamma": 19000.0})
    write_events(spark, [(at(next_day, 9), 3, 19002)], folder)
    assert run()[-1][:4] == (at(next_day, 9), 19002.0, "FADE EDGES", 2.0)


def test_contexts_agree_column_by_column(spark, inputs, split_events, tmp_path):
    feed = stream.read_tick_stream(spark, split_events, "*.parquet", max_files=1)
    start_contexts(stream.stream_bars(feed, "0 seconds"), tmp_path, 3).awaitTermination()
    streamed = wall_clock(spark.read.parquet(str(tmp_path / "out"))).drop("batch_id")
    batch = sessions.bar_context(bars(inputs.ticks)).select(streamed.columns)
    order = lambda df: sorted(map(str, df.collect()))
    closed = batch.join(streamed.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    assert order(streamed) == order(closed.select(streamed.columns))
    assert batch.count() - streamed.count() <= 5
    assert joins.by_session(streamed, zones.with_zones(inputs.sheets)).count() > 0


def lagging_feeds(spark, tmp_path, delay):
    """Three symbols over the same four hours, one file and micro-batch each."""
    folder = str(tmp_path / "feed")
    for k in range(3):
        ticks = [(at(DAY, 9 + hour), 10 * k + hour, 19000 + k) for hour in range(4)]
        rows = make_ticks(spark, ticks, symbol="ABC"[k]).selectExpr("event_id", "ts", "symbol as event_type", "(px - 19000) / 4 as value")
        rows.coalesce(1).write.mode("append").parquet(folder)
    write_events(spark, [(at(DAY + dt.timedelta(days=2), 9), 99, 19000)], folder)
    feed = stream.read_tick_stream(spark, folder, "*.parquet", max_files=1)
    query = sinks.start_table(
        stream.stream_bars(feed, delay), str(tmp_path / "out"), str(tmp_path / "cp"), partitions=2, availableNow=True
    )
    query.awaitTermination()
    assert "HashAggregate" in (plan := query._jsq.explainInternal(False)) and "SortAggregate" not in plan
    return spark.read.parquet(str(tmp_path / "out")).filter("symbol in ('A', 'B', 'C')").count(), stream.dropped_ticks(query)


def test_the_delay_covers_lagging_feeds(spark, tmp_path):
    assert lagging_feeds(spark, tmp_path, "6 hours") == (12, 0)


def test_ticks_beyond_the_delay_are_counted(spark, tmp_path):
    kept, dropped = lagging_feeds(spark, tmp_path, "0 seconds")
    assert dropped > 0 and kept + dropped == 12


def test_the_delay_must_be_chosen(spark, tmp_path):
    with pytest.raises(TypeError):
        stream.stream_bars(stream.read_tick_stream(spark, str(tmp_path), "*.parquet"))


def test_a_repeated_batch_continues_from_the_same_past(spark, split_events, tmp_path):
    def run():
        feed = stream.read_tick_stream(spark, split_events, "*.parquet", max_files=1)
        start_contexts(stream.stream_bars(feed, "0 seconds"), tmp_path, 2).awaitTermination()
        return sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))

    whole = run()
    # Without its commit the last batch counts as broken off and is run again.
    commits = [p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == whole


def test_sheets_are_read_for_the_days_of_a_batch_only(spark, inputs, tmp_path):
    path = str(tmp_path / "sheets")
    write_by_session(sheets_from_ticks(inputs.ticks), path)
    asked = []

    def load(first, last):
        asked.append((first, last))
        return stored_sheets(spark, path)(first, last)

    bars_of_day = inputs.bars.filter("session_date = date'2024-01-09'")
    sheets = sinks.zoned_sheets(bars_of_day, load)
    assert asked == [(dt.date(2024, 1, 9),) * 2] and sheets.count() == bars_of_day.select("symbol").distinct().count()
    plan = sheets._jdf.queryExecution().executedPlan().toString()
    assert "session_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sinks.zoned_sheets(inputs.bars.filter("false"), load).count() == 0 and len(asked) == 1


def entered(spark, folder, sheets, tmp_path, delay, max_files=None):
    entries.start_entries(
        stream.read_tick_stream(spark, folder, "*.parquet", max_files=max_files),
        of_days(sheets),
        str(tmp_path / "out"),
        str(tmp_path / "cp"),
        delay,
        partitions=2,
        availableNow=True,
    ).awaitTermination()
    return wall_clock(spark.read.parquet(str(tmp_path / "out")))


def test_live_zone_entries_equal_those_of_the_batch(spark, inputs, split_events, tmp_path):
    live = entered(spark, split_events, inputs.sheets, tmp_path, "0 seconds", max_files=1)
    assert live.select("batch_id").distinct().count() > 1
    batch = zones.intrabar_entries(inputs.ticks, inputs.zoned_context)
    assert sorted(map(str, live.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_an_entry_is_raised_once_by_the_forming_bar(spark, tmp_path):
    folder = str(tmp_path / "feed")
    sheets = make_sheets(spark, {"g1p": 19100.0, "g2p": 19102.0})
    minute = dt.timedelta(minutes=1)
    columns = ["ts", "side", "event_id", "px"]

    def run(*ticks):
        write_events(spark, ticks, folder)
        return sorted(tuple(r) for r in entered(spark, folder, sheets, tmp_path, "2 hours").select(columns).collect())

    first = (at(DAY, 10), "below", 2, 19100.0)
    assert run((at(DAY, 9), 1, 19000), (at(DAY, 10), 2, 19100)) == [first]
    # The bar enters again and closes outside; a tick older than the bars kept changes nothing.
    assert run((at(DAY, 10) + minute, 3, 19000), (at(DAY, 10) + 2 * minute, 4, 19101)) == [first]
    again = (at(DAY, 12), "below", 6, 19101.0)
    assert run((at(DAY, 11), 5, 19000), (at(DAY, 12), 6, 19101), (at(DAY, 8), 7, 19101)) == [first, again]
