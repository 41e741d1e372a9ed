"""Publishing by range: what it opens, what it replaces, and what a broken-off job leaves."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from helpers import DAY, at, make_sheets, make_ticks
from pyspark.sql import functions as F

from levelmap.operators import alerts, joins, sessions, zones
from levelmap.plans import publish
from levelmap.schemas import BAR_SCHEMA
from levelmap.sources.ticks import bars
from levelmap.sources.versions import DayTables

DAYS = [DAY + dt.timedelta(days=i) for i in range(4)]
ENTERED = {"zero_gamma": 19010.0, "g1p": 19020.0, "g2p": 19022.0, "r1p": 19050.0, "mq_cr0": 19100.0, "mq_ps0": 19000.0}


def ticks_of(spark, closes):
    """Ticks of symbols by day: two bars of two ticks each; S trades daily, T on the first and last day."""
    rows, event = [], 0
    frames = []
    for symbol, by_day in closes.items():
        rows = []
        for day, prices in by_day.items():
            for hour, px in enumerate(prices):
                for minute in (0, 30):
                    event += 1
                    rows.append((at(day, 9 + hour) + dt.timedelta(minutes=minute), event, px + minute / 10))
        frames.append(make_ticks(spark, rows, symbol))
    return frames[0].unionByName(frames[1])


CLOSES = {
    "S": {DAYS[0]: (19000, 19021), DAYS[1]: (19060, 19022), DAYS[2]: (18980, 19100), DAYS[3]: (19010, 19120)},
    "T": {DAYS[0]: (19019, 19040), DAYS[3]: (19021, 19000)},
}


def sheets_of(spark, days=DAYS, **other):
    return make_sheets(spark, *({**ENTERED, **other, "symbol": s, "session_date": d} for s in "ST" for d in days)).drop("max_change_ok")


def rows_of(spark, out, table, *columns):
    tables = DayTables(spark, out)
    paths = [f"{out}/{table}/version={v}/session_date={d}" for d, v in tables.index().get(table, {}).items()]
    if not paths:
        return []
    df = spark.read.option("basePath", f"{out}/{table}").parquet(*paths).drop("version")
    return sorted(map(str, df.select(*sorted(columns or df.columns)).collect()))


TABLES = ("bars", "carry", "alerts", "alert_feed", "snapshot", "summary", "annotations", "touches")


def state(spark, out):
    return {t: rows_of(spark, out, t) for t in TABLES}


def whole(spark, folder, closes, sheets, keep="true", **options):
    out = str(folder)
    publish.publish_bars(ticks_of(spark, closes).filter(keep), out)
    publish.publish_sheets(sheets, out)
    publish.publish_results(spark, out, **options)
    return state(spark, out)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("base"))
    return out, whole(spark, out, CLOSES, sheets_of(spark))


def test_feed_is_alerts_and_entries(spark, base):
    out, _ = base
    ticks, sheets = ticks_of(spark, CLOSES), zones.with_zones(publish.with_defaults(sheets_of(spark)))
    context = joins.by_session(sessions.bar_context(bars(ticks)), sheets)
    feed = alerts.alert_feed(context, zones.intrabar_entries(ticks, context))
    kinds = {r.kind for r in feed.collect()}
    assert {"intrabar_zone_entry_below", "intrabar_zone_entry_above", "node_flip", "pin_break_up"} <= kinds
    assert rows_of(spark, out, "alert_feed") == sorted(map(str, feed.select(*sorted(feed.columns)).collect()))
    assert feed.groupBy("symbol", "ts", "kind").count().filter("count > 1").count() == 0


def test_a_corrected_bar_restates_until_each_symbol_has_traded(spark, tmp_path):
    as_of = True
    out = str(tmp_path / "partial")
    whole(spark, out, CLOSES, sheets_of(spark), as_of=as_of)
    corrected = {"S": CLOSES["S"], "T": {DAYS[0]: (19019, 19005), DAYS[3]: CLOSES["T"][DAYS[3]]}}
    ticks = ticks_of(spark, corrected)
    publish.publish_bars(ticks.filter(F.to_date("ts") == F.lit(DAYS[0])), out)
    stated = publish.publish_results(spark, out, first=DAYS[0], last=DAYS[0], as_of=as_of)
    # T does not trade on the second and third day, so its last close is carried through both.
    assert stated == DAYS
    assert state(spark, out) == whole(spark, tmp_path / "whole", corrected, sheets_of(spark), as_of=as_of)


def test_a_corrected_sheet_restates_its_day_only(spark, tmp_path):
    out = str(tmp_path / "partial")
    before = whole(spark, out, CLOSES, sheets_of(spark))
    index = DayTables(spark, out).index()
    new = sheets_of(spark, [DAYS[1]], g1p=19500.0)
    publish.publish_sheets(new, out)
    assert publish.publish_results(spark, out, first=DAYS[1], last=DAYS[1]) == DAYS[1:2]
    after = DayTables(spark, out).index()
    changed = {(t, d) for t in after for d in after[t] if after[t][d] != index[t].get(d)}
    assert {d for _, d in changed} == {DAYS[1]}
    sheets = sheets_of(spark, [DAYS[0], *DAYS[2:]]).unionByName(new)
    want = whole(spark, tmp_path / "whole", CLOSES, sheets)
    mine = state(spark, out)
    assert mine == want != before
    assert publish.published(spark, out, "bars", BAR_SCHEMA, DAYS[1], DAYS[1]).count() == 2


def test_as_of_equals_the_join_over_all_history(spark, tmp_path):
    out = str(tmp_path)
    sheets = sheets_of(spark, [DAYS[0], DAYS[2]])
    publish.publish_bars(ticks_of(spark, CLOSES), out)
    publish.publish_sheets(sheets, out)
    for first, last in ((DAYS[0], DAYS[1]), (DAYS[2], DAYS[3])):
        publish.publish_results(spark, out, first=first, last=last, as_of=True)
    context = joins.as_of(sessions.bar_context(bars(ticks_of(spark, CLOSES))), zones.with_zones(publish.with_defaults(sheets)))
    want = alerts.alerts(context)
    assert rows_of(spark, out, "alerts") == sorted(map(str, want.select(*sorted(want.columns)).collect()))


def test_a_day_opens_its_own_folders_and_the_carry(spark, base, monkeypatch):
    out, before = base
    opened = []
    real = publish.read_days

    def watched(spark, folder, schema, days):
        df = real(spark, folder, schema, days)
        opened.extend(df.inputFiles())
        return df

    monkeypatch.setattr(publish, "read_days", watched)
    monkeypatch.setattr("levelmap.sources.versions.read_days", watched)
    publish.publish_results(spark, out, first=DAYS[2], last=DAYS[2])
    days = {(re.search(rf"{out}/(\w+)/", f)[1], re.search(r"session_date=([\d-]+)", f)[1]) for f in opened}
    assert {d for t, d in days if t != "carry"} == {str(DAYS[2])}
    assert {d for t, d in days if t == "carry"} == {str(DAYS[1]), str(DAYS[2])}
    assert state(spark, out) == before


def test_an_emptied_day_is_empty(spark, tmp_path):
    out = str(tmp_path)
    whole(spark, out, CLOSES, sheets_of(spark))
    ticks = ticks_of(spark, CLOSES).filter("false")
    publish.publish_bars(ticks, out, days=[DAYS[1]])
    publish.publish_results(spark, out, first=DAYS[1], last=DAYS[1])
    index = DayTables(spark, out).index()
    assert all(DAYS[1] not in index[t] for t in ("bars", "alerts", "alert_feed", "snapshot", "summary", "annotations"))
    want = whole(spark, tmp_path / "whole", CLOSES, sheets_of(spark), keep=f"date(ts) != date'{DAYS[1]}'")
    assert state(spark, out) == want


def test_a_job_that_dies_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    before = whole(spark, out, CLOSES, sheets_of(spark))
    publish.publish_sheets(sheets_of(spark, g1p=19500.0), out)

    def broken(self):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(DayTables, "switch", broken)
        with pytest.raises(KeyboardInterrupt):
            publish.publish_results(spark, out)
    assert state(spark, out) == before
    publish.publish_results(spark, out)
    assert state(spark, out) == whole(spark, tmp_path / "whole", CLOSES, sheets_of(spark, g1p=19500.0)) != before


def test_old_versions_go_and_settings_stay(spark, tmp_path):
    out = str(tmp_path)
    whole(spark, out, CLOSES, sheets_of(spark))
    for _ in range(4):
        publish.publish_results(spark, out, first=DAYS[3], last=DAYS[3])
    tables = DayTables(spark, out)
    assert len(tables.files.names("index")) == 2
    kept = [v for v in tables.files.names("alerts") if tables.files.names(f"alerts/{v}") and f"session_date={DAYS[3]}" in tables.files.names(f"alerts/{v}")]
    assert len(kept) == 2 and tables.read("bars", BAR_SCHEMA).count() == 12
    with pytest.raises(ValueError, match="1 hour"):
        publish.publish_bars(ticks_of(spark, CLOSES), out, interval="5 minutes")
