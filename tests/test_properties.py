"""Statements that hold whatever the input, over the given data and over shuffled rows."""

from __future__ import annotations

import random

import pytest
from helpers import make_sheets
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.operators import alerts, joins, levels, nodes, sessions, zones
from levelmap.plans import catalog, publish
from levelmap.plans.catalog import Inputs
from levelmap.schemas import SLOTS
from levelmap.sources.sheets import sheets_from_ticks, with_defaults
from levelmap.sources.sinks import write_by_session
from levelmap.sources.ticks import bars
from test_twin import group_levels

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


def test_follow_never_with_positive_gamma(spark):
    modes = catalog.queries()["regime_mode"](spark, FOLDER)
    counts = {tuple(r[:2]): r[2] for r in modes.groupBy("net_gex_pos", "mode").count().collect()}
    assert (True, fixed.MODE_FOLLOW) not in counts
    assert counts[(False, fixed.MODE_FOLLOW)] > 0


def test_flip_state_never_reverts_within_a_session(inputs):
    states = nodes.flip_states(inputs.context)
    bounds = states.groupBy("symbol", "session_date", "slot").agg(
        F.min(F.when(F.col("flipped"), F.col("ts"))).alias("first_true"),
        F.max(F.when(~F.col("flipped"), F.col("ts"))).alias("last_false"),
    )
    assert bounds.filter("last_false > first_true").count() == 0


def test_one_flip_event_per_flipped_node(inputs):
    events = nodes.flip_events(inputs.context).groupBy("symbol", "session_date", "slot").count()
    flipped = nodes.node_states(inputs.session_sheets).filter("flipped")
    assert events.filter("count > 1").count() == 0
    assert events.count() == flipped.count() == flipped.join(events, ["symbol", "session_date", "slot"]).count()


def test_zones_fit_the_sheet(inputs):
    found = zones.zone_rows(inputs.sheets)
    active = levels.active_levels(inputs.sheets).groupBy("symbol", "session_date").count()
    per_sheet = found.groupBy("symbol", "session_date").agg(F.sum("n").alias("members"))
    assert per_sheet.join(active, ["symbol", "session_date"]).filter("members > count").count() == 0
    assert found.filter("n < 2 or center < start or center - start > 15").count() == 0
    members = found.alias("z").join(
        levels.active_levels(inputs.sheets).alias("v"), ["symbol", "session_date"]
    ).filter("v.price between z.start and z.start + 15")
    assert members.count() == found.agg(F.sum("n")).first()[0]


def test_clusters_of_random_sheets_equal_a_plain_grouping(spark):
    rng = random.Random(7)
    sheets = []
    for n in range(400):
        chosen = rng.sample([s.price_col for s in SLOTS], rng.randint(0, 25))
        spread = rng.choice([4, 40, 400, 4000])
        prices = {c: rng.randint(-spread, spread) / 4 for c in chosen}
        sheets.append({"symbol": str(n), "tol": rng.choice([0.25, 2.0, 15.0]), **prices})
    made = make_sheets(spark, *sheets)
    expected = {
        (row.symbol, *box) for row in made.collect() for box in group_levels(row.asDict())
    }
    got = zones.zone_rows(made).select("symbol", "zone_seq", "bot", "top").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 400


def test_order_and_spread_of_ticks_do_not_matter(spark, inputs):
    shuffled = inputs.ticks.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))

    def everything(ticks):
        sheets = with_defaults(sheets_from_ticks(ticks))
        zoned = zones.with_zones(sheets)
        context = joins.by_session(sessions.bar_context(bars(ticks)), zoned)
        raised = alerts.alerts(context).select("symbol", "ts", "kind", "close")
        entered = zones.intrabar_entries(ticks, context).select("symbol", "ts", "side", "event_id", "px")
        return sorted(raised.collect()), sorted(entered.collect())

    assert everything(shuffled) == everything(inputs.ticks)


def test_unpacked_and_packed_bars_agree(inputs):
    packed, plain = bars(inputs.ticks), bars(inputs.ticks, sequential_ids=False)
    assert sorted(packed.collect()) == sorted(plain.collect())


def test_any_interval(inputs):
    for interval in ("5 minutes", "1 day"):
        made = bars(inputs.ticks, interval)
        assert made.agg(F.sum("ticks")).first()[0] == inputs.ticks.count()
        assert made.filter("low > least(open, close) or high < greatest(open, close)").count() == 0


def test_published_tables_equal_the_queries(spark, inputs, tmp_path):
    out = str(tmp_path)
    publish.publish_bars(inputs.ticks, out)
    publish.publish_sheets(sheets_from_ticks(inputs.ticks), out)
    publish.publish_results(spark, out)
    for table, query in (
        ("bars", "bars_1h"),
        ("alerts", "alerts"),
        ("snapshot", "snapshot"),
        ("summary", "snapshot_rows"),
        ("annotations", "annotations"),
    ):
        derived = catalog.queries()[query](spark, FOLDER)
        stored = spark.read.parquet(f"{out}/{table}").select(*derived.columns)
        assert sorted(map(str, stored.collect())) == sorted(map(str, derived.collect())), table


def test_rewriting_one_day_keeps_the_others(spark, inputs, tmp_path):
    path = str(tmp_path / "bars")
    write_by_session(inputs.bars, path)
    before = spark.read.parquet(path).count()
    one = inputs.bars.filter("session_date = date'2024-01-05'")
    write_by_session(one, path)
    assert spark.read.parquet(path).count() == before
