"""Boundaries of every rule on literal rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import DAY, at, context_with_sheets, make_bars, make_sheets, make_ticks, session_rows, values, zone_list
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.functions import nodes as node_rules
from levelmap.functions import pin as pin_rules
from levelmap.functions import regime
from levelmap.functions import zones as zone_rules
from levelmap.operators import alerts, joins, levels, nodes, pin, sessions, snapshot, zones
from levelmap.schemas import SLOTS, Params, sheet_defaults
from levelmap.sources import ticks as tick_source
from levelmap.sources.sheets import read_sheets, sheets_from_histogram, sheets_from_ticks

NEXT = DAY + dt.timedelta(days=1)


def column_values(spark, expression, *rows):
    """Evaluates an expression over columns a, b, c, ... of the given rows."""
    names = "abcdefgh"[: len(rows[0])]
    types = []
    for i, name in enumerate(names):
        sample = next((r[i] for r in rows if r[i] is not None), 0.0)
        kind = "boolean" if isinstance(sample, bool) else "double" if isinstance(sample, float) else "int"
        types.append(f"{name} {kind}")
    df = spark.createDataFrame(list(rows), ", ".join(types))
    return [r[0] for r in df.select(expression.alias("x")).collect()]


# --- regime -------------------------------------------------------------------


def test_regime_matrix_ties_and_unset_pivot(spark):
    mode = regime.regime_mode(F.col("a"), F.col("b"), F.col("c"))
    got = column_values(
        spark,
        mode,
        (True, 101.0, 100.0),
        (False, 99.0, 100.0),
        (True, 99.0, 100.0),
        (False, 101.0, 100.0),
        (True, 100.0, 100.0),
        (False, 100.0, 100.0),
        (True, 50.0, 0.0),
        (False, 50.0, 0.0),
        (True, 50.0, None),
    )
    fade, follow, between = fixed.MODE_FADE, fixed.MODE_FOLLOW, fixed.MODE_TRANSITION
    assert got == [fade, follow, between, between, between, between, fade, between, fade]


def test_distance_and_mirror_need_a_pivot(spark):
    rows = [(105.0, 100.0), (105.0, 0.0), (105.0, None), (95.0, 100.0)]
    assert column_values(spark, regime.zg_distance(F.col("a"), F.col("b")), *rows) == [5.0, None, None, -5.0]
    assert column_values(spark, regime.mirror_target(F.col("a"), F.col("b")), *rows) == [95.0, None, None, 105.0]


def test_pivot_texts(spark):
    rows = [(105.5, 100.25), (95.0, 100.25), (95.0, 0.0)]
    assert column_values(spark, regime.zg_text(F.col("a"), F.col("b")), *rows) == [
        "100.25  (+5.2 pt)",
        "100.25  (-5.2 pt)",
        "0  (n/a)",
    ]
    assert column_values(spark, regime.mirror_text(F.col("a"), F.col("b")), *rows) == ["95", "105.5", "n/a"]


def test_max_change_is_passed_on_and_classed(spark):
    sheets = make_sheets(
        spark,
        *[{"symbol": str(i), "max_change": v} for i, v in enumerate((*fixed.MAX_CHANGE_OPTIONS, "else", None))],
    )
    got = values(sheets.withColumn("bias", regime.max_change_bias(F.col("max_change"))), "symbol", "bias", "max_change_ok")
    assert got == [
        ("0", "neutral", True),
        ("1", "bearish", True),
        ("2", "bullish", True),
        ("3", "neutral", False),
        ("4", "neutral", True),
    ]


# --- sheets and levels --------------------------------------------------------


def test_sheet_defaults_fill_missing_columns_and_nulls(spark):
    raw = spark.createDataFrame([("S", DAY, None, 7.0)], "symbol string, session_date date, zero_gamma double, g1p double")
    from levelmap.sources.sheets import with_defaults

    row = with_defaults(raw, Params(tol=3.0)).first().asDict()
    expected = {name: default for name, (_, default) in sheet_defaults(Params(tol=3.0)).items()}
    expected |= {"g1p": 7.0, "symbol": "S", "session_date": DAY, "max_change_ok": True}
    assert row == expected
    assert row["gx5l"] == "GEX5" and row["qq3l"] == "QQQ3" and row["net_gex_pos"] is True


def test_slots_are_the_list_order():
    assert [s.slot for s in SLOTS] == list(range(25))
    families = [s.family for s in SLOTS]
    assert [families.count(f) for f in ("green", "red", "named", "generic", "correlated", "pivot")] == [4, 4, 8, 5, 3, 1]
    assert SLOTS[11].price_col == "mq_cr0" and SLOTS[12].price_col == "mq_ps0" and SLOTS[24].price_col == "zero_gamma"


def test_active_levels_take_zero_and_null_as_unset_and_keep_negatives(spark):
    sheets = make_sheets(spark, {"g1p": -5.0, "g2p": 0.0, "r1p": None, "gx1p": 9.0, "gx1l": "mine"})
    assert levels.level_rows(sheets).count() == 25
    got = values(levels.active_levels(sheets), "slot", "source", "price")
    assert got == [(0, fixed.SOURCE_GREEN, -5.0), (16, "mine", 9.0)]


def test_level_order_breaks_ties_by_slot(spark):
    sheets = make_sheets(spark, {"zero_gamma": 100.0, "r1p": 100.0, "g2p": 100.0, "mq_cr": 99.0})
    assert values(levels.level_order(sheets), "pos", "slot") == [(1, 8), (2, 1), (3, 4), (4, 24)]


# --- zones --------------------------------------------------------------------


def starts_and_sizes(rows):
    return [(r[3], r[5]) for r in rows]


def test_cluster_is_anchored_at_its_first_level(spark):
    got = zone_list(spark, g1p=100.0, g2p=110.0, g3p=120.0)
    assert [(r[2], r[3], r[4], r[5]) for r in got] == [(1, 100.0, 105.0, 2)]


def test_cluster_tolerance_is_inclusive(spark):
    got = zone_list(spark, g1p=100.0, g2p=115.0)
    assert [(r[4], r[5]) for r in got] == [(107.5, 2)]
    assert zone_list(spark, g1p=100.0, g2p=115.25) == []


def test_cluster_sources_keep_order_and_repeats(spark):
    got = zone_list(spark, r1p=100.0, g2p=100.0, g3p=101.0)
    assert [r[6] for r in got] == ["GEXBot Green, GEXBot Red, GEXBot Green"]


def test_cluster_sequence_of_anchors(spark):
    prices = [100, 100, 110, 115, 116, 131, 140]
    fields = dict(zip(["g1p", "g2p", "g3p", "g4p", "r1p", "r2p", "r3p"], map(float, prices)))
    assert starts_and_sizes(zone_list(spark, **fields)) == [(100.0, 4), (116.0, 2)]


def test_members_may_lie_outside_the_box(spark):
    (row,) = zone_list(spark, g1p=100.0, g2p=100.0, g3p=100.0, g4p=115.0)
    assert (row[4], row[7], row[8]) == (103.75, 96.25, 111.25)


def test_no_zones_without_two_levels(spark):
    assert zone_list(spark) == []
    assert zone_list(spark, g1p=100.0) == []


def test_tolerance_of_the_sheet_wins_over_the_default(spark):
    assert starts_and_sizes(zone_list(spark, g1p=100.0, g2p=130.0, tol=30.0)) == [(100.0, 2)]


def test_stars_and_zone_label(spark):
    got = column_values(spark, zone_rules.stars(F.col("a")), (0,), (1,), (2,), (3,), (4,), (5,), (9,))
    assert [len(s) for s in got] == [1, 1, 2, 3, 4, 5, 5]
    (row,) = zone_list(spark, g1p=100.0, mq_cr=101.5)
    assert row[10] == "★★  100.75\nGEXBot Green, MQ Call Resistance"


def test_zone_centred_on_the_close_is_below(spark):
    side = zone_rules.zone_side(F.col("a"), F.col("b"))
    assert column_values(spark, side, (100.0, 100.0), (100.25, 100.0), (99.0, 100.0)) == ["below", "above", "below"]


def test_zone_counts_include_sheets_without_zones(spark):
    bars = make_bars(spark, [(DAY, 9, 100.0), (NEXT, 9, 100.0)])
    sheets = make_sheets(spark, {"g1p": 90.0, "g2p": 91.0, "r1p": 120.0, "r2p": 121.0}, {"session_date": NEXT})
    got = values(zones.zone_counts(session_rows(bars, sheets)), "session_date", "zones_above", "zones_below")
    assert got == [(DAY, 1, 1), (NEXT, 0, 0)]


# --- zone entries -------------------------------------------------------------

BOX = {"g1p": 100.0, "g2p": 100.0}  # center 100, box 92.5 to 107.5


def entries(spark, closes, *sheets):
    bars = make_bars(spark, closes)
    return values(zones.zone_entries(context_with_sheets(bars, make_sheets(spark, *sheets))), "ts", "side")


def test_entry_bounds_are_inclusive_from_below(spark):
    assert entries(spark, [(DAY, 9, 92.25), (DAY, 10, 92.5)], BOX) == [(at(DAY, 10), "below")]
    assert entries(spark, [(DAY, 9, 92.25), (DAY, 10, 107.5)], BOX) == [(at(DAY, 10), "below")]
    assert entries(spark, [(DAY, 9, 92.25), (DAY, 10, 107.75)], BOX) == []


def test_entry_bounds_are_inclusive_from_above(spark):
    assert entries(spark, [(DAY, 9, 107.75), (DAY, 10, 92.5)], BOX) == [(at(DAY, 10), "above")]
    assert entries(spark, [(DAY, 9, 107.5), (DAY, 10, 100.0)], BOX) == []


def test_first_bar_enters_nothing(spark):
    assert entries(spark, [(DAY, 9, 100.0)], BOX) == []


def test_entry_counts_across_midnight(spark):
    closes = [(DAY, 23, 80.0), (NEXT, 0, 100.0)]
    assert entries(spark, closes, {"session_date": NEXT, **BOX}) == [(at(NEXT, 0), "below")]


def test_entry_flags_cover_every_bar_with_a_sheet(spark):
    bars = make_bars(spark, [(DAY, 9, 80.0), (DAY, 10, 100.0), (DAY, 11, 120.0), (DAY, 12, 100.0), (NEXT, 9, 1.0)])
    got = values(zones.entry_flags(context_with_sheets(bars, make_sheets(spark, BOX))), "ts", "from_below", "from_above")
    assert [g[1:] for g in got] == [(False, False), (True, False), (False, False), (False, True)]


def test_touch_counts_start_at_zero_even_without_bars(spark):
    bars = make_bars(spark, [(DAY, 9, 80.0), (DAY, 10, 100.0), (DAY, 11, 80.0), (DAY, 12, 100.0)])
    two = {**BOX, "r1p": 300.0, "r2p": 300.0}
    sheets = make_sheets(spark, two, {"session_date": NEXT, **BOX})
    got = zones.touch_counts(zones.with_zones(sheets), sessions.bar_context(bars))
    assert values(got, "session_date", "zone_seq", "touches") == [(DAY, 1, 2), (DAY, 2, 0), (NEXT, 1, 0)]


@pytest.mark.parametrize("timezone", ["UTC", "America/New_York"])  # the second takes the unpacked way
def test_intrabar_entry_takes_the_first_tick_inside(spark, timezone):
    spark.conf.set("spark.sql.session.timeZone", timezone)
    try:
        minute = dt.timedelta(minutes=1)
        start, later = at(DAY, 9), at(DAY, 10)
        ticks = make_ticks(
            spark,
            [
                (start, 1, 80.0),
                (later + minute, 9, 100.0),
                (later + minute, 5 << 40, 99.0),
                (later + minute, 4, 120.0),
                (later + 2 * minute, 2, 95.0),
                (later + 3 * minute, 3, 80.0),
            ],
        )
        context = context_with_sheets(tick_source.bars(ticks), make_sheets(spark, BOX))
        got = values(zones.intrabar_entries(ticks, context), "ts", "side", "tick_ts", "event_id", "px")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The bar closes outside the zone again, yet its forming price was inside.
    assert got == [(later, "below", later + minute, 9, 100.0)]


# --- nodes --------------------------------------------------------------------


def flips(spark, closes, *sheets):
    bars = make_bars(spark, closes)
    return context_with_sheets(bars, make_sheets(spark, *sheets))


def test_flip_is_strict_and_latched_with_one_event(spark):
    closes = [(DAY, 9, 90.0), (DAY, 10, 89.75), (DAY, 11, 150.0), (DAY, 12, 80.0)]
    context = flips(spark, closes, {"g1p": 100.0})
    assert values(nodes.flip_states(context), "ts", "flipped") == [
        (at(DAY, 9), False),
        (at(DAY, 10), True),
        (at(DAY, 11), True),
        (at(DAY, 12), True),
    ]
    assert values(nodes.flip_events(context), "slot", "flip_ts", "close") == [(0, at(DAY, 10), 89.75)]
    assert [v[1] for v in values(context.select("ts", nodes.any_flip().alias("x")), "ts", "x")] == [
        False,
        True,
        False,
        False,
    ]


def test_red_node_flips_above_its_buffer(spark):
    context = flips(spark, [(DAY, 9, 110.0), (DAY, 10, 110.25)], {"r3p": 100.0})
    assert values(nodes.flip_events(context), "slot", "flip_ts") == [(6, at(DAY, 10))]


def test_reset_bar_can_flip_again(spark):
    sheets = {"g1p": 100.0}, {"session_date": NEXT, "g1p": 100.0}
    context = flips(spark, [(DAY, 9, 80.0), (NEXT, 0, 80.0), (NEXT, 1, 80.0)], *sheets)
    assert values(nodes.flip_events(context), "flip_ts") == [(at(DAY, 9),), (at(NEXT, 0),)]


def test_two_nodes_flip_on_one_bar(spark):
    context = flips(spark, [(DAY, 9, 80.0)], {"g1p": 100.0, "g2p": 95.0, "r1p": 100.0})
    assert values(nodes.flip_events(context), "slot") == [(0,), (1,)]
    assert context.select(nodes.any_flip().alias("x")).first().x is True


def test_inactive_node_never_breaks(spark):
    context = flips(spark, [(DAY, 9, -50.0)], {})
    assert nodes.node_breaks(context).count() == 0
    assert context.select(nodes.any_flip().alias("x")).first().x is False


def test_node_break_is_per_bar_and_not_latched(spark):
    bars = make_bars(spark, [(DAY, 9, 80.0), (DAY, 10, 100.0)])
    joined = joins.by_session(bars, make_sheets(spark, {"g1p": 100.0}))
    assert values(nodes.node_breaks(joined), "ts", "is_break") == [(at(DAY, 9), True), (at(DAY, 10), False)]


def test_roles_swap_when_flipped(spark):
    role = node_rules.role(F.col("a"), F.col("b"))
    rows = [(True, False), (True, True), (False, False), (False, True)]
    assert column_values(spark, role, *rows) == ["support", "resistance", "resistance", "support"]


def test_size_classes(spark):
    rows = [(-1.0,), (0.0,), (499.0,), (500.0,), (999.0,), (1000.0,), (1999.0,), (2000.0,), (None,)]
    assert column_values(spark, node_rules.size_class(F.col("a")), *rows) == [1, 1, 1, 2, 2, 3, 3, 4, 1]


def test_node_labels(spark):
    bars = make_bars(spark, [(DAY, 9, 80.0), (DAY, 10, 120.0)])
    fields = {"g1p": 100.0, "g1s": 1250.0, "r2p": 105.0, "r4p": 500.0, "r4s": 900.0}
    got = values(nodes.node_states(session_rows(bars, make_sheets(spark, fields))), "slot", "label", "role")
    assert got == [
        (0, "G1 $1,250M [⟳ RES]", "resistance"),
        (5, "R2 [⟳ SUP]", "support"),
        (7, "R4 $900M", "resistance"),
    ]


# --- sessions -----------------------------------------------------------------


def test_day_of_month_reset_ignores_a_gap_to_the_same_number(spark):
    later = dt.date(2024, 2, 15)
    bars = make_bars(spark, [(DAY, 9, 1.0), (DAY, 10, 1.0), (later, 9, 1.0), (later + dt.timedelta(1), 9, 1.0)])
    got = values(sessions.session_resets(bars), "ts", "is_new", "session_seq")
    assert [g[1:] for g in got] == [(True, 1), (False, 1), (False, 1), (True, 2)]


def test_previous_close_crosses_sessions_and_gaps(spark):
    later = DAY + dt.timedelta(days=4)
    bars = make_bars(spark, [(DAY, 9, 1.0), (DAY, 23, 2.0), (later, 4, 3.0), (later, 5, 4.0)])
    got = values(sessions.bar_context(bars), "ts", "prev_close", "low_before", "high_before")
    assert [g[1:] for g in got] == [(None, None, None), (1.0, 1.0, 1.0), (2.0, None, None), (3.0, 3.0, 3.0)]


def test_last_bar_per_session(spark):
    bars = make_bars(spark, [(DAY, 9, 1.0), (DAY, 23, 2.0), (NEXT, 4, 3.0)])
    assert values(sessions.last_bar(bars), "ts", "close") == [(at(DAY, 23), 2.0), (at(NEXT, 4), 3.0)]


# --- joins --------------------------------------------------------------------


def test_sheet_stays_in_force_until_the_next_one(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(5)]
    bars = make_bars(spark, [(d, 9, 1.0) for d in days])
    sheets = make_sheets(
        spark, {"session_date": days[1], "g1p": 1.0}, {"session_date": days[3], "g1p": 2.0}
    )
    got = values(joins.as_of(bars, sheets), "session_date", "sheet_date", "g1p")
    assert got == [
        (days[1], days[1], 1.0),
        (days[2], days[1], 1.0),
        (days[3], days[3], 2.0),
        (days[4], days[3], 2.0),
    ]
    assert values(joins.by_session(bars, sheets), "session_date") == [(days[1],), (days[3],)]


def test_sheet_entered_on_a_day_without_bars_counts_later(spark):
    bars = make_bars(spark, [(NEXT, 9, 1.0), (NEXT, 10, 1.0)])
    got = values(joins.as_of(bars, make_sheets(spark, {"g1p": 3.0})), "ts", "sheet_date", "g1p")
    assert got == [(at(NEXT, 9), DAY, 3.0), (at(NEXT, 10), DAY, 3.0)]


def test_static_sheet_is_the_latest_for_all_history(spark):
    bars = make_bars(spark, [(DAY, 9, 1.0), (NEXT, 9, 1.0)])
    sheets = make_sheets(spark, {"g1p": 1.0}, {"session_date": NEXT, "g1p": 2.0})
    assert values(joins.static(bars, sheets), "session_date", "sheet_date", "g1p") == [(DAY, NEXT, 2.0), (NEXT, NEXT, 2.0)]


# --- pin ----------------------------------------------------------------------


def test_pin_classes(spark):
    kind = pin_rules.pin_class(F.col("a"), F.lit(300.0), F.lit(600.0))
    rows = [(-5.0,), (299.75,), (300.0,), (599.75,), (600.0,), (None,)]
    narrow, normal, wide = fixed.PIN_NARROW, fixed.PIN_NORMAL, fixed.PIN_WIDE
    assert column_values(spark, kind, *rows) == [narrow, narrow, normal, normal, wide, None]


def test_pin_needs_both_edges_and_may_be_crossed(spark):
    sheets = make_sheets(
        spark,
        {"symbol": "A", "mq_ps0": 105.0, "mq_cr0": 100.0},
        {"symbol": "B", "mq_cr0": 100.0},
        {"symbol": "C", "mq_ps0": 100.0, "mq_cr0": 812.5},
    )
    assert values(pin.pin_boxes(sheets), "symbol", "width", "mid") == [("A", -5.0, 102.5), ("C", 712.5, 456.25)]
    assert values(pin.pin_texts(sheets), "symbol", "box_text", "summary_text") == [
        ("A", "📌 STRETTO  -5 pt", "STRETTO (-5 pt)"),
        ("B", None, "n/a"),
        ("C", "📌 AMPIO  712.5 pt", "AMPIO (712 pt)"),
    ]


def test_pin_break_repeats_and_needs_one_edge(spark):
    bars = make_bars(spark, [(DAY, 9, 110.0), (DAY, 10, 110.25), (DAY, 11, 111.0), (DAY, 12, 50.0)])
    joined = joins.by_session(bars, make_sheets(spark, {"mq_cr0": 100.0}))
    got = values(pin.pin_breaks(joined), "ts", "side", "threshold")
    assert got == [(at(DAY, 10), "up", 110.0), (at(DAY, 11), "up", 110.0)]


def test_pin_break_down(spark):
    bars = make_bars(spark, [(DAY, 9, 90.0), (DAY, 10, 89.75)])
    joined = joins.by_session(bars, make_sheets(spark, {"mq_ps0": 100.0}))
    assert values(pin.pin_breaks(joined), "ts", "side") == [(at(DAY, 10), "down")]


# --- alerts and outputs -------------------------------------------------------


def test_all_five_alerts(spark):
    closes = [(DAY, 9, 80.0), (DAY, 10, 100.0), (DAY, 11, 130.0), (DAY, 12, 100.0), (DAY, 13, 60.0)]
    fields = {**BOX, "mq_cr0": 115.0, "mq_ps0": 72.0}
    sheets = make_sheets(spark, fields, params=Params(tol=4.0))
    context = context_with_sheets(make_bars(spark, closes), sheets)
    assert values(alerts.alerts(context), "ts", "kind") == [
        (at(DAY, 9), "node_flip"),
        (at(DAY, 10), "zone_entry_below"),
        (at(DAY, 11), "pin_break_up"),
        (at(DAY, 12), "zone_entry_above"),
        (at(DAY, 13), "pin_break_down"),
    ]


def test_alert_texts_carry_the_brand(spark):
    context = context_with_sheets(make_bars(spark, [(DAY, 9, 80.0)]), make_sheets(spark, {"g1p": 100.0}))
    row = alerts.alerts(context, brand="XYZ").first()
    assert row.title == "XYZ — Flip livello GEXBot (rottura con momentum)"
    assert row.message.startswith("[XYZ] Un nodo GEXBot ha eseguito il flip!")
    assert "{" not in "".join(t.format(brand="") + m.format(brand="") for _, _, t, m in fixed.ALERTS)


def test_summary_rows(spark):
    bars = make_bars(spark, [(DAY, 9, 101.0), (DAY, 10, 102.5)])
    fields = {"zero_gamma": 100.0, "g1p": 90.0, "g2p": 95.0, "mq_ps0": 50.0, "mq_cr0": 400.0}
    got = values(snapshot.summary_rows(session_rows(bars, make_sheets(spark, fields))), "row_no", "label", "value")
    assert got == [
        (1, "MODE", "FADE EDGES"),
        (2, "Net GEX", "POSITIVO"),
        (3, "Zero Gamma", "100  (+2.5 pt)"),
        (4, "Max Change GEX", "Neutro"),
        (5, "Pin 0DTE", "NORMALE (350 pt)"),
        (6, "LEVELMAP Zones", "▲ 0  ▼ 1"),
        (7, "Target Speculare", "97.5"),
        (8, "Spot", "102.5"),
    ]


def test_annotations(spark):
    bars = make_bars(spark, [(DAY, 9, 80.0)])
    fields = {"g1p": 100.0, "mq_cr0": 101.0, "mq_ps0": 60.0, "gx2p": 300.0, "gx2l": "own", "zero_gamma": 500.0}
    got = values(snapshot.annotations(session_rows(bars, make_sheets(spark, fields))), "kind", "seq", "label", "role")
    assert sorted(got, key=lambda r: (r[0], r[1])) == [
        ("generic", 17, "own", None),
        ("named", 11, "CR 0DTE", None),
        ("named", 12, "PS 0DTE", None),
        ("node", 0, "G1 [⟳ RES]", "resistance"),
        ("pin", 0, "📌 STRETTO  41 pt", None),
        ("pivot", 24, "Zero Gamma / HVL", None),
        ("zone", 1, "★★  100.5\nGEXBot Green, MQ CR 0DTE", "above"),
    ]


# --- ticks --------------------------------------------------------------------


@pytest.mark.parametrize("sequential", [True, False])
def test_bar_ends_break_ties_by_id(spark, sequential):
    first, last = at(DAY, 9), at(DAY, 9) + dt.timedelta(minutes=59, seconds=59, microseconds=999999)
    big = 7 << 40
    ticks = make_ticks(
        spark,
        [(first, big, 1.0), (first, 3, 2.0), (first, 1 << 27, 3.0), (last, 5, 4.0), (last, big, 5.0), (last, 1 << 28, 6.0)],
    )
    row = tick_source.bars(ticks, sequential_ids=sequential).first()
    assert (row.open, row.high, row.low, row.close, row.ticks) == (2.0, 6.0, 1.0, 5.0, 6)


def test_bars_split_at_the_interval_and_take_the_exchange_day(spark):
    ticks = make_ticks(spark, [(at(DAY, 3), 1, 1.0), (at(DAY, 4), 2, 2.0), (at(DAY, 5), 3, 3.0)])
    got = values(tick_source.bars(ticks, tz="America/New_York"), "ts", "session_date")
    before = DAY - dt.timedelta(days=1)
    assert got == [(at(DAY, 3), before), (at(DAY, 4), before), (at(DAY, 5), DAY)]
    assert tick_source.bars(ticks, interval="4 hours").count() == 2


def random_ticks(spark, seed=3):
    """Ticks about both changes of clocks in New York, ids in time order but for some."""
    rng, rows = random.Random(seed), []
    for start in (dt.datetime(2024, 3, 8), dt.datetime(2024, 11, 1)):
        for k in range(900):
            ts = start + dt.timedelta(seconds=rng.randint(0, 6 * 86400), microseconds=rng.randint(0, 10**6 - 1))
            rows.append((ts, rng.choice([k, k << 20, k << 40]), rng.randint(1, 500)))
    return make_ticks(spark, rows)


@pytest.mark.parametrize("tz", ["UTC", "America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("interval", ["1 minute", "4 hours", "1 day", "2 days", "1 week", "40 weeks"])
def test_packed_bars_equal_plain_ones(spark, interval, tz):
    ticks = random_ticks(spark)
    packed, plain = (tick_source.bars(ticks, interval, tz, sequential_ids=s) for s in (True, False))
    assert sorted(packed.collect()) == sorted(plain.collect())
    first = [tick_source.first_ticks_by_price(ticks, interval, tz, s).groupBy("bar", "px").agg(F.min("tick")).collect() for s in (True, False)]
    assert sorted(first[0]) == sorted(first[1])


@pytest.mark.parametrize("tz", ["America/New_York", "Asia/Kolkata"])
@pytest.mark.parametrize("interval", ["1 hour", "4 hours", "1 day"])
def test_no_bar_holds_two_local_days(spark, interval, tz):
    ticks = random_ticks(spark).withColumn("day", tick_source.session_day(F.col("ts"), tz))
    spans = ticks.withColumn("bar", tick_source.bar_start(interval, tz))
    assert spans.groupBy("bar").agg(F.count_distinct("day").alias("n")).filter("n > 1").count() == 0
    assert spans.filter(tick_source.session_day(F.col("bar"), tz) != F.col("day")).count() == 0
    assert spans.filter("bar > ts").count() == 0


def test_nan_prices_are_unset(spark):
    nan = float("nan")
    sheet = make_sheets(spark, {"g1p": nan, "mq_ps0": nan, "zero_gamma": nan}).first()
    assert (sheet.g1p, sheet.mq_ps0, sheet.zero_gamma) == (0.0, 0.0, 0.0)
    values_of = [(1, nan), (2, float("inf")), (3, 4.0), (4, None)]
    events = spark.createDataFrame([("S", at(DAY, 9), i, v) for i, v in values_of], "event_type string, ts timestamp_ntz, event_id long, value double")
    assert [r.event_id for r in tick_source.ticks_from_events(events).collect()] == [3]


def test_the_latest_version_of_a_sheet_wins(spark, tmp_path):
    rows = [("S", DAY, 1.0, at(DAY, 8)), ("S", DAY, 2.0, at(DAY, 10)), ("S", DAY, 3.0, at(DAY, 9)), ("S", DAY, 9.0, None)]
    path = str(tmp_path / "sheets")
    spark.createDataFrame(rows, "symbol string, session_date date, g1p double, entered_at timestamp_ntz").write.parquet(path)
    assert [r.g1p for r in read_sheets(spark, path).collect()] == [2.0]
    spark.createDataFrame([r[:3] for r in rows], "symbol string, session_date date, g1p double").write.parquet(path + "2")
    assert [r.g1p for r in read_sheets(spark, path + "2").collect()] == [9.0]


def test_sheets_of_a_day_of_off_grid_prices(spark):
    """More prices than a window should hold, most in one range: the ranks are those of the sorted ticks."""
    rng = random.Random(8)
    prices = [19000 + rng.random() * 10 for _ in range(3000)] + [rng.gauss(19000, 4000) for _ in range(2000)] + [19003.5] * 500
    ticks = make_ticks(spark, [(at(DAY, 1 + i % 20), i, px) for i, px in enumerate(prices)])
    got = sheets_from_ticks(ticks).collect()
    cells = sheets_from_histogram(tick_source.histogram_of_cells(tick_source.price_cells(ticks))).collect()
    assert len(got) == 1 and got == cells
    ordered, day = sorted(prices), DAY + dt.timedelta(days=1)
    for s in SLOTS:
        k = next(k for k in range(25) if k * 7 % 25 == s.slot)
        want = None if (day.day + s.slot) % 7 == 0 else ordered[k * len(ordered) // 25]
        assert got[0][s.price_col] == want


@pytest.mark.parametrize("interval", ["5 minutes", "1 hour", "36500 days"])
def test_cells_hold_what_bars_and_first_ticks_need(spark, interval):
    ticks = random_ticks(spark)
    cells = tick_source.price_cells(ticks, interval)
    order = ["symbol", "session_date", "ts", "open", "high", "low", "close", "ticks"]
    assert sorted(tick_source.bars_of_cells(cells).select(order).collect()) == sorted(tick_source.bars(ticks, interval).select(order).collect())
    first = tick_source.first_ticks_by_price(ticks, interval).groupBy("symbol", "bar", "px").agg(F.min("tick").alias("tick"))
    mine = tick_source.first_ticks_of_cells(cells).groupBy("symbol", "bar", "px").agg(F.min("tick").alias("tick"))
    assert sorted(mine.collect()) == sorted(first.collect())
