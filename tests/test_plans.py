"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from levelmap.plans import catalog

FOLDER = "/root/testdata/sf0.001"
BATCH = {name: query for name, query in catalog.queries().items() if not name.startswith("stream_")}


def executed(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def plans(spark):
    return {name: executed(query(spark, FOLDER)) for name, query in BATCH.items()}


def test_no_cross_joins_and_no_python_in_batch(plans):
    for name, plan in plans.items():
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
            assert operator not in plan, (name, operator)


def test_scans_read_only_tick_columns_and_push_filters(plans):
    for name, plan in plans.items():
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
            assert {f.split(":")[0] for f in schema.split(",")} <= {"event_id", "ts", "event_type", "value"}, name
        assert "IsNotNull(event_type)" in plan and "IsNotNull(ts)" in plan, name


def test_ticks_are_scanned_once_per_derived_table(plans):
    """One scan for bars and one for sheets; where ticks themselves are joined, one for all three."""
    for name, plan in plans.items():
        allowed = 1 if name == "zone_entry_intrabar" else 2
        assert plan.count("FileScan parquet") <= allowed, name


def test_sheets_rank_prices_within_ranges_only(plans):
    for name in ("sheet_defaults", "zone_entry_intrabar"):
        frames = re.findall(r"Window \[sum\(weight#\d+L?\)[^\n]*?windowspecdefinition\(([^)]*?) ASC", plans[name])
        assert frames and all("range#" in f for f in frames), (name, frames)


def test_bars_history_shares_one_scan_and_one_spread(plans):
    plan = plans["prev_close"]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    # By block of ids, then by session, then one row per session by symbol for the carry.
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    plain = [re.sub(r"#\d+L?", "", k) for k in keys]
    assert sum(k.startswith("symbol, bar, id_block") for k in plain) == 1
    assert not any(k.startswith("symbol, ts") for k in plain)


def test_sheet_operators_do_not_shuffle_beyond_the_sheet(plans):
    base = plans["sheet_defaults"].count("Exchange hashpartitioning")
    for name in ("level_unpivot", "active_levels", "level_order", "zone_clusters", "zone_label", "pin_text"):
        assert plans[name].count("Exchange hashpartitioning") == base, name


def test_ticks_are_reduced_by_hashing_before_they_move(plans):
    for name in ("bars_1h", "sheet_defaults", "zone_entry_intrabar"):
        # What stands between a scan and the exchange above it.
        for above in plans[name].split("FileScan parquet")[:-1]:
            below = above.split("Exchange hashpartitioning")[-1]
            assert "HashAggregate" in below and "SortAggregate" not in below, name


def test_joins_fall_back_to_keys_beyond_the_broadcast_threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in BATCH.items():
            assert "Broadcast" not in executed(query(spark, FOLDER)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
