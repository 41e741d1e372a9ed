"""An independent walk over bars in plain Python, against the Spark operators.

The walk goes bar by bar with mutable state, the opposite of the set-based operators.
"""

from __future__ import annotations

from collections import defaultdict

import pytest

from levelmap.operators import alerts, nodes, zones
from levelmap.plans.catalog import Inputs
from levelmap.schemas import NODES, SLOTS

FOLDER = "/root/testdata/sf0.001"
KINDS = ("zone_entry_below", "zone_entry_above", "node_flip", "pin_break_up", "pin_break_down")


def group_levels(sheet):
    """Boxes of the sheet's zones: (sequence, bottom, top)."""
    pending = sorted((sheet[s.price_col], s.slot) for s in SLOTS if sheet[s.price_col] != 0)
    boxes = []
    while pending:
        anchor = pending[0][0]
        group = [p for p, _ in pending if p - anchor <= sheet["tol"]]
        pending = pending[len(group) :]
        if len(group) > 1:
            middle = sum(group) / len(group)
            boxes.append((len(boxes) + 1, middle - sheet["tol"] / 2, middle + sheet["tol"] / 2))
    return boxes


def walk(bars, sheets):
    raised, flips, touches = set(), set(), defaultdict(int)
    for symbol in sorted({b["symbol"] for b in bars}):
        previous, day, flipped = None, None, set()
        for bar in sorted((b for b in bars if b["symbol"] == symbol), key=lambda b: b["ts"]):
            close, ts = bar["close"], bar["ts"]
            if bar["session_date"] != day:
                day, flipped = bar["session_date"], set()
            sheet = sheets.get((symbol, day))
            if sheet:
                for slot in NODES:
                    price = sheet[slot.price_col]
                    gap = price - close if slot.family == "green" else close - price
                    if price != 0 and slot.slot not in flipped and gap > sheet["buf"]:
                        flipped.add(slot.slot)
                        flips.add((symbol, slot.slot, ts))
                        raised.add((symbol, ts, "node_flip"))
                for seq, bottom, top in group_levels(sheet):
                    if previous is not None and bottom <= close <= top and not bottom <= previous <= top:
                        touches[symbol, day, seq] += 1
                        raised.add((symbol, ts, KINDS[0] if previous < bottom else KINDS[1]))
                if sheet["mq_cr0"] != 0 and close > sheet["mq_cr0"] + sheet["buf"]:
                    raised.add((symbol, ts, "pin_break_up"))
                if sheet["mq_ps0"] != 0 and close < sheet["mq_ps0"] - sheet["buf"]:
                    raised.add((symbol, ts, "pin_break_down"))
            previous = close
    return raised, flips, touches


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


@pytest.fixture(scope="module")
def walked(inputs):
    bars = [r.asDict() for r in inputs.bars.collect()]
    sheets = {(r.symbol, r.session_date): r.asDict() for r in inputs.sheets.collect()}
    return walk(bars, sheets)


def test_alerts_equal_the_walk(inputs, walked):
    got = {(r.symbol, r.ts, r.kind) for r in alerts.alerts(inputs.zoned_context).collect()}
    assert got == walked[0]
    assert {kind for _, _, kind in got} == set(KINDS)


def test_flip_events_equal_the_walk(inputs, walked):
    got = [(r.symbol, r.slot, r.flip_ts) for r in nodes.flip_events(inputs.context).collect()]
    assert len(got) == len(set(got)) and set(got) == walked[1]


def test_touch_counts_equal_the_walk(inputs, walked):
    rows = zones.touch_counts(inputs.zoned, inputs.bar_context).collect()
    assert {(r.symbol, r.session_date, r.zone_seq): r.touches for r in rows if r.touches} == dict(walked[2])
