"""Session summary and chart annotations, both at the session's last bar.

Input is session statistics joined with zoned sheets: one row per symbol and session, so
everything here is a narrow step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap import fixed
from levelmap.functions import nodes, pin, regime, zones
from levelmap.functions.predicates import is_active, number_text
from levelmap.operators.levels import level_array
from levelmap.operators.zones import count_above, count_below
from levelmap.schemas import SHEET_KEYS


def snapshot(sessions: DataFrame) -> DataFrame:
    """The summary as one wide row per session, numbers and display texts side by side.

    Needs last_ts and last_close next to the zoned sheet.
    """
    close, pivot, positive = F.col("last_close"), F.col("zero_gamma"), F.col("net_gex_pos")
    measured = sessions.select(
        *SHEET_KEYS,
        F.col("last_ts").alias("ts"),
        close.alias("spot"),
        regime.regime_mode(positive, close, pivot).alias("mode"),
        regime.net_gex_label(positive).alias("net_gex"),
        pivot,
        regime.zg_distance(close, pivot).alias("zg_distance"),
        regime.zg_text(close, pivot).alias("zg_text"),
        "max_change",
        regime.max_change_bias(F.col("max_change")).alias("max_change_bias"),
        pin.pin_width(F.col("mq_ps0"), F.col("mq_cr0")).alias("pin_width"),
        "pin_narrow",
        "pin_wide",
        count_above().alias("zones_above"),
        count_below().alias("zones_below"),
        regime.mirror_target(close, pivot).alias("mirror_target"),
        regime.mirror_text(close, pivot).alias("mirror_text"),
    )
    kind = pin.pin_class(F.col("pin_width"), F.col("pin_narrow"), F.col("pin_wide"))
    return measured.withColumns(
        {
            "pin_text": pin.pin_summary_text(F.col("pin_width"), kind),
            "zones_text": F.concat(
                F.lit("▲ "),
                F.col("zones_above").cast("string"),
                F.lit("  ▼ "),
                F.col("zones_below").cast("string"),
            ),
            "spot_text": number_text(F.col("spot"), fixed.FORMAT_TWO_DECIMALS),
        }
    ).drop("pin_narrow", "pin_wide")


def summary_rows(sessions: DataFrame, brand: str = fixed.DEFAULT_BRAND) -> DataFrame:
    """The summary as label/value rows, numbered in display order below the heading."""
    values = ("mode", "net_gex", "zg_text", "max_change", "pin_text", "zones_text", "mirror_text", "spot_text")
    cells = [
        F.struct(
            F.lit(i).alias("row_no"), F.lit(label.format(brand=brand)).alias("label"), F.col(value).alias("value")
        )
        for i, (label, value) in enumerate(zip(fixed.SUMMARY_LABELS, values), start=1)
    ]
    return snapshot(sessions).select(*SHEET_KEYS, F.inline(F.array(*cells)))


_MARK = "struct<kind:string,seq:int,price:double,bot:double,top:double,label:string,role:string,size_class:int>"


def annotations(sessions: DataFrame) -> DataFrame:
    """One row per active level, pin band and zone of the session.

    Levels carry their slot as seq, zones their number. Role is support or resistance for
    nodes and above or below for zones.
    """
    green = lambda v: v["family"] == "green"
    none = F.lit(None)

    def mark(kind, seq, price, bot, top, label, role, size_class):
        names = ("kind", "seq", "price", "bot", "top", "label", "role", "size_class")
        values = (kind, seq, price, bot, top, label, role, size_class)
        return F.struct(*[v.alias(n) for n, v in zip(names, values)]).cast(_MARK)

    def node_mark(v):
        flipped = nodes.breaks(green(v), v["price"], F.col("buf"), F.col("low_close"), F.col("high_close"))
        return mark(
            F.lit("node"),
            v["slot"],
            v["price"],
            none,
            none,
            nodes.node_label(v["slot"], green(v), v["size_m"], flipped),
            nodes.role(green(v), flipped),
            nodes.size_class(v["size_m"]),
        )

    def level_mark(v):
        return mark(v["family"], v["slot"], v["price"], none, none, v["label"], none, none)

    width = pin.pin_width(F.col("mq_ps0"), F.col("mq_cr0"))
    kind = pin.pin_class(width, F.col("pin_narrow"), F.col("pin_wide"))
    band = mark(
        F.lit("pin"),
        F.lit(0),
        pin.pin_mid(F.col("mq_ps0"), F.col("mq_cr0")),
        F.col("mq_ps0"),
        F.col("mq_cr0"),
        pin.pin_box_text(width, kind),
        none,
        none,
    )
    zone_mark = lambda z: mark(
        F.lit("zone"),
        z["zone_seq"],
        z["center"],
        z["bot"],
        z["top"],
        zones.zone_label(z["n"], z["center"], z["sources"]),
        zones.zone_side(z["center"], F.col("last_close")),
        none,
    )
    is_node = lambda v: v["family"].isin("green", "red")
    active = F.filter(level_array("slot", "family", "label", "price", "size_m"), lambda v: is_active(v["price"]))
    marks = F.concat(
        F.transform(active, lambda v: F.when(is_node(v), node_mark(v)).otherwise(level_mark(v))),
        F.filter(F.array(band), lambda b: b["price"].isNotNull()),
        F.transform("zones", zone_mark),
    )
    return sessions.select(*SHEET_KEYS, F.inline_outer(marks)).filter("kind is not null")
