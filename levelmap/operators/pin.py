"""The pin band of a sheet and the bars that close beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmap.functions import pin
from levelmap.schemas import SHEET_KEYS


def pin_boxes(sheets: DataFrame) -> DataFrame:
    """One row per sheet with both edges set."""
    edges = F.col("mq_ps0"), F.col("mq_cr0")
    measured = sheets.select(
        *SHEET_KEYS,
        "mq_ps0",
        "mq_cr0",
        pin.pin_width(*edges).alias("width"),
        pin.pin_mid(*edges).alias("mid"),
        "pin_narrow",
        "pin_wide",
    ).filter("width is not null")
    classed = measured.withColumn(
        "pin_class", pin.pin_class(F.col("width"), F.col("pin_narrow"), F.col("pin_wide"))
    )
    return classed.withColumn("box_text", pin.pin_box_text(F.col("width"), F.col("pin_class")))


def pin_texts(sheets: DataFrame) -> DataFrame:
    """Box label and summary text of every sheet; the summary says so when there is no band."""
    width = pin.pin_width(F.col("mq_ps0"), F.col("mq_cr0"))
    kind = pin.pin_class(width, F.col("pin_narrow"), F.col("pin_wide"))
    return sheets.select(
        *SHEET_KEYS,
        pin.pin_box_text(width, kind).alias("box_text"),
        pin.pin_summary_text(width, kind).alias("summary_text"),
    )


def pin_breaks(bars: DataFrame) -> DataFrame:
    """Bars joined with their sheet: one row per bar and edge it closes beyond."""
    sides = F.array(
        F.struct(
            pin.breaks_up(F.col("close"), F.col("mq_cr0"), F.col("buf")).alias("fired"),
            F.lit("up").alias("side"),
            (F.col("mq_cr0") + F.col("buf")).alias("threshold"),
        ),
        F.struct(
            pin.breaks_down(F.col("close"), F.col("mq_ps0"), F.col("buf")).alias("fired"),
            F.lit("down").alias("side"),
            (F.col("mq_ps0") - F.col("buf")).alias("threshold"),
        ),
    )
    rows = bars.select(*SHEET_KEYS, "ts", "close", F.inline(sides)).filter("fired")
    return rows.select(*SHEET_KEYS, "ts", "side", "close", "threshold")
