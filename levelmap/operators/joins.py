"""Bars with the sheet that applies to them.

All are equi-joins without hints: Spark broadcasts the sheets while they are below the
session's threshold and joins by key beyond it. ``bars`` may be bars or bar contexts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelmap.operators.sessions import session_stats


def by_session(bars: DataFrame, sheets: DataFrame) -> DataFrame:
    """The sheet of the bar's own session; bars of a session without one drop out."""
    return bars.join(sheets, ["symbol", "session_date"])


def static(bars: DataFrame, sheets: DataFrame) -> DataFrame:
    """One sheet per symbol, the latest, for its whole history.

    The sheet side has one row per symbol. Should it be too large to broadcast, adaptive
    execution splits the bars of a hot symbol and repeats its one sheet for each part.
    """
    fields = [c for c in sheets.columns if c not in ("symbol", "session_date")]
    sheet = F.struct(F.col("session_date").alias("sheet_date"), *fields)
    latest = sheets.groupBy("symbol").agg(F.max_by(sheet, "session_date").alias("sheet")).select("symbol", "sheet.*")
    return bars.join(latest, "symbol")


def as_of(bars: DataFrame, sheets: DataFrame) -> DataFrame:
    """The latest sheet on or before the bar's session: a sheet stays in force until edited.

    The carry-forward runs on one row per symbol and day. Bars then meet their sheet in an
    equi-join on the session, by which they are spread already, instead of a range join.
    """
    fields = [c for c in sheets.columns if c not in ("symbol", "session_date")]
    sheet = F.struct(F.col("session_date").alias("sheet_date"), *fields)
    entered = sheets.select("symbol", "session_date", sheet.alias("sheet"), F.lit(False).alias("traded"))
    # A day is traded if it has a close. Asking for the close, and not for the mere day, lets
    # this use of the bars share the tick scan of the other.
    days = session_stats(bars).filter("last_close is not null")
    traded = days.select(
        "symbol",
        "session_date",
        F.lit(None).cast(entered.schema["sheet"].dataType).alias("sheet"),
        F.lit(True).alias("traded"),
    )
    # The default frame takes in the rows of the same day, hence a sheet entered that day.
    upto_day = Window.partitionBy("symbol").orderBy("session_date")
    in_force = (
        entered.unionByName(traded)
        .withColumn("sheet", F.last("sheet", ignorenulls=True).over(upto_day))
        .filter("traded and sheet is not null")
        .select("symbol", "session_date", "sheet.*")
    )
    return bars.join(in_force, ["symbol", "session_date"])
