"""Level sheets: one row of operator-entered prices per symbol and session."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmap import fixed
from levelmap.schemas import SHEET_KEYS, SHEET_SCHEMA, SLOTS, Params, sheet_defaults
from levelmap.sources.ticks import session_day

ENTERED_SCHEMA = T.StructType([*SHEET_SCHEMA.fields, T.StructField("entered_at", T.TimestampNTZType())])
_N = len(SLOTS)
#: Points of a price range whose ticks are summed before any price is ranked.
_RANGE = 16
_SIZES = (0, 250, 500, 750, 1000, 1500, 2000, 2500)


def with_defaults(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Completes a sheet: absent, NULL or NaN fields take their defaults.

    ``max_change_ok`` tells whether that field holds one of its allowed options; the
    value itself is passed on as entered.
    """
    present = set(raw.columns)

    def filled(name: str, sql_type: str, default: object) -> str:
        fallback = f"cast({_literal(default)} as {sql_type})"
        entered = f"cast({name} as {sql_type})"
        if sql_type == "double":
            entered = f"nullif({entered}, double('NaN'))"
        return f"coalesce({entered}, {fallback})" if name in present else fallback

    fields = {name: filled(name, *field) for name, field in sheet_defaults(params).items()}
    options = ", ".join(_literal(o) for o in fixed.MAX_CHANGE_OPTIONS)
    return raw.selectExpr(
        *SHEET_KEYS,
        *[f"{value} as {name}" for name, value in fields.items()],
        f"{fields['max_change']} in ({options}) as max_change_ok",
    )


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value).lower() if isinstance(value, bool) else repr(value)


def latest(raw: DataFrame) -> DataFrame:
    """One sheet per symbol and session: the one with the latest ``entered_at``, if there is such a
    column. Of several entered at once, or without a time, the greatest by its fields is taken."""
    entered = ["entered_at"] if "entered_at" in raw.columns else []
    fields = [c for c in raw.columns if c not in (*SHEET_KEYS, *entered)]
    newest = raw.groupBy(*SHEET_KEYS).agg(F.max(F.struct(*entered, *fields)).alias("sheet"))
    return newest.select(*SHEET_KEYS, *(F.col("sheet")[c].alias(c) for c in fields))


def read_sheets(spark: SparkSession, path: str, params: Params = Params()) -> DataFrame:
    """A Parquet table of sheets under the declared schema; missing columns read as NULL.

    A corrected sheet is a further row with a later ``entered_at``, a UTC wall-clock time.
    """
    return with_defaults(latest(spark.read.schema(ENTERED_SCHEMA).parquet(path)), params)


def stored_sheets(
    spark: SparkSession, path: str, params: Params = Params()
) -> Callable[[dt.date, dt.date], DataFrame]:
    """Loads the sheets of a span of sessions, as the table is at the time of the call. In a table
    written by session only the folders of those days are opened."""

    def load(first: dt.date, last: dt.date) -> DataFrame:
        return read_sheets(spark, path, params).filter(F.col("session_date").between(first, last))

    return load


def sheets_from_ticks(ticks: DataFrame, tz: str = "UTC") -> DataFrame:
    """Raw sheets made of evenly spaced order statistics of the day before.

    Rank k of 25 of a day's sorted prices goes to slot (k * 7) mod 25 of the next day's
    sheet. Ticks collapse to one row per price inside the scan tasks.
    """
    histogram = (
        ticks.groupBy("symbol", session_day(F.col("ts"), tz).alias("day"), "px")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return sheets_from_histogram(histogram.repartition("symbol", "day"))


def sheets_from_histogram(histogram: DataFrame) -> DataFrame:
    """``sheets_from_ticks`` from (symbol, day, px, weight), spread by (symbol, day).

    Ranks are found in two steps, so that no window holds all prices of a day, however many
    there are: running sums over price ranges tell which ranges hold a wanted rank, 25 of
    them at most, and only within those are prices put in order. Both steps run where the
    day's prices are: they share one exchange, and the hint keeps their join from making another.
    """
    # Tests for null are said here, once, and a range without a wanted rank reads as -1: a test that a
    # join or filter adds to one of the two uses of the prices only would have them made twice.
    # Weights cover sorted positions [hi - weight, hi); rank k sits at position floor(k * total / 25).
    first_rank, last_rank = f"({_N} * (hi - weight) + total - 1) div total", f"({_N} * hi + total - 1) div total - 1"
    options = ", ".join(_literal(o) for o in fixed.MAX_CHANGE_OPTIONS)
    prices = [
        f"if((dayofmonth(date_add(day, 1)) + {s.slot}) % 7 != 0, max(px) filter (where k * 7 % {_N} = {s.slot}), null) as {s.price_col}"
        for s in SLOTS
    ]
    return histogram.sparkSession.sql(
        f"""
with ranged as (
  select *, floor(px / {_RANGE}) as range from {{histogram}}
  where symbol is not null and day is not null and date_add(day, 1) is not null),
sums as (
  select *, sum(weight) over (partition by symbol, day order by range rows unbounded preceding) as hi,
    sum(weight) over (partition by symbol, day) as total
  from (select symbol, day, range, sum(weight) as weight from ranged group by symbol, day, range)),
wanted as (
  select symbol, day, map_from_entries(collect_list(struct(range, hi - weight))) as below, max(total) as total
  from sums where {first_rank} <= {last_rank} group by symbol, day),
held as (
  select /*+ shuffle_hash(wanted) */ symbol, day, px, weight, total, range, coalesce(below[range], -1) as below
  from ranged join wanted using (symbol, day)),
placed as (
  select symbol, day, px, weight, total,
    below + sum(weight) over (partition by symbol, day, range order by px rows unbounded preceding) as hi
  from held where below >= 0),
ranks as (
  select symbol, day, px, explode(sequence({first_rank}, {last_rank})) as k from placed where {first_rank} <= {last_rank})
select symbol, date_add(day, 1) as session_date,
  dayofmonth(date_add(day, 1)) % 3 != 0 as net_gex_pos,
  get(array({options}), dayofmonth(date_add(day, 1)) % 3) as max_change,
  {", ".join(prices)},
  {", ".join(f"double({_SIZES[s.slot]}) as {s.size_col}" for s in SLOTS if s.size_col)}
from ranks group by symbol, day""",
        histogram=histogram,
    )
