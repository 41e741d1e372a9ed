"""Running a stream into Parquet.

Every micro-batch overwrites a folder of its own, so that a repeated batch stores nothing
twice. Sheets are loaded for the sessions a batch holds, at the time it runs; a batch
without rows loads none.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from levelmap import fixed
from levelmap.operators import alerts, joins, zones
from levelmap.schemas import SHEET_SCHEMA
from levelmap.sources.sheets import with_defaults
from levelmap.sources.versions import DayTables, Files
from levelmap.streaming.bars import forming_view
from levelmap.streaming.context import CARRY_SCHEMA, Turns, carried_on, seeded_context, stream_settings

#: The sheets, with defaults, of the sessions from one day to another, both included.
SheetLoader = Callable[[dt.date, dt.date], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint directory.

    Only a local session, where driver and executors are one machine, may do without that
    setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="levelmap-")
    return f"{root.rstrip('/')}/levelmap-{uuid.uuid4().hex}"


def zoned_sheets(rows: DataFrame, load_sheets: SheetLoader) -> DataFrame:
    """The sheets of the sessions between the first and the last of these rows, with zones."""
    first, last = rows.agg(F.min("session_date"), F.max("session_date")).first()
    if first is None:
        return zones.with_zones(with_defaults(rows.sparkSession.createDataFrame([], SHEET_SCHEMA)))
    return zones.with_zones(load_sheets(first, last))


def at_once(*jobs: Callable[[], object]) -> None:
    """Runs independent writes of a batch side by side; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def start_batches(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    partitions: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Runs ``write`` on each micro-batch."""
    with stream_settings(df.sparkSession, partitions):
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        return writer.foreachBatch(write).trigger(**trigger).start()


def start_contexts(
    confirmed: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str, **options
) -> StreamingQuery:
    """Hands ``use`` the contexts of each micro-batch of confirmed bars (append mode)."""
    return _start_contexts(confirmed, lambda context, batch_id, days: use(context, batch_id), checkpoint, True, **options)


def _start_contexts(
    confirmed: DataFrame,
    use: Callable[[DataFrame, int, list[dt.date]], None],
    checkpoint: str,
    empty: bool,
    **options,
) -> StreamingQuery:
    """``use`` gets the contexts of a batch and its sessions; batches without rows only if ``empty``.

    The bars of a batch are stored first, by session: the batch is evaluated once, what follows is a
    batch query on a table, and a batch without rows ends there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = Turns(spark, f"{checkpoint}/bars", confirmed.schema)
        bars = stored.put(batch, batch_id, by_session=True)
        days = stored.days(batch_id)
        past = Turns(spark, f"{checkpoint}/past", CARRY_SCHEMA)
        before = past.before(batch_id)
        if not days:
            stored.drop(batch_id)
            return use(seeded_context(batch.limit(0), before), batch_id, days) if empty else None
        at_once(
            lambda: use(seeded_context(bars, before), batch_id, days),
            lambda: past.put(carried_on(bars, before), batch_id),
        )

    return start_batches(confirmed, write, checkpoint, **options)


def start_alerts(
    confirmed: DataFrame,
    load_sheets: SheetLoader,
    out: str,
    checkpoint: str,
    brand: str = fixed.DEFAULT_BRAND,
    **options,
) -> StreamingQuery:
    """Writes the alerts of a stream of confirmed bars. A sheet entered while the stream runs
    applies from the next batch on."""
    schema = T.StructType([*(f if f.name != "ts" else T.StructField("ts", confirmed.schema["ts"].dataType) for f in alerts.ALERT_SCHEMA)])

    def use(context: DataFrame, batch_id: int, days: list[dt.date]) -> None:
        raised = alerts.alerts(joins.by_session(context, zones.with_zones(load_sheets(days[0], days[-1]))), brand)
        raised.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # The table is there, with its columns, before the first bar is confirmed.
    spark = confirmed.sparkSession
    if not Files(spark, out).names():
        spark.createDataFrame([], schema).write.parquet(f"{out}/batch_id=-1")
    return _start_contexts(confirmed, use, checkpoint, False, **options)


def start_forming(
    forming: DataFrame, load_sheets: SheetLoader, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Writes the summary of each bar that changed (update mode), under the sheets of the moment."""

    def write(view: DataFrame, batch_id: int, days: list[dt.date]) -> None:
        view.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _start_views(forming, load_sheets, write, checkpoint, **options)


def start_summary(
    forming: DataFrame, load_sheets: SheetLoader, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Keeps one table with the newest summary of each bar (update mode), to be read with ``live_summary``.

    A batch replaces the sessions that it touches, so what it costs follows from the rows of those and not
    from the number of batches before.
    """

    def write(view: DataFrame, batch_id: int, days: list[dt.date]) -> None:
        tables = DayTables(view.sparkSession, out)
        held = tables.read("summary", view.schema, days[0], days[-1]).filter(F.col("session_date").isin(days))
        kept = held.join(view.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
        tables.replace({"summary": kept.select(*view.columns).unionByName(view)}, days)

    return _start_views(forming, load_sheets, write, checkpoint, **options)


def live_summary(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return DayTables(spark, out).read("summary", schema)


def _start_views(
    forming: DataFrame,
    load_sheets: SheetLoader,
    use: Callable[[DataFrame, int, list[dt.date]], None],
    checkpoint: str,
    **options,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        stored = Turns(batch.sparkSession, f"{checkpoint}/bars", forming.schema)
        bars = stored.put(batch, batch_id, by_session=True)
        days = stored.days(batch_id)
        if days:
            use(forming_view(bars, zones.with_zones(load_sheets(days[0], days[-1]))), batch_id, days)

    return start_batches(forming, write, checkpoint, mode="update", **options)


def start_table(df: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes a stream as it is."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return start_batches(df, write, checkpoint, **options)


def latest_versions(updates: DataFrame, *keys: str) -> DataFrame:
    """The last state of each row of an update-mode table: the one of its latest batch."""
    values = [c for c in updates.columns if c not in keys and c != "batch_id"]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(*keys, "row.*")
