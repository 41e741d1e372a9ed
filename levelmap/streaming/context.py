"""What each confirmed bar needs to know of its symbol's past, carried from batch to batch.

The past of a symbol is one row, whatever the number of nodes or zones: its last close, the
session that was in, and the extremes of that session's closes. Within a micro-batch the
operators of the batch path apply, so both paths follow one rule and a hot symbol is spread
by session in either.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmap.operators.sessions import bar_context, session_stats
from levelmap.schemas import SHEET_KEYS
from levelmap.sources.sinks import write_by_session
from levelmap.sources.versions import Files, days_of

CARRY_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# State goes to the checkpoint as changes, not as whole files.
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seeded_context(bars: DataFrame, carry: DataFrame) -> DataFrame:
    """``bar_context`` of newly confirmed bars that continue the carried rows."""
    past = carry.select("symbol", F.struct("session_date", "close", "low", "high").alias("past"))
    same = F.col("past.session_date") == F.col("session_date")
    return (
        bar_context(bars)
        .join(past, "symbol", "left")
        .select(
            *SHEET_KEYS,
            "ts",
            "close",
            F.coalesce("prev_close", "past.close").alias("prev_close"),
            F.least("low_before", F.when(same, F.col("past.low"))).alias("low_before"),
            F.greatest("high_before", F.when(same, F.col("past.high"))).alias("high_before"),
        )
    )


def carried_on(bars: DataFrame, carry: DataFrame) -> DataFrame:
    """The carried rows once these bars are in: one row per symbol, of its latest session."""
    fresh = session_stats(bars).selectExpr(
        *SHEET_KEYS, "last_close as close", "low_close as low", "high_close as high", "true as fresh"
    )
    sessions = (
        fresh.unionByName(carry.withColumn("fresh", F.lit(False)))
        .groupBy(*SHEET_KEYS)
        .agg(F.max_by("close", "fresh").alias("close"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    row = F.struct("session_date", "close", "low", "high")
    return sessions.groupBy("symbol").agg(F.max_by(row, "session_date").alias("row")).select("symbol", "row.*")


class Turns:
    """A table that micro-batches replace. Each version is a folder named by its batch.

    Batch n reads the latest version before n, so that a repeated batch starts from the same rows. A batch
    with nothing to say writes none. No more than two versions are ever stored.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema, self.files = spark, folder, schema, Files(spark, folder)

    def _versions(self) -> list[int]:
        return sorted(int(n[5:]) for n in self.files.names() if n.startswith("turn-"))

    def before(self, batch_id: int) -> DataFrame:
        earlier = [v for v in self._versions() if v < batch_id]
        return self.of(earlier[-1]) if earlier else self.spark.createDataFrame([], self.schema)

    def of(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/turn-{batch_id}")

    def put(self, df: DataFrame, batch_id: int, by_session: bool = False) -> DataFrame:
        """Stores the batch's version. Written by session, its days can be told without reading it."""
        rows, place = df.select(*self.schema.names), f"{self.folder}/turn-{batch_id}"
        write_by_session(rows, place, whole=True) if by_session else rows.write.mode("overwrite").parquet(place)
        for stale in [v for v in self._versions() if v < batch_id][:-1]:
            self.files.drop(f"turn-{stale}")
        return self.of(batch_id)

    def days(self, batch_id: int) -> list[dt.date]:
        return sorted(days_of(self.files, f"turn-{batch_id}"))

    def drop(self, batch_id: int) -> None:
        self.files.drop(f"turn-{batch_id}")


@contextmanager
def stream_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Session settings under which a stream with state starts; restored afterwards.

    ``partitions`` is the number of state partitions, which stays with the checkpoint for
    good; without it the session's shuffle setting counts.
    """
    wanted = {_PROVIDER: _ROCKSDB, _CHANGELOG: "true"}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
