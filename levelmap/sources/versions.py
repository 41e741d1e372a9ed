"""Result tables whose days are replaced one by one and appear by one switch.

A publication writes its days into folders of its own, table/version/session_date, so it never touches
what readers see. The index names, for each table and day, the version that holds it. A new index is
written aside and renamed: that is the switch, before which all readers see the old days, and after which
all see the new ones. A job that dies before it leaves the old tables; its folders are written over by the
next. A day is in the index once for each table that has rows of it, which bounds what the driver holds.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from levelmap.sources.sinks import write_by_session

Index = dict[str, dict[dt.date, int]]
_KEPT = 2
_AT_ONCE = 4


class Files:
    """The file operations that DataFrames lack, by the file system Spark itself uses for the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if it does not exist."""
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file aside and renames it, so that it is there whole or not at all."""
        aside = self._path(f"{name}.aside")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(aside, self._path(name)):
            raise OSError(f"{self.folder}/{name} could not be put in place")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def days_of(files: Files, table: str) -> set[dt.date]:
    """The sessions of a table written by session, from its folders' names."""
    found = (n.partition("session_date=")[2] for n in files.names(table))
    return {dt.date.fromisoformat(d) for d in found if d[:1].isdigit()}


def read_days(spark: SparkSession, folder: str, schema: T.StructType, days: Iterable[str]) -> DataFrame:
    """Folders of single days under one root; nothing else is opened. No days are no rows."""
    paths = [f"{folder}/{d}" for d in days]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*schema.names)


class DayTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)
        self._staged: Index = {}
        self._gone: dict[str, set[dt.date]] = {}

    def _indexes(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("index") if n.endswith(".json")]

    def _index_of(self, version: int) -> Index:
        stored = json.loads(self.files.text(f"index/{version:012d}.json"))
        return {t: {dt.date.fromisoformat(d): v for d, v in days.items()} for t, days in stored.items()}

    def index(self) -> Index:
        """What readers see: for each table its days and their versions."""
        versions = self._indexes()
        return self._index_of(versions[-1]) if versions else {}

    def days(self, table: str) -> list[dt.date]:
        return sorted(self.index().get(table, {}))

    def read(
        self, table: str, schema: T.StructType, first: dt.date | None = None, last: dt.date | None = None, staged: bool = False
    ) -> DataFrame:
        """A table's sessions from first to last. ``staged`` reads what the next switch will show."""
        days = (self._next() if staged else self.index()).get(table, {})
        wanted = sorted(d for d in days if (first is None or d >= first) and (last is None or d <= last))
        return read_days(self.spark, f"{self.folder}/{table}", schema, [f"version={days[d]}/session_date={d}" for d in wanted])

    def stage(self, tables: dict[str, DataFrame], days: Iterable[dt.date] | None = None) -> None:
        """Writes new contents for these days, unseen until the switch. A day without rows is emptied;
        without ``days`` it is those that there are rows of."""
        days, indexes = None if days is None else set(days), self._indexes()
        version = max([indexes[-1] if indexes else 0, *(v for t in self._staged.values() for v in t.values())]) + 1
        places = {table: f"{table}/version={version}" for table in tables}
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            list(pool.map(lambda t: write_by_session(tables[t], f"{self.folder}/{places[t]}", whole=True), tables))
        for table, place in places.items():
            written = days_of(self.files, place)
            if days is not None and not written <= days:
                raise ValueError(f"{table} has rows of other days than {sorted(days)}: {sorted(written - days)}")
            self._staged.setdefault(table, {}).update(dict.fromkeys(written, version))
            self._gone.setdefault(table, set()).update(written if days is None else days)

    def _next(self) -> Index:
        index = self.index()
        for table, days in self._gone.items():
            kept = {d: v for d, v in index.get(table, {}).items() if d not in days}
            index[table] = kept | self._staged.get(table, {})
        return index

    def switch(self) -> None:
        """Shows all that was staged, at once, and drops what neither this state nor the one before needs."""
        index, before = self._next(), self._indexes()
        version = max([*before[-1:], *(v for days in self._staged.values() for v in days.values()), 0])
        version += version in before
        text = json.dumps({t: {d.isoformat(): v for d, v in sorted(days.items())} for t, days in index.items()})
        self.files.put(f"index/{version:012d}.json", text)
        self._staged, self._gone = {}, {}
        old = before[: len(before) + 1 - _KEPT]
        used = [index] + [self._index_of(v) for v in before[len(before) + 1 - _KEPT :]]
        needed = {(t, v, d) for one in used for t, days in one.items() for d, v in days.items()}
        for stale in old:
            for table, days in self._index_of(stale).items():
                for d, v in days.items():
                    if (table, v, d) not in needed:
                        self.files.drop(f"{table}/version={v}/session_date={d}")
            self.files.drop(f"index/{stale:012d}.json")

    def replace(self, tables: dict[str, DataFrame], days: Iterable[dt.date] | None = None) -> None:
        self.stage(tables, days)
        self.switch()
