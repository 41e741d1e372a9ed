"""What the operators share: reading tables, keeping intermediate tables, hashing words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+|[^\w\s]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="levelmap-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def keep(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost
    executors, and lets the planner see the real size when it chooses a join."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[kept] = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Deletes the folders of kept frames, once all that reads them is kept itself."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for rows whose labels are never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of the frame is called that."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


class WordHashes(dict):
    """Hashes of words; the memo is emptied when it holds `most` words, which only costs time."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(lengths: np.ndarray, most: int):
    """Consecutive (first, end) runs of items whose lengths sum to about `most`."""
    first, total = 0, 0
    for at, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield first, at
            first, total = at, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


Each = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """What this process has freed but holds in its allocators goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(each: Each) -> Each:
    """`each` for mapInArrow, which gives its memory back when its task ends: workers stay for later tasks, and
    would keep what their largest one took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def squeezed(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def expanded(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def added_blocks(parts: DataFrame) -> DataFrame:
    """Sums arrays of int64 by block: rows (block int, sub int, data binary) to one row per block.

    Every partial array is as long as its block at most, whatever the input; subs are summed first, so that
    no group receives an array from every task.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = expanded(frame.data[0], np.int64).copy()
        for data in frame.data[1:]:
            total += expanded(data, np.int64)
        return pd.DataFrame({"block": frame.block[:1], "sub": 0, "data": [squeezed(total)]})

    schema = "block int, sub int, data binary"
    return parts.groupBy("block", "sub").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
