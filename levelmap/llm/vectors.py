"""Vectors of whole numbers, and what comparing them exactly needs."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this count as it, as longs end there.
LARGEST = float(1 << 62)


def whole_vectors(vectors: DataFrame, scale: int, *columns: str, width: int | None = None) -> DataFrame:
    """`columns` and `v`, each component times `scale` rounded down, of the rows whose `embedding` is not null,
    holds no null or non-finite component and, with a `width`, has that many."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(len(columns))
            sizes = given.value_lengths().to_numpy(zero_copy_only=False)
            flat = given.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.cumsum(np.r_[0, sizes])
            bad = np.cumsum(np.r_[0, ~np.isfinite(x)])  # a null component reads as NaN
            fine = bad[at[1:]] == bad[at[:-1]]
            if width is not None:
                fine &= sizes == width
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.clip(np.floor(x * scale), -LARGEST, LARGEST)[np.repeat(fine, sizes)].astype(np.int64)
            ends = np.cumsum(np.r_[0, sizes[fine]]).astype(np.int32)
            mask = pa.array(fine)
            out = [batch.column(i).filter(mask) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(v))], [*columns, "v"])

    rows = vectors.select(*columns, "embedding").filter("embedding is not null")
    kinds = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in columns]
    return rows.mapInArrow(scaled, ", ".join([*kinds, "v array<bigint>"]))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix; short ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def in_one_word(*arrays: np.ndarray) -> bool:
    """Do squared distances between rows of these fit into a long?"""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    width = max(a.shape[1] for a in arrays)
    return (2 * top) ** 2 * max(1, width) < 1 << 62


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are, or as Python's unbounded whole numbers where squares could leave a long."""
    return list(arrays) if in_one_word(*arrays) else [a.astype(object) for a in arrays]


def longs(values: np.ndarray) -> pa.Array:
    """Whole numbers as longs, null where they are too large for one."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values.tolist()], pa.int64())


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def long_sum(column: str) -> "F.Column":
    """The exact sum of longs; null if one of them is, or if it is too large for a long."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(F.count(column) == F.count(F.lit(1)), total.try_cast("long"))
