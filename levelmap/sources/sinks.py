"""Parquet tables for bars, sheets, alerts, snapshots and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_by_session(df: DataFrame, path: str, mode: str = "overwrite", whole: bool = False) -> None:
    """One folder per session date, so later reads prune to the days they need.

    Rebalancing gathers a day's rows so that few files arise, and splits a day that is too
    large for one task. Days not in ``df`` are left as they are, or emptied with ``whole``.
    """
    (
        df.hint("rebalance", "session_date")
        .write.mode(mode)
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy("session_date")
        .parquet(path)
    )
