"""Retention and freshness of stored entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune(entries: DataFrame, stored: str, size: str, path: list[str], now: Column, max_age: int = 0, max_entries: int = 0, max_bytes: int = 0, keys: list[str] | None = None) -> DataFrame:
    """What stays: not older than ``max_age``, then the newest ``max_entries``, then the newest that fit ``max_bytes``.

    Zero switches a rule off. ``keys`` names independent stores; without them the newest-first order
    is one global window, so give the key of the store at scale.
    """
    rows = entries.where(now - F.col(stored) <= max_age) if max_age > 0 else entries
    newest = Window.partitionBy(*(keys or [])).orderBy(F.col(stored).desc(), *[F.col(p).desc() for p in path])
    if max_entries > 0:
        rows = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max_entries).drop("_n")
    if max_bytes > 0:
        rows = rows.withColumn("_b", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_b") <= max_bytes).drop("_b")
    return rows


def fresh(stored: Column, now: Column, ttl: int) -> Column:
    return now - stored <= ttl


def newest_per_kind(entries: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """The newest entry of each key; of equally new ones the largest by the other columns."""
    best = F.max(F.struct(time, *columns)).alias("_e")
    return entries.groupBy(*keys).agg(best).select(*keys, f"_e.{time}", *[f"_e.{c}" for c in columns])
