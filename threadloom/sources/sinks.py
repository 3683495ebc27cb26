"""Sinks: snapshots of a context, JSON exports and an append-only log, all written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_snapshot(rows: DataFrame, folder: str, stamp: str) -> None:
    """Rows of a minimized context (session_id, seq, ...) as JSON lines, a folder per session and stamp.

    A snapshot of one stamp is replaced as a whole; others stay. Sessions without rows have no folder.
    """
    rows.where(F.col("session_id").isNotNull()).withColumn("stamp", F.lit(stamp)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "stamp").json(folder)


def export_json(rows: DataFrame, folder: str) -> None:
    """A report as JSON lines with its null members written out, replacing what is there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def append_log(events: DataFrame, folder: str, at: str = "at") -> None:
    """Events as JSON lines, a folder per day of the timestamp column ``at``; what is there stays."""
    events.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(folder)
