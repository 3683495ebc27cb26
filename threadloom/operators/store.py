"""Cleaning of the assistant host's store: counting rows, one time unit, canonical roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Epoch values below this are seconds, not milliseconds (it lies in the year 5138 and in 1973).
SECONDS_BELOW = 100_000_000_000


def epoch_ms(c: str | Column) -> Column:
    """Epoch milliseconds of a value given in seconds or milliseconds; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < SECONDS_BELOW, c * 1000).otherwise(c)


def trimmed(c: str | Column) -> Column:
    """Text without white space (Unicode too) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def role_name(c: str | Column) -> Column:
    """``user`` or ``assistant`` in any case and padding; null for everything else."""
    t = F.lower(trimmed(c))
    return F.when(t.isin("user", "assistant"), t)


def latest_states(states: DataFrame, *columns: str) -> DataFrame:
    """The counting snapshot per session: the row with the greatest last_updated.

    Columns: session_id, updated, synced_at and those named; no others are read or shuffled. Times that
    cannot be read lose. Ties go to the earliest synced_at, then to the greatest texts in the order
    named. Sessions without id are left out.
    """
    rank = F.struct(
        F.expr("try_to_timestamp(last_updated)").alias("updated"),
        (-F.coalesce(F.expr("unix_micros(cast(synced_at as timestamp))"), F.lit(0))).alias("early"),
        *columns,
        "synced_at",
    )
    own = states.where(F.col("session_id").isNotNull()).select("session_id", rank.alias("m"))
    return own.groupBy("session_id").agg(F.max("m").alias("m")).select("session_id", "m.updated", "m.synced_at", *[f"m.{c}" for c in columns])
