"""Durations of tool calls from lifecycle events, as a stream and as its batch twin.

An event is (message_id, call_id, status, event_ms, start_ms, end_ms). The first ``pending`` of a call
starts its clock, ``running`` changes nothing, ``completed`` ends it, any other status forgets the start.
The duration is the time from pending to completion where the start is known, else the run time that
the event itself states, never negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENT = (
    "type string, time bigint, properties struct<time:bigint, part:struct<type:string,tool:string,callID:string,messageID:string,sessionID:string,"
    "state:struct<status:string,time:struct<start:bigint,end:bigint>>>>"
)
OUTPUT = "message_id string, call_id string, duration_ms bigint"
_ORDER = {"pending": 0, "running": 1, "completed": 2}


def fold(start: int | None, rows: list[tuple]) -> tuple[int | None, list[int]]:
    """(start, durations) after (status, event_ms, start_ms, end_ms) rows in time order."""
    out = []
    for status, at, began, ended in rows:
        if status == "pending":
            start = at if start is None else start
        elif status == "completed":
            if start is not None and at is not None:
                out.append(max(0, at - start))
            elif began is not None and ended is not None:
                out.append(max(0, ended - began))
            start = None
        elif status != "running":
            start = None
    return start, out


def _ordered(pdf: pd.DataFrame) -> list[tuple]:
    rows = [tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r) for r in pdf[["status", "event_ms", "start_ms", "end_ms"]].itertuples(index=False)]
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, _ORDER.get(r[0], 3)))


def tool_events(raw: DataFrame, tool: str | None = None) -> DataFrame:
    """Events in the columns that this module reads from lifecycle events as JSON text (``value``).

    Only updates of tool parts (of ``tool``, if named) with a message and a call. The time of an event is
    its own, else that of its properties; a pending one without either takes the time of processing.
    """
    e = raw.select(F.from_json("value", EVENT).alias("e")).select("e.*").where(F.col("type") == "message.part.updated")
    part, state = "properties.part", "properties.part.state"
    told = F.coalesce("time", "properties.time")
    now = F.when(F.col(f"{state}.status") == "pending", F.unix_millis(F.current_timestamp()))
    rows = e.where((F.col(f"{part}.type") == "tool") & ((F.col(f"{part}.tool") == tool) if tool else F.lit(True))).select(
        F.col(f"{part}.messageID").alias("message_id"), F.col(f"{part}.callID").alias("call_id"), F.col(f"{state}.status").alias("status"), F.coalesce(told, now).alias("event_ms"),
        F.col(f"{state}.time.start").alias("start_ms"), F.col(f"{state}.time.end").alias("end_ms"),
    )
    return rows.where(F.col("message_id").isNotNull() & F.col("call_id").isNotNull())


def stream_durations(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming durations. Events without a call are left out.

    The state of a call is the start of its clock, from its first pending event to its end; with
    ``ttl_ms`` a start is also forgotten when no event of the call came for so long (empty batches then
    go on for the sake of the clock: use a processing-time trigger). A stream is restarted from its checkpoint without loss or repeats.
    """

    def each(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, out = fold(state.get[0] if state.exists else None, _ordered(pd.concat(list(rows))))
        if start is not None:
            state.update((start,))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        elif state.exists:
            state.remove()
        if out:  # plain objects: string arrays of pandas come in chunks, which the writer refuses
            text = lambda x: pd.Series([x] * len(out), dtype=object)
            yield pd.DataFrame({"message_id": text(key[0]), "call_id": text(key[1]), "duration_ms": pd.Series(out, dtype="int64")})

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.where(F.col("message_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("message_id", "call_id").applyInPandasWithState(each, OUTPUT, "at bigint", "append", timeout)


def batch_durations(events: DataFrame) -> DataFrame:
    """The same over a finished table: each completion against the first pending since the last end."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).when(F.col("status") == "completed", 2).otherwise(3)
    own = events.where(F.col("message_id").isNotNull() & F.col("call_id").isNotNull() & (F.coalesce("status", F.lit("")) != "running"))
    w = Window.partitionBy("message_id", "call_id").orderBy(F.col("event_ms").asc_nulls_last(), rank)
    ended = F.when(F.coalesce("status", F.lit("")) != "pending", 1).otherwise(0)
    own = own.withColumn("round", F.coalesce(F.sum(ended).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min(F.when(F.col("status") == "pending", F.col("event_ms"))).over(Window.partitionBy("message_id", "call_id", "round"))
    own = own.withColumn("first", first).where(F.col("status") == "completed")
    gap = F.coalesce(F.col("event_ms") - F.col("first"), F.col("end_ms") - F.col("start_ms"))
    return own.select("message_id", "call_id", F.greatest(gap, F.lit(0)).cast("bigint").alias("duration_ms"), gap.isNotNull().alias("known")).where("known").drop("known")


def attach(blocks: DataFrame, durations: DataFrame) -> DataFrame:
    """Blocks with the duration of the call that made them; blocks without one keep their own.

    Works on static frames and, with a watermark on both, as a stream-stream left join: late
    durations wait in the join's state until their block arrives.
    """
    took = durations.select(F.col("message_id").alias("compress_message_id"), F.col("call_id").alias("compress_call_id"), F.col("duration_ms").alias("took_ms"))
    return blocks.join(took, ["compress_message_id", "compress_call_id"], "left").withColumn("duration_ms", F.coalesce("took_ms", "duration_ms")).drop("took_ms")
