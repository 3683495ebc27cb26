"""Saved session states as JSON lines, one folder per session: reading with coercion, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "session_name string, prune struct<tools:map<string,string>, messages:struct<byMessageId:map<string,struct<tokenCount:double,allBlockIds:array<bigint>,activeBlockIds:array<bigint>>>, "
    "blocksById:map<string,struct<blockId:bigint,active:boolean>>, activeBlockIds:array<bigint>, activeByAnchorMessageId:map<string,bigint>, nextBlockId:bigint, nextRunId:bigint>>, "
    "nudges struct<contextLimitAnchors:array<string>,turnNudgeAnchors:array<string>,iterationNudgeAnchors:array<string>>, stats struct<pruneTokenCounter:double,totalPruneTokens:double>, "
    "lastUpdated string, session_id string"
)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """One row per readable state file below ``folder``.

    States without prune, tools, messages, stats or nudges are rejected; anchors lose nulls and repeats;
    tool counts that are no numbers are dropped; the next block id is at least one past the largest.
    """
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(folder)
    whole = raw.where(F.col("prune.tools").isNotNull() & F.col("prune.messages").isNotNull() & F.col("stats").isNotNull() & F.col("nudges").isNotNull())
    tidy = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))
    largest = F.array_max(F.transform(F.map_values("prune.messages.blocksById"), lambda b: b["blockId"]))
    return whole.select(
        "session_id",
        "session_name",
        F.map_filter(F.transform_values("prune.tools", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull()).alias("tools"),
        F.col("prune.messages.byMessageId").alias("by_message"),
        F.greatest(F.coalesce("prune.messages.nextBlockId", F.lit(1)), F.coalesce(largest, F.lit(0)) + 1).alias("next_block_id"),
        *[tidy(F.col(f"nudges.{n}")).alias(n) for n in ("contextLimitAnchors", "turnNudgeAnchors", "iterationNudgeAnchors")],
        F.col("stats.totalPruneTokens").cast("bigint").alias("total_tokens"),
        F.expr("try_to_timestamp(lastUpdated)").alias("last_updated"),
    )


def write_states(states: DataFrame, folder: str) -> None:
    """Write state rows in the stored shape, one sub-folder per session, replacing those present."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").json(folder)
