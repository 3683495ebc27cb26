"""References to records that do not exist.

Parents and references are brought into one long table of (parent table, key) rows with a tag,
grouped by table and key with map-side pre-aggregation, and groups lacking a parent row (or whose
parent is deleted or may have come after a reference) are kept. Only references to those keys go
on; a key that a third of all references share costs one row per map task in the grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doubtful_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """Keys whose references cannot all be resolved.

    parents: parent_table, parent_key, deleted (boolean), seen_at (timestamp). Several rows per key
    are one record: deleted if any row says so, seen at its earliest time.
    references: parent_table, parent_key, taken_at (timestamp). Null keys refer to nothing and are
    left out. Result: parent_table, parent_key, present, deleted, first_seen.
    """
    long = parents.select(
        "parent_table", "parent_key", F.lit(True).alias("is_parent"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "seen_at",
        F.lit(None).cast("timestamp_ntz").alias("taken_at"),
    ).unionByName(
        references.select(
            "parent_table", "parent_key", F.lit(False).alias("is_parent"), F.lit(False).alias("deleted"),
            F.lit(None).cast("timestamp_ntz").alias("seen_at"), F.col("taken_at"),
        )
    )
    keys = (
        long.where(F.col("parent_key").isNotNull())
        .groupBy("parent_table", "parent_key")
        .agg(
            F.max("is_parent").alias("present"),
            F.min("is_parent").alias("unreferenced"),
            F.max("deleted").alias("deleted"),
            F.min("seen_at").alias("first_seen"),
            F.min("taken_at").alias("first_taken"),
        )
    )
    late = F.coalesce(F.col("first_seen") > F.col("first_taken"), F.lit(False))
    return keys.where(~F.col("unreferenced") & (~F.col("present") | F.col("deleted") | late)).select(
        "parent_table", "parent_key", "present", "deleted", "first_seen"
    )


def orphans(parents: DataFrame, references: DataFrame) -> DataFrame:
    """References whose target is ``missing``, ``deleted`` or ``late``, with all their own columns.

    missing: no parent row; deleted: some parent row is marked deleted; late: the earliest parent
    row came after ``taken_at``. The first that holds, in this order, is the reason. Repeated
    references stay repeated; a null ``taken_at`` is never late.
    """
    bad = doubtful_keys(parents, references).select(
        F.col("parent_table").alias("_table"), F.col("parent_key").alias("_key"), F.col("present").alias("_present"), F.col("deleted").alias("_deleted"), F.col("first_seen").alias("_seen")
    )
    reason = F.when(~F.col("_present"), "missing").when(F.col("_deleted"), "deleted").when(F.col("_seen") > F.col("taken_at"), "late")
    return (
        references.join(bad, (F.col("parent_table") == F.col("_table")) & (F.col("parent_key") == F.col("_key")))
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .drop("_table", "_key", "_present", "_deleted", "_seen")
    )


def orphan_report(found: DataFrame, *by: str) -> DataFrame:
    """Counts of orphan references by the given columns and reason."""
    return found.groupBy(*by, "reason").agg(F.count("*").alias("n_references"), F.countDistinct("parent_key").alias("n_keys"))
