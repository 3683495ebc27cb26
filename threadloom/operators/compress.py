"""Applying compressions: newly covered messages, placeholders and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"


def newly_compressed(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """(session_id, block_id, n_messages, n_new, new_tokens) of blocks applied in (created_at, block_id) order.

    A block inherits the messages of the blocks it consumes, so what is once covered stays covered, and a
    message is newly compressed by the first block in order that covers it. tokens: session_id,
    message_id, tokens; messages without a count have none.
    """
    cover = blocks.select("session_id", "block_id", "created_at", F.explode(F.array_distinct("effective_message_ids")).alias("message_id"))
    first = cover.groupBy("session_id", "message_id").agg(F.min(F.struct("created_at", "block_id")).alias("f")).select("session_id", "message_id", F.col("f.block_id").alias("first_block"))
    rows = cover.join(first, ["session_id", "message_id"]).join(tokens, ["session_id", "message_id"], "left")
    fresh = F.col("first_block") == F.col("block_id")
    return rows.groupBy("session_id", "block_id").agg(
        F.count("*").alias("n_messages"), F.count_if(fresh).alias("n_new"), F.sum(F.when(fresh, F.coalesce("tokens", F.lit(0))).otherwise(0)).alias("new_tokens")
    )


def placeholders(summary: Column) -> Column:
    """Block numbers named by (bN) or {block_N} in a summary, in order."""
    found = F.regexp_extract_all(summary, F.lit(r"\((b[1-9]\d*)\)|\{block_([1-9]\d*)\}"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\D", "").cast("bigint"))


def inject(summary: Column, bodies: Column) -> Column:
    """Placeholders of the given array<struct<id, body>> replaced by the bodies; required bodies that no
    placeholder names are appended. Bodies are put in last, so their own text is never replaced."""
    marked = F.regexp_replace(F.regexp_replace(summary, r"\(b([1-9]\d*)\)", f"{MARK}$1{MARK}"), r"\{block_([1-9]\d*)\}", f"{MARK}$1{MARK}")
    mark = lambda x: F.concat(F.lit(MARK), x["id"].cast("string"), F.lit(MARK))
    filled = F.aggregate(
        bodies, marked, lambda acc, x: F.when(F.contains(acc, mark(x)), F.replace(acc, mark(x), x["body"])).otherwise(F.concat(acc, F.lit("\n\n"), x["body"]))
    )
    return F.regexp_replace(filled, f"{MARK}(\\d+){MARK}", "(b$1)")


def wrap(block_id: Column, summary: Column) -> Column:
    """Header, trimmed body and footer tag around a summary."""
    return F.concat(F.lit("[compressed section]\n"), F.trim(summary), F.lit("\n<block-id>b"), block_id.cast("string"), F.lit("</block-id>"))


def unwrap(text: Column) -> Column:
    """The body of a wrapped summary; other texts as they are."""
    return F.regexp_replace(text, r"(?s)^\[compressed section\]\n(.*?)\n<block-id>b\d+</block-id>$", "$1")
