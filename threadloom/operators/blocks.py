"""Compression blocks: replay, undo and redo, targets and the compressed view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as fx


def replay(blocks: DataFrame, live: DataFrame) -> DataFrame:
    """Adds eligible, now_active and killer (the block that deactivated it) to the blocks.

    Blocks are visited by (created_at, block_id). One is eligible if its anchor message is live and the
    user has not switched it off; an eligible block is active unless a later eligible one consumes it.
    The visit in order is thus one join of consumed ids with blocks; no row depends on another's result.
    live: message_id. Missing, self and earlier consumed ids have no effect.
    """
    own = blocks.join(live.select(F.col("message_id").alias("live_id")).distinct(), F.col("anchor_message_id") == F.col("live_id"), "left")
    own = own.withColumn("eligible", F.col("live_id").isNotNull() & ~F.coalesce("deactivated_by_user", F.lit(False))).drop("live_id")
    eats = own.where("eligible").select("session_id", F.col("block_id").alias("by_id"), F.col("created_at").alias("by_at"), F.explode(F.array_distinct("consumed_block_ids")).alias("block_id"))
    order = own.where("eligible").select("session_id", "block_id", "created_at")
    killed = (
        eats.join(order, ["session_id", "block_id"])
        .where(F.struct("by_at", "by_id") > F.struct("created_at", "block_id"))
        .groupBy("session_id", "block_id")
        .agg(F.min(F.struct("by_at", "by_id")).alias("k"))
        .select("session_id", "block_id", F.col("k.by_id").alias("killer"))
    )
    return own.join(killed, ["session_id", "block_id"], "left").withColumn("now_active", F.col("eligible") & F.col("killer").isNull())


def covered(replayed: DataFrame) -> DataFrame:
    """(session_id, message_id) of the messages inside active blocks, distinct."""
    return replayed.where("now_active").select("session_id", F.explode("effective_message_ids").alias("message_id")).distinct()


def target_key():
    """Blocks of message mode belong together by run, others stand alone."""
    return F.when(F.col("mode") == "message", F.col("run_id")).otherwise(-F.col("block_id"))


def targets(blocks: DataFrame) -> DataFrame:
    """Blocks grouped to targets: first id, sizes, tokens, longest duration, label."""
    return blocks.groupBy("session_id", target_key().alias("target")).agg(
        F.min("block_id").alias("first_block"), F.count("*").alias("n_blocks"), F.sum("compressed_tokens").alias("tokens"), F.max("duration_ms").alias("duration_ms"), F.min_by("topic", "block_id").alias("topic")
    )


def compressed_view(messages: DataFrame, replayed: DataFrame) -> DataFrame:
    """(session_id, pos, id, kind): messages outside active blocks, and one summary before each anchor.

    messages: session_id, id, seq, role. A summary needs a text and a user message at or before its anchor.
    Positions are twice the place of a message, one less for a summary.
    """
    inside = covered(replayed).select("session_id", F.col("message_id").alias("id"))
    kept = messages.join(inside, ["session_id", "id"], "left_anti").select("session_id", (F.col("seq") * 2).alias("pos"), "id", F.lit("message").alias("kind"))
    first_user = messages.where(F.col("role") == "user").groupBy("session_id").agg(F.min("seq").alias("first_user"))
    anchor = messages.select("session_id", F.col("id").alias("anchor_message_id"), "seq")
    seed = F.concat_ws(":", F.col("block_id").cast("string"), "anchor_message_id")
    summaries = (
        replayed.where(F.col("now_active") & (F.length("summary") > 0))
        .join(anchor, ["session_id", "anchor_message_id"])
        .join(first_user, "session_id")
        .where(F.col("first_user") <= F.col("seq"))
        .select("session_id", (F.col("seq") * 2 - 1).alias("pos"), F.concat(F.lit("msg_"), F.substring(F.sha2(seed, 256), 1, 16)).alias("id"), F.lit("summary").alias("kind"))
    )
    return kept.unionByName(summaries)


def resolve_boundaries(blocks: DataFrame, refs: DataFrame, live: DataFrame) -> DataFrame:
    """Adds s_seq, e_seq (places of both ends) and problem to the blocks.

    refs: session_id, id, n (message references); live: session_id, id, seq. A reference to a message
    names the message; one to a block names the place of that block's anchor. problem: invalid (no
    reference at all), unknown (refers to nothing), gone (its message is not live), reversed (ends before
    it starts), else ok.
    """
    by_message = refs.join(live, ["session_id", "id"], "left").select("session_id", F.lit("message").alias("kind"), "n", "seq")
    anchors = live.withColumnRenamed("id", "anchor_message_id")
    by_block = blocks.select("session_id", "block_id", "anchor_message_id").join(anchors, ["session_id", "anchor_message_id"], "left").select("session_id", F.lit("block").alias("kind"), F.col("block_id").alias("n"), "seq")
    known = by_message.unionByName(by_block)
    out = blocks.withColumn("s", fx.boundary(F.col("start_id"))).withColumn("e", fx.boundary(F.col("end_id")))
    for end in "se":
        side = known.select("session_id", *[F.col(c).alias(f"{end}_{c}") for c in ("kind", "n", "seq")], F.lit(True).alias(f"{end}_ref"))
        out = out.withColumns({f"{end}_kind": F.col(f"{end}.kind"), f"{end}_n": F.col(f"{end}.n")}).join(side, ["session_id", f"{end}_kind", f"{end}_n"], "left")
    problem = (
        F.when(F.col("s").isNull() | F.col("e").isNull(), "invalid")
        .when(F.col("s_ref").isNull() | F.col("e_ref").isNull(), "unknown")
        .when(F.col("s_seq").isNull() | F.col("e_seq").isNull(), "gone")
        .when(F.col("s_seq") > F.col("e_seq"), "reversed")
        .otherwise("ok")
    )
    return out.withColumn("problem", problem).drop("s", "e", "s_ref", "e_ref")
