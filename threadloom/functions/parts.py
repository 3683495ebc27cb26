"""Functions on the list of a message's parts, array<struct<id, type, text, status, output>>, as Column expressions.

Lists without a fitting part come back as they are; null lists stay null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as fx


def last_text_index(parts: Column) -> Column:
    """Place (from 0) of the last text part, null without one."""
    places = F.filter(F.transform(parts, lambda p, i: F.when(p["type"] == "text", i)), lambda i: i.isNotNull())
    return F.array_max(places)


def append_to_last_text(parts: Column, addition: Column) -> Column:
    """``addition`` after a blank line at the end of the last text part, once."""
    at = last_text_index(parts)
    return F.transform(parts, lambda p, i: F.when((i == at) & p["text"].isNotNull(), p.withField("text", fx.append_once(p["text"], addition))).otherwise(p))


def append_to_outputs(parts: Column, tag: Column) -> Column:
    """``tag`` at the end of every completed tool output, once."""
    done = lambda p: (p["type"] == "tool") & (p["status"] == "completed") & p["output"].isNotNull()
    return F.transform(parts, lambda p: F.when(done(p) & ~F.contains(p["output"], tag), p.withField("output", F.concat(p["output"], tag))).otherwise(p))


def text_part(seed: Column, content: Column) -> Column:
    """A part of its own that holds ``content``, with an id that depends on the seed only."""
    none = F.lit(None).cast("string")
    return F.struct(fx.stable_id("prt", seed).alias("id"), F.lit("text").alias("type"), content.alias("text"), none.alias("status"), none.alias("output"))


def place_text(role: Column, parts: Column, content: Column, seed: Column) -> Column:
    """``content`` in a message: of a user in the last text part; of an assistant in the first text part,
    else in a part of its own before the first tool part (or at the end)."""
    is_text = F.transform(parts, lambda p: p["type"] == "text")
    first = F.array_position(is_text, F.lit(True)) - 1
    in_first = F.transform(parts, lambda p, i: F.when(i == first, p.withField("text", fx.append_once(F.coalesce(p["text"], F.lit("")), content))).otherwise(p))
    tools = F.array_position(F.transform(parts, lambda p: p["type"] == "tool"), F.lit(True))
    at = F.when(tools > 0, tools).otherwise(F.size(parts) + 1).cast("int")
    alone = F.array_insert(parts, at, text_part(seed, content))
    return F.when(role == "user", F.when(last_text_index(parts).isNotNull(), append_to_last_text(parts, content)).otherwise(alone)).otherwise(F.when(first >= 0, in_first).otherwise(alone))
