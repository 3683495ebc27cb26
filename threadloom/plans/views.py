"""Counting views of the store and the same views as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.scan import day_of, scan
from threadloom.operators.store import epoch_ms, role_name
from threadloom.sources.tables import load

_TOKENS = {"input": "input", "output": "output", "reasoning": "reasoning", "cache_read": "cache.read", "cache_write": "cache.write"}


def _number(name: str, path: str):
    return F.coalesce(F.try_variant_get("v", f"$.tokens.{path}", "bigint"), F.lit(0)).alias(name)


def _read(c: str) -> Column:
    """The decoded object, null for everything else."""
    return F.when(F.substring(F.ltrim(c), 1, 1) == "{", F.try_parse_json(c))


def messages(spark: SparkSession, d: str, numbered: bool = True) -> DataFrame:
    """Messages that exist, have readable data and a known role; seq is their place in the session.

    Members are taken out of the data before the counting row of an id is chosen, so that no body is shuffled.
    """
    src = load(spark, d, "messages").where(F.col("id").isNotNull() & (F.length("session_id") > 0))
    flat = src.select("id", "session_id", "synced_at", "time_created", F.col("removed_at").isNotNull().alias("removed"), _read("data").alias("v")).select(
        "id",
        "removed",
        F.struct(
            "synced_at",
            "session_id",
            F.coalesce(epoch_ms("time_created"), F.lit(0)).alias("t"),
            role_name(F.try_variant_get("v", "$.role", "string")).alias("role"),
            F.coalesce(F.try_variant_get("v", "$.agent", "string"), F.lit("")).alias("agent"),
            F.coalesce(F.try_variant_get("v", "$.providerID", "string"), F.try_variant_get("v", "$.model.providerID", "string"), F.lit("")).alias("provider"),
            F.coalesce(F.try_variant_get("v", "$.modelID", "string"), F.try_variant_get("v", "$.model.modelID", "string"), F.lit("")).alias("model"),
            F.try_variant_get("v", "$.tokens.input", "bigint").isNotNull().alias("has_tokens"),
            *[_number(n, p) for n, p in _TOKENS.items()],
            F.try_variant_get("v", "$.time.completed", "bigint").alias("completed"),
            F.coalesce(F.try_variant_get("v", "$.summary", "boolean"), F.lit(False)).alias("summary"),
        ).alias("m"),
    )
    one = flat.groupBy("id").agg(F.max("removed").alias("removed"), F.max("m").alias("m")).where(~F.col("removed"))
    fields = [c for c in flat.schema["m"].dataType.fieldNames() if c != "synced_at"]
    rows = one.select("id", *[f"m.{c}" for c in fields]).where(F.col("role").isNotNull())
    if not numbered:
        return rows
    rows = scan(rows.withColumn("day", day_of("t")), ["session_id"], "day", ["t", "id"], {"rn": ("row_number", "")})
    return rows.withColumn("seq", (F.col("rn") - 1).cast("bigint")).drop("rn")


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


#: The fields of a part, each an expression over its decoded data ``v``.
PART_FIELDS: dict[str, Callable[[], Column]] = {
    "type": lambda: _text("$.type"), "text": lambda: _text("$.text"), "ignored": lambda: F.coalesce(F.try_variant_get("v", "$.ignored", "boolean"), F.lit(False)),
    "tool": lambda: _text("$.tool"), "call_id": lambda: _text("$.callID"), "status": lambda: _text("$.state.status"), "output": lambda: _text("$.state.output"), "error": lambda: _text("$.state.error"),
    "compacted": lambda: F.try_variant_get("v", "$.state.time.compacted", "bigint"), "reason": lambda: _text("$.reason"), "child_session": lambda: F.coalesce(_text("$.state.metadata.sessionId"), _text("$.metadata.sessionId"), _text("$.state.metadata.sessionID"), _text("$.metadata.sessionID")),
    "has_metadata": lambda: F.coalesce(F.try_variant_get("v", "$.metadata", "variant").isNotNull(), F.lit(False)), "has_tokens": lambda: F.try_variant_get("v", "$.tokens.input", "bigint").isNotNull(),
    **{("output_tokens" if n == "output" else n): (lambda n=n, p=p: _number(n, p)) for n, p in _TOKENS.items()},
    "cost_micro": lambda: F.coalesce(F.round(F.try_variant_get("v", "$.cost", "double") * 1000000).cast("bigint"), F.lit(0)),
}


def parts(spark: SparkSession, d: str, *fields: str, **computed: Column) -> DataFrame:
    """Readable parts, one row per id: id, message_id, session_id, pt, the ``fields`` named and the
    columns ``computed`` from any of ``PART_FIELDS``. Only these are shuffled to choose the counting row."""
    src = load(spark, d, "parts").where(F.col("id").isNotNull() & F.col("message_id").isNotNull())
    v = src.select("id", "message_id", "session_id", "synced_at", epoch_ms("time_created").alias("pt"), _read("data").alias("v"))
    flat = v.select("id", "message_id", "session_id", "synced_at", "pt", F.col("v").isNotNull().alias("readable"), *[f().alias(n) for n, f in PART_FIELDS.items()])
    slim = flat.select("id", F.struct("synced_at", "readable", "message_id", "session_id", "pt", *fields, *[c.alias(n) for n, c in computed.items()]).alias("p"))
    return slim.groupBy("id").agg(F.max("p").alias("p")).where("p.readable").select("id", "p.message_id", "p.session_id", "p.pt", *[f"p.{n}" for n in (*fields, *computed)])


def calls(spark: SparkSession, d: str, *fields: str, **computed: Column) -> DataFrame:
    """One row per call: a finished row before a pending or running one, then the latest.

    Columns: call_id, seen_at, session_id, tool, status, turn, token_count, the ``fields`` of the table
    named and the columns ``computed`` from it (tool stands for the cleaned name). Only these are shuffled.
    """
    src = load(spark, d, "tool_calls").where(F.col("call_id").isNotNull()).withColumn("tool", F.lower(F.regexp_replace("tool", r"(?U)^\s+|\s+$", "")))
    done = ~F.coalesce(F.col("status").isin("pending", "running"), F.lit(False))
    own = ["session_id", "tool", *[f for f in fields if f != "tool"]]
    named = [F.coalesce("status", F.lit("")).alias("status"), F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("token_count", F.lit(0)).alias("token_count")]
    slim = src.select("call_id", "synced_at", F.struct(done.alias("done"), "synced_at", *own, *named, *[c.alias(n) for n, c in computed.items()]).alias("c"))
    one = slim.groupBy("call_id").agg(F.min("synced_at").alias("seen_at"), F.max("c").alias("c"))
    return one.select("call_id", "seen_at", *[f"c.{n}" for n in (*own, "status", "turn", "token_count", *computed)])


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that exist, one row per (session_id, block_id)."""
    src = load(spark, d, "blocks").where(F.col("session_id").isNotNull() & F.col("block_id").isNotNull())
    fields = [c for c in src.columns if c not in ("session_id", "block_id", "removed_at", "synced_at")]
    one = src.groupBy("session_id", "block_id").agg(F.max(F.col("removed_at").isNotNull()).alias("removed"), F.max_by(F.struct(*fields), "synced_at").alias("b"))
    return one.where(~F.col("removed")).select("session_id", "block_id", "b.*").withColumn("mode", F.coalesce("mode", F.lit("range")))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """The counting row of each session; blank parents are null."""
    src = load(spark, d, "sessions").where(F.col("id").isNotNull())
    fields = F.struct("time_updated", "parent_id", "project_id", "directory", "title", "time_created")
    one = src.groupBy("id").agg(F.max(fields).alias("s")).select("id", "s.*")
    parent = F.regexp_replace("parent_id", r"(?U)^\s+|\s+$", "")
    return one.withColumn("parent_id", F.when(parent != "", parent))


#: The same views for the oracle: m, p, c, b, s.
CTE = r"""
m0 as (
  select id, bool_or(removed_at is not null) as removed, arg_max(session_id, synced_at) as session_id, arg_max(time_created, synced_at) as tc, arg_max(data, synced_at) as data
  from messages where id is not null and length(session_id) > 0 group by id),
m1 as (
  select session_id, id, coalesce(case when abs(tc) < 100000000000 then tc * 1000 else tc end, 0) as t, data
  from (select * exclude (data), case when json_valid(data) then data end as data from m0)
  where not removed and json_type(data) = 'OBJECT' and lower(trim(data->>'role')) in ('user', 'assistant')),
m as (
  select session_id, id, t, lower(trim(data->>'role')) as role, coalesce(data->>'agent', '') as agent, coalesce(data->>'providerID', data->>'$.model.providerID', '') as provider, coalesce(data->>'modelID', data->>'$.model.modelID', '') as model,
         (data->>'$.tokens.input') is not null as has_tokens, coalesce((data->>'$.tokens.input')::bigint, 0) as input, coalesce((data->>'$.tokens.output')::bigint, 0) as output,
         coalesce((data->>'$.tokens.reasoning')::bigint, 0) as reasoning, coalesce((data->>'$.tokens.cache.read')::bigint, 0) as cache_read, coalesce((data->>'$.tokens.cache.write')::bigint, 0) as cache_write,
         (data->>'$.time.completed')::bigint as completed, coalesce((data->>'summary')::boolean, false) as summary,
         row_number() over (partition by session_id order by t, id) - 1 as seq
  from m1),
p0 as (
  select id, arg_max(message_id, synced_at) as message_id, arg_max(session_id, synced_at) as session_id, arg_max(time_created, synced_at) as tc, arg_max(data, synced_at) as data
  from parts where id is not null and message_id is not null group by id),
p as (
  select id, message_id, session_id, case when abs(tc) < 100000000000 then tc * 1000 else tc end as pt, data->>'type' as type, data->>'text' as text, coalesce((data->>'ignored')::boolean, false) as ignored,
         data->>'tool' as tool, data->>'callID' as call_id, data->>'$.state.status' as status, data->>'$.state.output' as output, data->>'$.state.error' as error, (data->>'$.state.time.compacted')::bigint as compacted, data->>'reason' as reason,
         coalesce(data->>'$.state.metadata.sessionId', data->>'$.metadata.sessionId', data->>'$.state.metadata.sessionID', data->>'$.metadata.sessionID') as child_session, (data->'metadata') is not null as has_metadata,
         (data->>'$.tokens.input') is not null as has_tokens, coalesce((data->>'$.tokens.input')::bigint, 0) as input, coalesce((data->>'$.tokens.output')::bigint, 0) as output_tokens,
         coalesce((data->>'$.tokens.reasoning')::bigint, 0) as reasoning, coalesce((data->>'$.tokens.cache.read')::bigint, 0) as cache_read, coalesce((data->>'$.tokens.cache.write')::bigint, 0) as cache_write,
         coalesce(round((data->>'cost')::double * 1000000)::bigint, 0) as cost_micro
  from (select * exclude (data), case when json_valid(data) then data end as data from p0) where json_type(data) = 'OBJECT'),
c as (
  select call_id, seen_at, r.session_id, lower(trim(r.tool, e' \t\n\r')) as tool, r.parameters, coalesce(r.status, '') as status, coalesce(r.turn, 0) as turn, coalesce(r.token_count, 0) as token_count
  from (select call_id, min(synced_at) as seen_at, arg_max({'session_id': session_id, 'tool': tool, 'parameters': parameters, 'status': status, 'turn': turn, 'token_count': token_count}, k) as r
        from (select *, ((case when coalesce(status, '') in ('pending', 'running') then 0 else 1 end)::varchar || synced_at::varchar) as k from tool_calls where call_id is not null) group by call_id)),
b as (
  select * exclude (rn, mode, gone), coalesce(mode, 'range') as mode
  from (select *, row_number() over (partition by session_id, block_id order by synced_at desc) as rn, bool_or(removed_at is not null) over (partition by session_id, block_id) as gone from blocks)
  where rn = 1 and not gone),
s as (
  select * exclude (rn, parent_id), case when trim(parent_id) <> '' then trim(parent_id) end as parent_id
  from (select *, row_number() over (partition by id order by time_updated desc, parent_id desc nulls last) as rn from sessions where id is not null) where rn = 1)
"""
