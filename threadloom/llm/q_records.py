"""Queries p2, p5 and p6 over the assistant host's store."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm import conversations, duplicates, pii, secrets
from threadloom.llm.registry import SQL, query
from threadloom.sources.tables import load


@query
def p2_found(spark, d):
    return conversations.conversations(load(spark, d, "messages"), load(spark, d, "parts")).select(
        "session_id", F.col("seq").cast("bigint").alias("seq"), F.col("id").alias("message_id"), "role"
    )


@query
def p2_threads(spark, d):
    """Reply trees of all sessions with their size, over every content message."""
    every = conversations.joined(load(spark, d, "messages"), load(spark, d, "parts"))
    return (
        conversations.reply_trees(conversations.reply_links(conversations.content_rows(every)))
        .groupBy("session_id", "tree_id")
        .agg(F.count("*").alias("n_messages"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    )


SQL["p2_found"] = r"""
with m as (
  select id, session_id, removed, case when abs(tc) < 100000000000 then tc * 1000 else tc end as t,
         case when json_valid(data) and json_type(data) = 'OBJECT' and lower(trim(data->>'role')) in ('user', 'assistant') then lower(trim(data->>'role')) end as role
  from (select id, arg_max(session_id, synced_at) as session_id, arg_max(time_created, synced_at) as tc, arg_max(data, synced_at) as data,
               bool_or(removed_at is not null) as removed from messages group by id)),
p as (
  select message_id, session_id,
         bool_or(coalesce(json_valid(data) and case when json_valid(data) then (data->>'type' = 'tool'
                 or (data->>'type' = 'text' and coalesce(data->>'ignored', 'false') <> 'true' and regexp_matches(data->>'text', '\S'))) end, false)) as content
  from parts group by 1, 2),
broken as (
  select session_id from m where not removed and role is null
  union
  select p.session_id from p anti join m on p.message_id = m.id),
c as (
  select m.*, row_number() over (partition by m.session_id order by t, id) - 1 as seq,
         lead(role) over (partition by m.session_id order by t, id) as nxt
  from m where not removed and role is not null and id in (select message_id from p where content)),
bad as (
  select session_id from c group by 1
  having bool_or(seq = 0 and role <> 'user') or bool_or(role = 'user' and coalesce(nxt, '') <> 'assistant'))
select session_id, seq::bigint as seq, id as message_id, role from c
where session_id not in (select session_id from broken) and session_id not in (select session_id from bad)
"""


@query
def p6_found(spark, d):
    return duplicates.duplicate_calls(load(spark, d, "tool_calls"))


@query
def p6_collapsed(spark, d):
    """Every distinct call once, with the number of calls that made it."""
    return duplicates.collapsed_calls(load(spark, d, "tool_calls"))


_FOLDED = r"""
with r as (select distinct call_id, tool, parameters::json as j, parameters from tool_calls where call_id is not null and parameters is not null and json_valid(parameters)),
t as (
  select r.call_id, r.tool, r.parameters, lower(e.fullkey) as k,
         case when e.type = 'VARCHAR' then 'S' || regexp_replace(lower(e.atom->>'$'), '[^\p{L}\p{N}]', '', 'g') when e.type in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'N' || (e.atom::double)::varchar else e.type || coalesce(e.atom::varchar, '') end as v
  from r, json_tree(r.j) e),
f as (select distinct call_id, regexp_replace(lower(coalesce(tool, '')), '[^\p{L}\p{N}]', '', 'g') || chr(10) || md5(string_agg(k || '=' || v, chr(10) order by k, v)) as sig from t group by call_id, tool, parameters)
"""
SQL["p6_found"] = f"{_FOLDED} select distinct first_call_id, call_id from (select call_id, min(call_id) over (partition by sig) as first_call_id from f) where call_id <> first_call_id"
SQL["p6_collapsed"] = f"{_FOLDED} select min(call_id) as call_id, count(*) as n_calls from f group by sig"


@query
def p5_found(spark, d):
    calls = secrets.found_in_calls(load(spark, d, "tool_calls")).select(
        F.lit("tool_calls").alias("table_name"), F.col("call_id").alias("record_id"), "field_name", F.col("line_no").cast("bigint").alias("line_no")
    )
    configs = secrets.redact_configs(load(spark, d, "model_configs").where(F.col("config_id").isNotNull())).select(
        F.lit("model_configs").alias("table_name"), F.col("config_id").alias("record_id"), F.explode("hits").alias("field_name"), F.lit(1).cast("bigint").alias("line_no")
    )
    return calls.unionByName(configs.distinct())


@query
def p5_redacted_calls(spark, d):
    """Every call row, repeated ones too, with its credentials masked."""
    return secrets.redact_calls(load(spark, d, "tool_calls")).select("call_id", "parameters", F.size("hits").alias("n_hits"))


@query
def p5_redacted_configs(spark, d):
    return secrets.redact_configs(load(spark, d, "model_configs")).select("config_id", "api_key", "url", F.size("hits").alias("n_hits"))


def _pii(spark, d):
    texts = pii.text_parts(load(spark, d, "parts"))
    return texts, pii.personal_information(texts, load(spark, d, "name_lexicon"))


@query
def p1_found(spark, d):
    return _pii(spark, d)[1].select("part_id", "line_no", "kind").distinct()


@query
def p1_redacted(spark, d):
    """Every text part with a typed placeholder for each piece of personal information."""
    return pii.redact(*_pii(spark, d))
