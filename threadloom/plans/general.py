"""Queries p3, p4 and p7 with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.durable import cut
from threadloom.operators import hierarchy, references, shredding
from threadloom.operators.store import latest_states
from threadloom.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


# ---- p3: deeply nested records -----------------------------------------------------------------


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return shredding.shred(shredding.counting_records(load(spark, d, "with_parts")))


@query
def p3_found(spark, d):
    """Every object in a list below ``parts`` with its path."""
    return shredding.list_objects(_nodes(spark, d)).select("message_id", "json_path").distinct()


@query
def p3_entities(spark, d):
    """Rows per entity of the flat tables, with how many of them name an owner that exists."""
    nodes = cut(_nodes(spark, d), "shredded")
    objects = nodes.where(F.col("kind") == "object")
    owners = objects.select("message_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("has_owner"))
    lists = nodes.where(F.col("kind") == "list").select("message_id", F.col("node_id").alias("l"), F.col("parent_id").alias("lp"))
    held = (
        objects.join(lists, (objects["message_id"] == lists["message_id"]) & (objects["parent_id"] == lists["l"]), "left")
        .select(objects["message_id"], "entity", F.coalesce("lp", "parent_id").alias("parent_id"))
        .join(owners, ["message_id", "parent_id"], "left")
    )
    return held.groupBy("entity").agg(F.count("*").alias("n_rows"), F.count("has_owner").alias("n_owned"))


@query
def p3_members(spark, d):
    """Every scalar of every flat row, whatever its entity; rows without scalars have one with a null label."""
    return shredding.flat_rows(_nodes(spark, d)).select("message_id", "entity", "node_id", "owner_id", "ordinal", "json_path", F.explode_outer("members").alias("label", "scalar"))


def _entity(entity: str, is_list: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: shredding.entity_table(cut(_nodes(spark, d), "shredded"), entity, None, is_list)


#: The wide tables; entities that are not named here are in p3_members.
ENTITIES = {
    "p3_parts": "parts",
    "p3_todos": "parts.state.input.todos",
    "p3_questions": "parts.state.input.questions",
    "p3_options": "parts.state.input.questions.options",
    "p3_tool_calls": "parts.state.input.tool_calls",
    "p3_edits": "parts.state.input.tool_calls.parameters.edits",
    "p3_content": "parts.state.input.content",
    "p3_output": "parts.state.output",
    "p3_mentions": "parts.metadata.mentions",
    "p3_files": "parts.state.metadata.files",
    "p3_hunks": "parts.state.metadata.files.hunks",
}
QUERIES["p3_messages"] = _entity("info", False)
QUERIES.update({name: _entity(entity) for name, entity in ENTITIES.items()})


#: Nodes of the counting exports below ``parts`` by their paths, with bare objects as lists of one.
_NODES = r"""
with rec as (
  select message_id, arg_max(payload, (exported_at, record_id)) as payload
  from (select json_extract_string(payload, '$.info.id') as message_id, exported_at, record_id, payload from with_parts where json_valid(payload) and json_type(payload) = 'OBJECT' and json_type(payload, '$.info') = 'OBJECT' and json_type(payload, '$.info.id') = 'VARCHAR')
  where trim(message_id) <> '' group by message_id),
ps as (select message_id, case json_type(payload, '$.parts') when 'OBJECT' then json_array(json_extract(payload, '$.parts')) when 'ARRAY' then json_extract(payload, '$.parts') end as parts from rec),
el as (select message_id, e.key::bigint as i, e.value as part from ps, json_each(ps.parts) e where parts is not null),
sp as (
  select message_id, 'parts[' || i || ']' as base, part, json_type(part) as kind, json_type(part, '$.state') as state_kind,
         case when json_type(part, '$.state') = 'OBJECT' then case when json_type(part, '$.state.input') = 'VARCHAR' then case when json_valid(json_extract_string(part, '$.state.input')) then json_extract_string(part, '$.state.input')::json end else json_extract(part, '$.state.input') end end as input
  from el),
nodes as (
  select message_id, base as path, true as listed, kind from sp
  union all
  select message_id, base || substr(t.fullkey, 2), ends_with(t.fullkey, ']'), t.type from sp, json_tree(case when kind = 'OBJECT' and state_kind = 'OBJECT' then json_merge_patch(part, '{"state": {"input": null}}') else part end) t where t.fullkey <> '$'
  union all
  select message_id, base || '.state.input' || substr(t.fullkey, 2), ends_with(t.fullkey, ']'), t.type
  from (select message_id, base, case when json_type(input) = 'OBJECT' then json_merge_patch(input, json_object(
     'todos', case when json_type(input, '$.todos') = 'OBJECT' then json_array(json_extract(input, '$.todos')) else json_extract(input, '$.todos') end,
     'questions', case when json_type(input, '$.questions') = 'OBJECT' then json_array(json_extract(input, '$.questions')) else json_extract(input, '$.questions') end,
     'tool_calls', case when json_type(input, '$.tool_calls') = 'OBJECT' then json_array(json_extract(input, '$.tool_calls')) else json_extract(input, '$.tool_calls') end,
     'content', case when json_type(input, '$.content') = 'OBJECT' then json_array(json_extract(input, '$.content')) else json_extract(input, '$.content') end)) else input end as input
    from sp where json_type(input) in ('OBJECT', 'ARRAY')), json_tree(input) t where t.fullkey <> '$')
"""
SQL["p3_found"] = f"{_NODES} select distinct message_id, path as json_path from nodes where listed and kind = 'OBJECT'"
SQL["p3_entities"] = rf"""{_NODES},
objects as (
  select message_id, '' as entity, false as owned from rec
  union all
  select message_id, 'info' || regexp_replace(substr(t.fullkey, 2), '\[\d+\]', '', 'g'), true from (select message_id, json_extract(payload, '$.info') as info from rec), json_tree(info) t where t.type = 'OBJECT'
  union all
  select message_id, regexp_replace(path, '\[\d+\]', '', 'g'), true from nodes where kind = 'OBJECT'
  union all
  select message_id, 'parts.state.input', true from sp where json_type(input) = 'OBJECT')
select entity, count(*) as n_rows, count(*) filter (where owned) as n_owned from objects group by 1"""


# ---- p4: hierarchies ---------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(hierarchy.latest_links(load(spark, d, "sessions"), "id", "parent_id", "time_updated"))


@query
def p4_found(spark, d):
    tree = _tree(spark, d)
    return tree.where(F.col("parent").isNotNull()).select(
        F.col("node").alias("id"),
        F.coalesce("root", F.lit("")).alias("root_id"),
        "depth",
        F.array_join("path", "/").alias("full_path"),
    )


@query
def p4_pairs(spark, d):
    """Every session with each of its descendants and the distance between the two."""
    return hierarchy.descendants(_tree(spark, d)).select("ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"))


@query
def p4_descendants(spark, d):
    """How many children and descendants each session has; p4_pairs names them."""
    return hierarchy.descendant_counts(_tree(spark, d))


_LATEST = r"""
latest as (
  select id, case when regexp_replace(parent_id, '^\s+|\s+$', '', 'g') <> '' then regexp_replace(parent_id, '^\s+|\s+$', '', 'g') end as parent
  from (select *, row_number() over (partition by id order by time_updated desc nulls last, parent_id desc nulls last) rn
        from sessions where id is not null)
  where rn = 1),
up as (
  select id, id as cur, parent as nxt, [id] as path, false as cyc from latest
  union all
  select up.id, l.id, l.parent, list_prepend(l.id, up.path), list_contains(up.path, l.id)
  from up join latest l on l.id = up.nxt where not up.cyc),
ended as (
  select id, arg_max(path, len(path)) as path, bool_or(cyc) as cyc from up group by id)
"""
SQL["p4_found"] = f"""
with recursive {_LATEST}
select l.id, case when cyc then '' else path[1] end as root_id,
       case when cyc then -1 else len(path) - 1 end::bigint as depth,
       case when cyc then '' else array_to_string(path, '/') end as full_path
from latest l join ended using (id) where l.parent is not null
"""
SQL["p4_descendants"] = f"""
with recursive {_LATEST},
pairs as (
  select id, path, unnest(range(1, len(path))) as i from ended where not cyc),
counts as (
  select path[i] as a, count(*) as n, count(*) filter (where len(path) - i = 1) as c, max(len(path) - i) as h from pairs group by 1)
select id as node, (len(path) - 1)::bigint as depth, coalesce(c, 0)::bigint as n_children,
       coalesce(n, 0)::bigint as n_descendants, coalesce(h, 0)::bigint as height
from ended left join counts on a = id where not cyc
"""
SQL["p4_pairs"] = f"""
with recursive {_LATEST},
pairs as (
  select id, path, unnest(range(1, len(path))) as i from ended where not cyc)
select path[i] as ancestor, id as descendant, (len(path) - i)::bigint as distance from pairs
"""

# ---- p7: references to records that do not exist ----------------------------------------------


def _parents(spark: SparkSession, d: str) -> DataFrame:
    messages = load(spark, d, "messages").select(
        F.lit("messages").alias("parent_table"), F.col("id").alias("parent_key"), F.col("removed_at").isNotNull().alias("deleted"), F.col("synced_at").alias("seen_at")
    )
    blocks = load(spark, d, "blocks").select(
        F.lit("blocks").alias("parent_table"), F.concat_ws("\n", "session_id", F.col("block_id").cast("string")).alias("parent_key"),
        F.col("removed_at").isNotNull().alias("deleted"), F.col("synced_at").alias("seen_at"),
    )
    return messages.unionByName(blocks)


def _references(spark: SparkSession, d: str) -> DataFrame:
    """References of the counting snapshots: one row per field, holder and key."""
    states = latest_states(load(spark, d, "session_states"), "prune_messages", "message_ids").select(
        "session_id",
        F.col("synced_at").alias("taken_at"),
        F.date_format("updated", "yyyy-MM").alias("ref_month"),
        F.from_json(
            "prune_messages",
            "activeByAnchorMessageId map<string,string>, byMessageId map<string,struct<activeBlockIds:array<string>>>",
        ).alias("p"),
        F.from_json("message_ids", "byRef map<string,string>").alias("m"),
    )

    def ref(table: str, field: str, holder, key):
        return F.struct(F.lit(table).alias("parent_table"), F.lit(field).alias("field_name"), holder.alias("holder"), key.alias("missing_key"))

    pairs = lambda c: F.coalesce(F.map_entries(c), F.array())
    anchors = pairs(F.col("p.activeByAnchorMessageId"))
    found = F.concat(
        F.transform(anchors, lambda e: ref("messages", "activeByAnchorMessageId", e["key"], e["key"])),
        F.transform(anchors, lambda e: ref("blocks", "activeByAnchorMessageId", e["key"], e["value"])),
        F.transform(pairs(F.col("m.byRef")), lambda e: ref("messages", "byRef", e["key"], e["value"])),
        F.flatten(
            F.transform(
                pairs(F.col("p.byMessageId")),
                lambda e: F.transform(F.coalesce(e["value"]["activeBlockIds"], F.array()), lambda b: ref("blocks", "activeBlockIds", e["key"], b)),
            )
        ),
    )
    return (
        states.select("session_id", "taken_at", "ref_month", F.explode(found).alias("r"))
        .select("session_id", "taken_at", "ref_month", "r.*")
        .where(F.col("missing_key").isNotNull())
        .withColumn(
            "parent_key",
            F.when(F.col("parent_table") == "blocks", F.concat_ws("\n", "session_id", "missing_key")).otherwise(F.col("missing_key")),
        )
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(_parents(spark, d), _references(spark, d))


@query
def p7_found(spark, d):
    return _orphans(spark, d).select("session_id", "field_name", "holder", "missing_key", "reason", "ref_month").distinct()


@query
def p7_report(spark, d):
    """Orphan references per referring table, field, month and reason."""
    found = _orphans(spark, d).withColumn("child_table", F.lit("session_states"))
    return references.orphan_report(found, "child_table", "parent_table", "field_name", "ref_month")


_ORPHANS = r"""
snap as (
  select session_id, prune_messages, message_ids, synced_at, strftime(last_updated::timestamptz at time zone 'UTC', '%Y-%m') as ref_month
  from (select *, row_number() over (partition by session_id order by last_updated desc, synced_at, prune_messages desc, message_ids desc) rn from session_states)
  where rn = 1),
anchor as (
  select session_id, synced_at, ref_month, unnest(map_entries((prune_messages->'activeByAnchorMessageId')::map(varchar, varchar))) as e from snap where prune_messages is not null),
named as (
  select session_id, synced_at, ref_month, unnest(map_entries((message_ids->'byRef')::map(varchar, varchar))) as e from snap where message_ids is not null),
entry as (
  select session_id, synced_at, ref_month, unnest(map_entries((prune_messages->'byMessageId')::map(varchar, json))) as e from snap where prune_messages is not null),
refs as (
  select session_id, synced_at, ref_month, 'messages' as parent_table, 'activeByAnchorMessageId' as field_name, e.key as holder, e.key as missing_key from anchor
  union all
  select session_id, synced_at, ref_month, 'blocks', 'activeByAnchorMessageId', e.key, e.value from anchor
  union all
  select session_id, synced_at, ref_month, 'messages', 'byRef', e.key, e.value from named
  union all
  select session_id, synced_at, ref_month, 'blocks', 'activeBlockIds', e.key, unnest((e.value->'activeBlockIds')::varchar[]) from entry),
parents as (
  select 'messages' as parent_table, '' as s, id as k, bool_or(removed_at is not null) as del, min(synced_at) as seen from messages group by all
  union all
  select 'blocks', session_id, block_id::varchar, bool_or(removed_at is not null), min(synced_at) from blocks group by session_id, block_id),
orphan as (
  select r.*, case when p.k is null then 'missing' when del then 'deleted' when seen > synced_at then 'late' end as reason
  from refs r left join parents p on p.parent_table = r.parent_table and p.k = r.missing_key
       and p.s = case when r.parent_table = 'blocks' then r.session_id else '' end)
"""
SQL["p7_found"] = f"""
with {_ORPHANS}
select distinct session_id, field_name, holder, missing_key, reason, ref_month from orphan where reason is not null
"""
SQL["p7_report"] = f"""
with {_ORPHANS}
select 'session_states' as child_table, parent_table, field_name, ref_month, reason, count(*) as n_references,
       count(distinct case when parent_table = 'blocks' then session_id || chr(10) || missing_key else missing_key end) as n_keys
from orphan where reason is not null group by all
"""
