"""Context rewriting over many sessions: references, ranges, blocks, protection and tag clean-up."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as fx
from threadloom.operators import blocks as bx
from threadloom.operators import compress as cx
from threadloom.operators.hierarchy import resolve_hierarchy
from threadloom.operators.scan import scan
from threadloom.operators.store import latest_states
from threadloom.plans import analytics, views
from threadloom.plans.analytics import _message_tokens
from threadloom.plans.views import CTE
from threadloom.sources.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Cell width of the progress display; bucket of message places for range joins.
WIDTH, BUCKET = 20, 64
INPUT_REMOVED = "[input removed due to failed tool call]"
PATTERNS = ["src/auth/**", "**/*.env", "tests/*/*.p?"]
RULES = [("*", "allow"), ("web*", "ask"), ("bash", "deny"), ("ba*", "ask"), ("todo *", "deny"), ("?rep", "deny")]


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _sql(name: str, body: str, recursive: bool = False) -> None:
    SQL[name] = f"with {'recursive ' if recursive else ''}{CTE}{body}"


# ---- order within a session --------------------------------------------------------------------


@query
def last_user_asof(spark, d):
    """For each message the last user message at or before it."""
    m = views.messages(spark, d)
    m = scan(m, ["session_id"], "day", ["t", "id"], {"last_user": ("last", F.when(F.col("role") == "user", F.col("id")))})
    return m.select("session_id", "id", "last_user")


_sql("last_user_asof", "select session_id, id, last_value(case when role = 'user' then id end ignore nulls) over (partition by session_id order by seq) as last_user from m")


@query
def last_user_params(spark, d):
    """Agent and model of the last user message per session."""
    m = views.messages(spark, d, False).where(F.col("role") == "user")
    return m.groupBy("session_id").agg(F.max_by(F.struct("id", "agent"), F.struct("t", "id")).alias("u")).select("session_id", F.col("u.id").alias("message_id"), "u.agent")


_sql("last_user_params", "select session_id, id as message_id, agent from (select *, row_number() over (partition by session_id order by seq desc) as rn from m where role = 'user') where rn = 1")


@query
def turn_anchors(spark, d):
    """User messages that directly follow an answer, after the last compaction of their session."""
    m = views.messages(spark, d)
    m = scan(m, ["session_id"], "day", ["t", "id"], {"before": ("lag", "role"), "cut": ("max_all", F.when(F.col("summary"), F.col("seq")))})
    return m.where((F.col("role") == "user") & (F.col("before") == "assistant") & (F.col("seq") > F.coalesce("cut", F.lit(-1)))).select("session_id", "seq", "id")


_sql(
    "turn_anchors",
    """select session_id, seq, id from (select *, lag(role) over (partition by session_id order by seq) as before, max(case when summary then seq end) over (partition by session_id) as cut from m)
where role = 'user' and before = 'assistant' and seq > coalesce(cut, -1)""",
)


def _refs(spark, d) -> DataFrame:
    """(session_id, id, n) of the references in the counting snapshots."""
    s = latest_states(load(spark, d, "session_states"), "message_ids").select("session_id", F.from_json("message_ids", "byRef map<string,string>").alias("m"))
    rows = s.select("session_id", F.explode("m.byRef").alias("ref", "id")).select("session_id", "id", fx.parse_message_ref(F.col("ref")).alias("n"))
    return rows.where(F.col("n").isNotNull() & F.col("id").isNotNull()).groupBy("session_id", "id").agg(F.min("n").alias("n"))


_REFS = """, snap as (select session_id, message_ids from (select *, row_number() over (partition by session_id order by last_updated desc, synced_at, message_ids desc) as rn from session_states) where rn = 1),
r as (select session_id, id, min(n) as n from (select session_id, e.value as id, nullif(regexp_extract(lower(trim(e.key)), '^m(\\d{4})$', 1), '')::bigint as n
  from (select session_id, unnest(map_entries((message_ids->'byRef')::map(varchar, varchar))) as e from snap where message_ids is not null)) where n >= 1 and id is not null group by all)"""


@query
def message_refs(spark, d):
    """References of all messages: saved ones, and new ones numbered on in order; null past m9999."""
    m = views.messages(spark, d).select("session_id", "id", "t", "day")
    r = _refs(spark, d)
    top = r.groupBy("session_id").agg(F.max("n").alias("top"))
    old = m.join(r, ["session_id", "id"], "left")
    new = scan(old.where(F.col("n").isNull()).drop("n"), ["session_id"], "day", ["t", "id"], {"rn": ("row_number", "")})
    new = new.join(top, "session_id", "left").select("session_id", "id", (F.coalesce("top", F.lit(0)) + F.col("rn")).alias("n"))
    both = old.where(F.col("n").isNotNull()).select("session_id", "id", "n").unionByName(new)
    return both.select("session_id", "id", fx.message_ref(F.col("n")).alias("ref"))


_sql(
    "message_refs",
    f"""{_REFS}, top as (select session_id, max(n) as top from r group by 1),
old as (select m.session_id, m.id, m.seq, r.n from m left join r using (session_id, id)),
allr as (select session_id, id, n from old where n is not null union all
  select o.session_id, o.id, coalesce(top, 0) + row_number() over (partition by o.session_id order by seq) from old o left join top using (session_id) where n is null)
select session_id, id, case when n <= 9999 then 'm' || lpad(n::varchar, 4, '0') end as ref from allr""",
)


@query
def progress_cells(spark, d):
    """Messages per cell of a bar of twenty cells, by their share of the session."""
    m = views.messages(spark, d)
    n = m.groupBy("session_id").agg(F.count("*").alias("n"))
    m = m.join(n, "session_id")
    return m.groupBy("session_id", F.floor(F.col("seq") * WIDTH / F.col("n")).cast("bigint").alias("cell")).agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"))


_sql(
    "progress_cells",
    f"select session_id, floor(seq * {WIDTH} / n)::bigint as cell, count(*) as n_messages, count(*) filter (where role = 'user') as n_user from m join (select session_id, count(*) as n from m group by 1) using (session_id) group by all",
)


@query
def subagent_results(spark, d):
    """Sub-agent sessions: their parent and the tokens of their last two answers."""
    s = views.sessions(spark, d).where(F.col("parent_id").isNotNull()).select(F.col("id").alias("session_id"), "parent_id")
    m = views.messages(spark, d, False).where(F.col("role") == "assistant").select("session_id", "t", "id", "output")
    w = Window.partitionBy("session_id").orderBy(F.desc("t"), F.desc("id"))  # row_number <= 2 is cut down before the shuffle
    last = m.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("session_id").agg(F.sum("output").alias("tokens"), F.max_by("id", F.struct("t", "id")).alias("last_id"), F.count("*").alias("n"))
    return s.join(last, "session_id")


_sql(
    "subagent_results",
    """select s.id as session_id, s.parent_id, sum(output)::bigint as tokens, arg_max(l.id, seq) as last_id, count(*) as n
from s join (select *, row_number() over (partition by session_id order by seq desc) as rn from m where role = 'assistant') l on l.session_id = s.id and rn <= 2 where s.parent_id is not null group by all""",
)

@query
def stale_metadata(spark, d):
    """Text and tool parts whose metadata is dropped: of answers by another provider or model than the last user asked."""
    m = views.messages(spark, d, False).withColumn("by", F.concat_ws("/", "provider", "model"))
    last = m.where(F.col("role") == "user").groupBy("session_id").agg(F.max_by("by", F.struct("t", "id")).alias("asked"))
    old = m.where(F.col("role") == "assistant").join(last, "session_id").where(F.col("by") != F.col("asked")).select("session_id", F.col("id").alias("message_id"), "by", "asked")
    p = views.parts(spark, d, "type", "has_metadata").where(F.col("has_metadata") & F.col("type").isin("text", "tool")).select("id", "message_id")
    return p.join(old, "message_id").select("session_id", "message_id", "id", "by", "asked")


_sql(
    "stale_metadata",
    """, mb as (select *, provider || '/' || model as "by" from m)
select mb.session_id, p.message_id, p.id, mb."by", asked from p join mb on mb.id = p.message_id join (select session_id, arg_max("by", seq) as asked from mb where role = 'user' group by 1) l on l.session_id = mb.session_id
where mb.role = 'assistant' and mb."by" <> asked and p.has_metadata and p.type in ('text', 'tool')""",
)

# ---- ranges ------------------------------------------------------------------------------------


def _ranges(spark, d) -> DataFrame:
    b = views.blocks(spark, d)
    lo, hi = fx.parse_message_ref(F.col("start_id")), fx.parse_message_ref(F.col("end_id"))
    return b.select("session_id", "block_id", lo.alias("lo"), hi.alias("hi")).where(F.col("lo").isNotNull() & (F.col("hi") >= F.col("lo")))


_RANGES = """, rg as (select session_id, block_id, nullif(regexp_extract(lower(trim(start_id)), '^m(\\d{4})$', 1), '')::bigint as lo, nullif(regexp_extract(lower(trim(end_id)), '^m(\\d{4})$', 1), '')::bigint as hi from b)
, ranges as (select * from rg where lo >= 1 and hi >= lo)"""


@query
def range_selection(spark, d):
    """Messages and tokens of each block's range of places; joined by session and bucket of places."""
    r = _ranges(spark, d)
    cells = r.withColumn("cell", F.explode(F.sequence(F.floor((F.col("lo") - 1) / BUCKET), F.floor((F.col("hi") - 1) / BUCKET))))
    m = _message_tokens(spark, d).select("session_id", F.col("seq"), "tokens", F.floor(F.col("seq") / BUCKET).alias("cell"))
    hit = cells.join(m, ["session_id", "cell"]).where(F.col("seq").between(F.col("lo") - 1, F.col("hi") - 1))
    return hit.groupBy("session_id", "block_id").agg(F.count("*").alias("n_messages"), F.sum("tokens").alias("tokens"))


_sql(
    "range_selection",
    f"""{_RANGES}, mt as (select m.*, coalesce(round(chars / 4)::bigint, 0) as tokens
  from m left join (select message_id, sum(length(text)) + count(*) - 1 as chars from p where type = 'text' and not ignored and text is not null group by 1) q on q.message_id = m.id)
select r.session_id, block_id, count(*) as n_messages, sum(tokens)::bigint as tokens from ranges r join mt on mt.session_id = r.session_id and seq between lo - 1 and hi - 1 group by all""",
)


@query
def range_texts(spark, d):
    """The text of each block's range: its text parts in order, a blank line between two (P26)."""
    cells = _ranges(spark, d).withColumn("cell", F.explode(F.sequence(F.floor((F.col("lo") - 1) / BUCKET), F.floor((F.col("hi") - 1) / BUCKET))))
    m = views.messages(spark, d).select("session_id", "id", "seq", F.floor(F.col("seq") / BUCKET).alias("cell"))
    hit = cells.join(m, ["session_id", "cell"]).where(F.col("seq").between(F.col("lo") - 1, F.col("hi") - 1))
    p = views.parts(spark, d, "type", text=F.when(F.col("type") == "text", F.col("text"))).where(F.col("text").isNotNull()).select("message_id", F.coalesce("pt", F.lit(0)).alias("pt"), F.col("id").alias("part_id"), "text")
    said = hit.join(p, hit["id"] == p["message_id"]).groupBy("session_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("seq", "pt", "part_id", "text"))).alias("x"))
    return said.select("session_id", "block_id", F.array_join("x.text", "\n\n").alias("text"))


_sql(
    "range_texts",
    f"""{_RANGES} select r.session_id, block_id, string_agg(p.text, chr(10) || chr(10) order by seq, coalesce(pt, 0), p.id) as text
from ranges r join m on m.session_id = r.session_id and seq between lo - 1 and hi - 1 join p on p.message_id = m.id and p.type = 'text' and p.text is not null group by all""",
)


@query
def priority_ref_lists(spark, d):
    """Per session and priority: the references before the last user message, in order (W17)."""
    t = _message_tokens(spark, d).select("session_id", "id", "seq", "role", fx.priority(F.col("tokens")).alias("priority"))
    last = t.where(F.col("role") == "user").groupBy("session_id").agg(F.max("seq").alias("anchor"))
    refs = message_refs(spark, d).where(F.col("ref").isNotNull()).select("session_id", "id", "ref")
    before = t.join(last, "session_id").where(F.col("seq") < F.col("anchor")).join(refs, ["session_id", "id"])
    return before.groupBy("session_id", "priority").agg(F.sort_array(F.collect_list(F.struct("seq", "ref"))).alias("x")).select("session_id", "priority", F.col("x.ref").alias("refs"))


@query
def prune_error_inputs(spark, d):
    """The inputs of purged failed calls with every top-level text replaced (P15)."""
    gone = analytics.QUERIES["purge_errors"](spark, d).select("call_id")
    c = views.calls(spark, d, "parameters").select("call_id", "parameters").join(gone, "call_id", "left_semi").where(F.try_parse_json("parameters").isNotNull())
    notice = F.lit(json.dumps(INPUT_REMOVED))
    # types from variants, which sort members; everything else from the text of the members
    kinds, raw = F.from_json("parameters", "map<string,variant>"), F.from_json("parameters", "map<string,string>")
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    c = c.select("call_id", "parameters", kinds.alias("kinds"), raw.alias("raw"))
    pairs = F.transform(F.map_keys("kinds"), lambda k: F.concat(name(k), F.lit(":"), F.when(F.schema_of_variant(F.col("kinds")[k]) == "STRING", notice).otherwise(F.coalesce(F.col("raw")[k], F.lit("null")))))
    swap = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.parse_json(notice)).otherwise(v)
    items = F.transform(F.from_json("parameters", "array<variant>"), swap)
    opening = F.substring(F.ltrim("parameters"), 1, 1)
    whole = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return c.select("call_id", F.when(opening == "{", whole).when(opening == "[", F.to_json(items)).otherwise(F.col("parameters")).alias("parameters"))


@query
def clean_outputs(spark, d):
    """Outputs of completed calls without injected reference tags, as strip_tags has the texts (P20)."""
    p = views.parts(spark, d, output=F.when((F.col("type") == "tool") & (F.col("status") == "completed"), F.col("output"))).where(F.col("output").isNotNull())
    return p.select("id", fx.strip_tags(F.col("output")).alias("output"))


_sql(
    "clean_outputs",
    r""" select id, regexp_replace(regexp_replace(regexp_replace(output, '(?is)<context-ref[^>]*>.*?</context-ref>', '', 'g'), '(?i)</?context-ref[^>]*>', '', 'g'), '\n[mM]\d{4}\s*$', '', 'g') as output
from p where type = 'tool' and status = 'completed' and output is not null""",
)


@query
def range_overlap(spark, d):
    """Ranges that begin before the one before them in (start, end, id) order ends."""
    r = _ranges(spark, d).withColumn("cell", F.floor(F.col("lo") / BUCKET))
    r = scan(r, ["session_id"], "cell", ["lo", "hi", "block_id"], {"prev_hi": ("lag", "hi"), "prev_block": ("lag", "block_id")})
    return r.where(F.col("lo") <= F.col("prev_hi")).select("session_id", "block_id", "prev_block")


_sql(
    "range_overlap",
    f"""{_RANGES} select session_id, block_id, prev_block from (select *, lag(hi) over w as prev_hi, lag(block_id) over w as prev_block from ranges window w as (partition by session_id order by lo, hi, block_id)) where lo <= prev_hi""",
)


@query
def boundary_lookup(spark, d):
    """Both ends of each block resolved to live messages: mNNNN through the saved references, bN through
    the anchor of that block of the session, active or not."""
    b = views.blocks(spark, d)
    live = views.messages(spark, d).select("session_id", "id", "seq")
    return bx.resolve_boundaries(b, _refs(spark, d), live).select("session_id", "block_id", "problem", "s_seq", "e_seq")


_sql(
    "boundary_lookup",
    f"""{_REFS}, ends as (
  select session_id, block_id, anchor_message_id, nullif(regexp_extract(lower(trim(start_id)), '^m(\\d{{4}})$', 1), '')::bigint as sm, nullif(regexp_extract(lower(trim(start_id)), '^b([1-9]\\d*)$', 1), '')::bigint as sb,
         nullif(regexp_extract(lower(trim(end_id)), '^m(\\d{{4}})$', 1), '')::bigint as em, nullif(regexp_extract(lower(trim(end_id)), '^b([1-9]\\d*)$', 1), '')::bigint as eb from b),
known as (
  select r.session_id, 'm' as k, r.n, m.seq from r left join m using (session_id, id)
  union all select e.session_id, 'b', e.block_id, m.seq from ends e left join m on m.session_id = e.session_id and m.id = e.anchor_message_id)
select e.session_id, e.block_id, case when (coalesce(sm, 0) < 1 and sb is null) or (coalesce(em, 0) < 1 and eb is null) then 'invalid' when x.n is null or y.n is null then 'unknown' when x.seq is null or y.seq is null then 'gone'
  when x.seq > y.seq then 'reversed' else 'ok' end as problem, x.seq as s_seq, y.seq as e_seq
from ends e left join known x on x.session_id = e.session_id and x.k = case when sm >= 1 then 'm' when sb is not null then 'b' end and x.n = coalesce(sm, sb)
left join known y on y.session_id = e.session_id and y.k = case when em >= 1 then 'm' when eb is not null then 'b' end and y.n = coalesce(em, eb)""",
)

# ---- blocks ------------------------------------------------------------------------------------


def _replayed(spark, d) -> DataFrame:
    return bx.replay(views.blocks(spark, d), views.messages(spark, d, False).select(F.col("id").alias("message_id")))


_REPLAY = """, el as (select b.*, coalesce(deactivated_by_user, false) as off, exists (select 1 from m where m.id = b.anchor_message_id) and not coalesce(deactivated_by_user, false) as eligible from b),
eats as (select distinct session_id, block_id as by_id, created_at as by_at, unnest(consumed_block_ids) as block_id from el where eligible),
kills as (select e.session_id, e.block_id, arg_min(by_id, (by_at, by_id)) as killer from eats e join el using (session_id, block_id) where el.eligible and (by_at, by_id) > (el.created_at, el.block_id) group by all),
rp as (select el.*, killer, eligible and killer is null as now_active from el left join kills using (session_id, block_id))"""


@query
def blocks_active(spark, d):
    """Replay of all blocks: eligible, active and by which block deactivated."""
    return _replayed(spark, d).select("session_id", "block_id", "eligible", "now_active", "killer")


_sql("blocks_active", f"{_REPLAY} select session_id, block_id, eligible, now_active, killer from rp")


@query
def active_summary_tokens(spark, d):
    return _replayed(spark, d).where("now_active").groupBy("session_id").agg(F.sum("summary_tokens").alias("tokens"), F.count("*").alias("n_active"))


_sql("active_summary_tokens", f"{_REPLAY} select session_id, sum(summary_tokens)::bigint as tokens, count(*) as n_active from rp where now_active group by 1")


@query
def block_targets(spark, d):
    return bx.targets(_replayed(spark, d).where("now_active"))


_TARGET = "case when mode = 'message' then run_id else -block_id end"
_sql(
    "block_targets",
    f"""{_REPLAY} select session_id, {_TARGET} as target, min(block_id) as first_block, count(*) as n_blocks, sum(compressed_tokens)::bigint as tokens, max(duration_ms) as duration_ms, arg_min(topic, block_id) as topic
from rp where now_active group by all""",
)


@query
def recompressible(spark, d):
    """Targets whose anchors are all live and of which a user has switched a block off."""
    b = _replayed(spark, d)
    live = F.col("eligible") | F.coalesce("deactivated_by_user", F.lit(False)) & F.col("anchor_live")
    m = views.messages(spark, d, False).select(F.col("id").alias("anchor_message_id"), F.lit(True).alias("anchor_live"))
    b = b.join(m, "anchor_message_id", "left").withColumn("anchor_live", F.coalesce("anchor_live", F.lit(False)))
    return b.groupBy("session_id", bx.target_key().alias("target")).agg(
        F.min(live).alias("all_live"), F.max(F.coalesce("deactivated_by_user", F.lit(False)) & ~F.col("now_active")).alias("switched_off"), F.count("*").alias("n_blocks")
    ).where("all_live and switched_off").select("session_id", "target", "n_blocks")


_sql(
    "recompressible",
    f"""{_REPLAY} select session_id, {_TARGET} as target, count(*) as n_blocks from rp group by all
having bool_and(exists (select 1 from m where m.id = anchor_message_id)) and bool_or(off and not now_active)""".replace("having bool_and(exists (select 1 from m where m.id = anchor_message_id))", "having bool_and(eligible or (off and anchor_message_id in (select id from m)))"),
)


@query
def block_ancestor(spark, d):
    """The nearest active block above each inactive one, along the blocks that consumed them."""
    b = _replayed(spark, d)
    key = lambda c: F.concat_ws("\n", "session_id", F.col(c).cast("string"))
    tree = resolve_hierarchy(b.select(key("block_id").alias("node"), F.when(F.col("killer").isNotNull(), key("killer")).alias("parent")))
    up = tree.select("node", F.posexplode("path").alias("pos", "above"), F.size("path").alias("n")).where(F.col("pos") < F.col("n") - 1)
    active = b.where("now_active").select(key("block_id").alias("above"))
    near = up.join(active, "above").groupBy("node").agg(F.max_by("above", "pos").alias("above"), F.max("pos").alias("pos"), F.max("n").alias("n"))
    part = lambda c, k: F.element_at(F.split(c, "\n"), k)
    return near.select(part("node", 1).alias("session_id"), part("node", 2).cast("bigint").alias("block_id"), part("above", 2).cast("bigint").alias("ancestor"), (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance"))


_sql(
    "block_ancestor",
    f"""{_REPLAY}, up as (select session_id, block_id, killer as ancestor, 1 as distance from rp where killer is not null
  union all select up.session_id, up.block_id, rp.killer, distance + 1 from up join rp on rp.session_id = up.session_id and rp.block_id = up.ancestor where not rp.now_active and rp.killer is not null)
select up.session_id, up.block_id, ancestor, distance::bigint as distance from up join rp on rp.session_id = up.session_id and rp.block_id = up.ancestor and rp.now_active""",
    True,
)


@query
def compacted_messages(spark, d):
    """Messages compacted by the host or inside an active block, per session."""
    m = views.messages(spark, d, False)
    last = m.where("summary").groupBy("session_id").agg(F.max("t").alias("compacted_at"))
    inside = bx.covered(_replayed(spark, d)).select("session_id", F.col("message_id").alias("id"), F.lit(True).alias("inside"))
    m = m.join(last, "session_id", "left").join(inside, ["session_id", "id"], "left")
    return m.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("t") < F.col("compacted_at")).alias("n_before"), F.count("inside").alias("n_inside"))


_sql(
    "compacted_messages",
    f"""{_REPLAY}, cov as (select distinct session_id, unnest(effective_message_ids) as id from rp where now_active)
select m.session_id, count(*) as n, count(*) filter (where t < ca) as n_before, count(cov.id) as n_inside
from m left join (select session_id, max(t) as ca from m where summary group by 1) using (session_id) left join cov on cov.session_id = m.session_id and cov.id = m.id group by 1""",
)


@query
def compressed_view(spark, d):
    """The rewritten message list: what is left outside active blocks and their summaries in place."""
    return bx.compressed_view(views.messages(spark, d), _replayed(spark, d))


_VIEW = """, cov as (select distinct session_id, unnest(effective_message_ids) as id from rp where now_active)"""
_sql(
    "compressed_view",
    f"""{_REPLAY}{_VIEW}
select session_id, seq * 2 as pos, id, 'message' as kind from m where (session_id, id) not in (select (session_id, id) from cov)
union all
select rp.session_id, seq * 2 - 1, 'msg_' || substr(sha256(block_id::varchar || ':' || anchor_message_id), 1, 16), 'summary'
from rp join m on m.session_id = rp.session_id and m.id = rp.anchor_message_id join (select session_id, min(seq) as fu from m where role = 'user' group by 1) u on u.session_id = rp.session_id
where now_active and length(rp.summary) > 0 and fu <= seq""",
)


def _undone(spark, d, off: bool) -> tuple[DataFrame, DataFrame]:
    """Coverage before and after switching the newest active block of each session off, or all
    switched-off blocks on again."""
    b, live = views.blocks(spark, d), views.messages(spark, d, False).select(F.col("id").alias("message_id"))
    now = bx.replay(b, live)
    if off:
        newest = now.where("now_active").groupBy("session_id").agg(F.max("block_id").alias("newest"))
        changed = b.join(newest, "session_id", "left").withColumn("deactivated_by_user", F.coalesce("deactivated_by_user", F.lit(False)) | F.coalesce(F.col("block_id") == F.col("newest"), F.lit(False))).drop("newest")
    else:
        changed = b.withColumn("deactivated_by_user", F.lit(False))
    return bx.covered(now), bx.covered(bx.replay(changed, live))


@query
def decompress_diff(spark, d):
    """Messages that come back when the newest active block of each session is undone."""
    before, after = _undone(spark, d, True)
    return before.join(after, ["session_id", "message_id"], "left_anti")


@query
def recompress_diff(spark, d):
    """Messages that vanish when every switched-off block is redone."""
    before, after = _undone(spark, d, False)
    return after.join(before, ["session_id", "message_id"], "left_anti")


def _again(cte: str, source: str, tag: str) -> str:
    out = cte.replace("from b)", f"from {source} b)")
    for name in ("el", "eats", "kills", "rp"):
        out = re.sub(rf"\b{name}\b", f"{name}{tag}", out)
    return out


_COVER = "select distinct session_id, unnest(effective_message_ids) as message_id from"
_sql(
    "decompress_diff",
    f"""{_REPLAY}, nw as (select session_id, max(block_id) as newest from rp where now_active group by 1),
b2 as (select b.* exclude (deactivated_by_user), coalesce(deactivated_by_user, false) or coalesce(block_id = newest, false) as deactivated_by_user from b left join nw using (session_id)){_again(_REPLAY, "b2", "2")}
{_COVER} rp where now_active except {_COVER} rp2 where now_active""",
)
_sql(
    "recompress_diff",
    f"""{_REPLAY}, b2 as (select b.* exclude (deactivated_by_user), false as deactivated_by_user from b){_again(_REPLAY, "b2", "2")}
{_COVER} rp2 where now_active except {_COVER} rp where now_active""",
)


@query
def session_stats(spark, d):
    """Per session: tokens saved, summary tokens, time spent and distinct messages and tools inside active blocks."""
    b = _replayed(spark, d).where("now_active")
    flat = b.groupBy("session_id").agg(F.sum("compressed_tokens").alias("tokens"), F.sum("summary_tokens").alias("summary_tokens"))
    time = bx.targets(b).groupBy("session_id").agg(F.sum("duration_ms").alias("duration_ms"))
    ids = bx.covered(b).groupBy("session_id").agg(F.count("*").alias("n_messages"))
    tools = b.select("session_id", F.explode("effective_tool_ids").alias("x")).distinct().groupBy("session_id").agg(F.count("*").alias("n_tools"))
    return flat.join(time, "session_id").join(ids, "session_id", "left").join(tools, "session_id", "left").na.fill(0, ["n_messages", "n_tools"])


_sql(
    "session_stats",
    f"""{_REPLAY}, act as (select * from rp where now_active)
select f.session_id, tokens, summary_tokens, duration_ms, coalesce(n_messages, 0) as n_messages, coalesce(n_tools, 0) as n_tools
from (select session_id, sum(compressed_tokens)::bigint as tokens, sum(summary_tokens)::bigint as summary_tokens from act group by 1) f
join (select session_id, sum(x)::bigint as duration_ms from (select session_id, max(duration_ms) as x from act group by session_id, {_TARGET}) group by 1) t using (session_id)
left join (select session_id, count(distinct i) as n_messages from (select session_id, unnest(effective_message_ids) as i from act) group by 1) a using (session_id)
left join (select session_id, count(distinct i) as n_tools from (select session_id, unnest(effective_tool_ids) as i from act) group by 1) o using (session_id)""",
)


@query
def alltime_stats(spark, d):
    """Over all saved states: sessions with saved tokens, their tokens and entries."""
    s = latest_states(load(spark, d, "session_states"), "prune_messages").select("session_id", F.from_json("prune_messages", "byMessageId map<string,struct<tokenCount:bigint>>").alias("p"))
    per = s.select("session_id", F.aggregate(F.map_values("p.byMessageId"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["tokenCount"], F.lit(0))).alias("tokens"), F.size("p.byMessageId").alias("n"))
    return per.where(F.col("tokens") > 0).agg(F.count("*").alias("n_sessions"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n_entries"))


_sql(
    "alltime_stats",
    """, snap as (select session_id, prune_messages from (select *, row_number() over (partition by session_id order by last_updated desc, synced_at, prune_messages desc) as rn from session_states) where rn = 1),
e as (select session_id, unnest(map_values((prune_messages->'byMessageId')::map(varchar, json))) as v from snap where prune_messages is not null),
per as (select session_id, sum(coalesce((v->>'tokenCount')::bigint, 0))::bigint as tokens, count(*) as n from e group by 1)
select count(*) as n_sessions, sum(tokens)::bigint as tokens, sum(n)::bigint as n_entries from per where tokens > 0""",
)

# ---- protection and texts ----------------------------------------------------------------------


@query
def glob_protected(spark, d):
    """Calls one of whose file paths (of single files, patches and edit lists) matches a protected pattern, per tool."""
    c = views.calls(spark, d, paths=fx.parameter_paths(F.col("tool"), F.col("parameters")))
    anyone = "|".join(fx.glob_regex(p) for p in PATTERNS)
    hit = F.exists("paths", lambda p: fx.normalise_path(p).rlike(anyone))
    return c.groupBy("tool").agg(F.count("*").alias("n"), F.sum(F.size("paths").cast("bigint")).alias("n_paths"), F.count_if(F.coalesce(hit, F.lit(False))).alias("n_protected"))


_PATHS = r"""list_distinct(list_filter(list_transform(case
   when tool = 'apply_patch' then regexp_extract_all(coalesce(j->>'patchText', ''), '(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$', 1)
   when tool = 'multiedit' then [j->>'filePath'] || coalesce(list_transform((j->'edits')::json[], lambda x: x->>'filePath'), [])
   else [j->>'filePath', j->>'path'] end, lambda x: trim(x)), lambda x: x is not null and x <> ''))"""
_sql(
    "glob_protected",
    f""", pp as (select tool, coalesce({_PATHS}, []) as paths from (select tool, case when json_valid(parameters) then parameters::json end as j from c))
select tool, count(*) as n, sum(len(paths))::bigint as n_paths, count(*) filter (where len(list_filter(paths, lambda x: regexp_matches(replace(x, repeat(chr(92), 2), '/'), '{"|".join(fx.glob_regex(p) for p in PATTERNS)}'))) > 0) as n_protected
from pp group by 1""".replace("'\\\\'", "'\\'"),
)


@query
def permission_effective(spark, d):
    """The last matching rule per tool name."""
    rules = spark.createDataFrame([(n, p, fx.wildcard_regex(p), a) for n, (p, a) in enumerate(RULES)], "ord int, pattern string, regex string, action string")
    tools = views.calls(spark, d).select("tool").distinct()
    hit = tools.join(F.broadcast(rules), F.expr("tool rlike regex"), "left")
    return hit.groupBy("tool").agg(F.max_by("action", "ord").alias("action"), F.max_by("pattern", "ord").alias("pattern"))


_RULE_ROWS = ", ".join("({}, '{}', '{}', '{}')".format(n, p, fx.wildcard_regex(p), a) for n, (p, a) in enumerate(RULES))
_sql(
    "permission_effective",
    f""", rules(ord, pattern, regex, action) as (values {_RULE_ROWS})
select tool, arg_max(action, ord) as action, arg_max(pattern, ord) as pattern from (select distinct tool from c) left join rules on regexp_matches(tool, regex) group by 1""",
)


def _tagged(text):
    tag = F.lit('<context-ref priority="high">b12</context-ref>')
    return F.concat(F.lit("<protect> keep "), F.substring(text, 1, 20), F.lit(" </protect>"), text, tag, F.lit("\nm0042\n"))


_TAGGED = """, tg as (select id, '<protect> keep ' || substr(text, 1, 20) || ' </protect>' || text || '<context-ref priority="high">b12</context-ref>' || chr(10) || 'm0042' || chr(10) as text
  from p where type = 'text' and text is not null)"""


def _texts(spark, d) -> DataFrame:
    return views.parts(spark, d, text=F.when(F.col("type") == "text", F.col("text"))).where(F.col("text").isNotNull()).select("id", _tagged(F.col("text")).alias("text"))


@query
def strip_tags(spark, d):
    return _texts(spark, d).select("id", fx.strip_tags(F.col("text")).alias("text"))


_sql(
    "strip_tags",
    rf"""{_TAGGED} select id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<context-ref[^>]*>.*?</context-ref>', '', 'g'), '(?i)</?context-ref[^>]*>', '', 'g'), '\n[mM]\d{{4}}\s*$', '', 'g') as text from tg""",
)


@query
def mask_blocks(spark, d):
    return _texts(spark, d).select("id", fx.mask_block_tags(F.col("text")).alias("text"))


_sql("mask_blocks", rf"""{_TAGGED} select id, regexp_replace(text, '(<context-ref(?:\s[^>]*)?>)b\d+', '\1BLOCKED', 'g') as text from tg""")


@query
def protect_tags(spark, d):
    return _texts(spark, d).select("id", F.array_join(fx.protected_bodies(F.col("text")), "|").alias("bodies"))


_sql(
    "protect_tags",
    rf"""{_TAGGED} select id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?is)<protect>(.*?)</protect>', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') as bodies from tg""",
)


@query
def stable_ids(spark, d):
    """Stable ids, references and escaped topics of all blocks."""
    b = views.blocks(spark, d)
    return b.select(
        "session_id", "block_id", fx.stable_id("msg", F.concat_ws(":", F.col("block_id").cast("string"), "anchor_message_id")).alias("stable"), fx.block_ref(F.col("block_id")).alias("ref"),
        fx.escape_attribute(F.coalesce("topic", F.lit(""))).alias("topic"), fx.count_tokens(F.col("summary")).alias("tokens"),
        fx.compression_ratio(F.col("compressed_tokens"), F.col("summary_tokens")).alias("ratio"),
    )


_sql(
    "stable_ids",
    """select session_id, block_id, 'msg_' || substr(sha256(block_id::varchar || ':' || anchor_message_id), 1, 16) as stable, 'b' || block_id::varchar as ref,
 replace(replace(replace(replace(replace(coalesce(topic, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as topic, coalesce(round(length(summary) / 4)::bigint, 0) as tokens,
 case when compressed_tokens <= 0 then 0.0 when summary_tokens <= 0 then 'infinity'::double else greatest(1.0, round(compressed_tokens / summary_tokens)) end::double as ratio from b""",
)


# ---- compression and the whole rewrite ---------------------------------------------------------


@query
def apply_compression(spark, d):
    """Per block in order of creation: messages covered, newly covered, and their tokens."""
    tokens = _message_tokens(spark, d).select("session_id", F.col("id").alias("message_id"), "tokens")
    return cx.newly_compressed(views.blocks(spark, d), tokens)


_MTOK = """, mt as (select m.*, coalesce(round(chars / 4)::bigint, 0) as tokens
  from m left join (select message_id, sum(length(text)) + count(*) - 1 as chars from p where type = 'text' and not ignored and text is not null group by 1) q on q.message_id = m.id)"""
_sql(
    "apply_compression",
    f"""{_MTOK}, cv as (select distinct session_id, block_id, created_at, unnest(effective_message_ids) as mid from b),
fs as (select session_id, mid, arg_min(block_id, (created_at, block_id)) as fb from cv group by all)
select cv.session_id, cv.block_id, count(*) as n_messages, count(*) filter (where fb = cv.block_id) as n_new, coalesce(sum(coalesce(tokens, 0)) filter (where fb = cv.block_id), 0)::bigint as new_tokens
from cv join fs using (session_id, mid) left join mt on mt.session_id = cv.session_id and mt.id = mid group by all""",
)


@query
def placeholder_inject(spark, d):
    """Summaries that consume blocks, with the consumed summaries put in."""
    b = views.blocks(spark, d).where(F.col("summary").isNotNull())
    eats = b.where(F.size("consumed_block_ids") > 0).select("session_id", "block_id", "summary", F.explode("consumed_block_ids").alias("eaten"))
    bodies = b.select("session_id", F.col("block_id").alias("eaten"), F.col("summary").alias("body"))
    got = eats.join(bodies, ["session_id", "eaten"]).groupBy("session_id", "block_id", "summary").agg(F.sort_array(F.collect_list(F.struct(F.col("eaten").alias("id"), "body"))).alias("bodies"))
    named = F.concat("summary", F.lit(" (b"), F.col("bodies")[0]["id"].cast("string"), F.lit(")"))
    return got.select("session_id", "block_id", F.size(cx.placeholders(named)).cast("bigint").alias("n_named"), cx.wrap(F.col("block_id"), cx.inject(named, F.col("bodies"))).alias("text"))


_sql(
    "priority_ref_lists",
    f"""{_REFS}{_MTOK}, top as (select session_id, max(n) as top from r group by 1), old as (select m.session_id, m.id, m.seq, r.n from m left join r using (session_id, id)),
allr as (select session_id, id, n from old where n is not null union all
  select o.session_id, o.id, coalesce(top, 0) + row_number() over (partition by o.session_id order by seq) from old o left join top using (session_id) where n is null),
bf as (select mt.session_id, mt.seq, case when tokens >= 5000 then 'high' when tokens >= 500 then 'medium' else 'low' end as priority, 'm' || lpad(n::varchar, 4, '0') as ref
  from mt join allr on allr.session_id = mt.session_id and allr.id = mt.id and n <= 9999 join (select session_id, max(seq) as anchor from m where role = 'user' group by 1) l on l.session_id = mt.session_id where mt.seq < anchor)
select session_id, priority, list(ref order by seq) as refs from bf group by all""",
)
_sql(
    "placeholder_inject",
    """, eats as (select session_id, block_id, summary, unnest(consumed_block_ids) as eaten from b where summary is not null),
bd as (select e.session_id, e.block_id, e.summary, e.eaten, b.summary as body, row_number() over (partition by e.session_id, e.block_id order by e.eaten, b.summary) as rn from eats e join b on b.session_id = e.session_id and b.block_id = e.eaten and b.summary is not null),
nm as (select session_id, block_id, summary || ' (b' || arg_min(eaten, rn) || ')' as named, list(eaten order by rn) as ids, list(body order by rn) as bodies from bd group by session_id, block_id, summary),
pl as (select *, len(regexp_extract_all(named, '\\((b[1-9]\\d*)\\)|\\{block_([1-9]\\d*)\\}', 0)) as n_named, regexp_replace(regexp_replace(named, '\\(b([1-9]\\d*)\\)', chr(1) || '\\1' || chr(1), 'g'), '\\{block_([1-9]\\d*)\\}', chr(1) || '\\1' || chr(1), 'g') as marked from nm),
fl as (select *, list_reduce(list_prepend({'i': 0::bigint, 'x': marked}, list_transform(list_zip(ids, bodies), lambda z: {'i': z[1], 'x': z[2]})),
    lambda a, z: {'i': 0::bigint, 'x': case when contains(a.x, chr(1) || z.i || chr(1)) then replace(a.x, chr(1) || z.i || chr(1), z.x) else a.x || chr(10) || chr(10) || z.x end}).x as filled from pl)
select session_id, block_id, n_named, '[compressed section]' || chr(10) || trim(regexp_replace(filled, chr(1) || '(\\d+)' || chr(1), '(b\\1)', 'g')) || chr(10) || '<block-id>b' || block_id || '</block-id>' as text from fl""",
)


@query
def rewrite_context(spark, d):
    """The rewritten message list with references and priorities, in order of place."""
    view = QUERIES["compressed_view"](spark, d)
    refs = QUERIES["message_refs"](spark, d)
    tokens = _message_tokens(spark, d).select("session_id", "id", fx.priority(F.col("tokens")).alias("priority"))
    return view.join(refs, ["session_id", "id"], "left").join(tokens, ["session_id", "id"], "left").select("session_id", "pos", "id", "kind", "ref", "priority")


_sql(
    "rewrite_context",
    f"""{_REPLAY}{_VIEW}{_REFS}{_MTOK}, top as (select session_id, max(n) as top from r group by 1),
old as (select m.session_id, m.id, m.seq, r.n from m left join r using (session_id, id)),
allr as (select session_id, id, n from old where n is not null union all
  select o.session_id, o.id, coalesce(top, 0) + row_number() over (partition by o.session_id order by seq) from old o left join top using (session_id) where n is null),
vw as (select session_id, seq * 2 as pos, id, 'message' as kind from m where (session_id, id) not in (select (session_id, id) from cov)
union all
select rp.session_id, seq * 2 - 1, 'msg_' || substr(sha256(block_id::varchar || ':' || anchor_message_id), 1, 16), 'summary'
from rp join m on m.session_id = rp.session_id and m.id = rp.anchor_message_id join (select session_id, min(seq) as fu from m where role = 'user' group by 1) u on u.session_id = rp.session_id
where now_active and length(rp.summary) > 0 and fu <= seq)
select vw.session_id, pos, vw.id, kind, case when n <= 9999 then 'm' || lpad(n::varchar, 4, '0') end as ref,
 case when tokens is null then null when tokens >= 5000 then 'high' when tokens >= 500 then 'medium' else 'low' end as priority
from vw left join allr on allr.session_id = vw.session_id and allr.id = vw.id left join mt on mt.session_id = vw.session_id and mt.id = vw.id""",
)
