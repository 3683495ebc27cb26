"""Message rules, tool contents, turns, compression requests and the pruned view, with their oracle SQL.

What is a property of single rows is taken out before anything is shuffled; sizes stand for texts
wherever only tokens are asked. Order within a session comes from ``operators.scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import display
from threadloom.functions import text as fx
from threadloom.operators import blocks as bx
from threadloom.operators.scan import scan
from threadloom.plans import analytics, context, views
from threadloom.plans.views import CTE

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What stands for removed contents.
CLEARED_OUTPUT = "[Old tool result content cleared]"
OUTPUT_REMOVED = "[output removed]"
#: Tools whose output is never replaced.
KEPT_OUTPUTS = ["edit", "write", "question"]
#: References listed one by one in a hint.
LISTED = 10


def query(f):
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _sql(name: str, body: str) -> None:
    SQL[name] = f"with {CTE}{body}"


# ---- rules on messages -------------------------------------------------------------------------


def message_facts(spark, d, numbered: bool = True) -> DataFrame:
    """Messages with ignored_user (a user's whose parts are all ignored, or that has none), has_compress
    (an assistant's with a completed compress call) and compacted (before the last summary of its
    session, or inside an active block)."""
    done = (F.col("type") == "tool") & (F.col("tool") == "compress") & (F.col("status") == "completed")
    flags = views.parts(spark, d, "ignored", compress=F.coalesce(done, F.lit(False))).groupBy("message_id").agg(F.min("ignored").alias("all_ignored"), F.max("compress").alias("compress"))
    m = views.messages(spark, d, numbered)
    last = m.where("summary").groupBy("session_id").agg(F.max("t").alias("cut_at"))
    inside = bx.covered(context._replayed(spark, d)).select("session_id", F.col("message_id").alias("id"), F.lit(True).alias("inside"))
    out = m.join(flags.withColumnRenamed("message_id", "id"), "id", "left").join(last, "session_id", "left").join(inside, ["session_id", "id"], "left")
    return out.withColumns(
        {
            "ignored_user": (F.col("role") == "user") & F.coalesce("all_ignored", F.lit(True)),
            "has_compress": (F.col("role") == "assistant") & F.coalesce("compress", F.lit(False)),
            "before_cut": F.coalesce(F.col("t") < F.col("cut_at"), F.lit(False)),
            "inside": F.coalesce("inside", F.lit(False)),
        }
    ).withColumn("compacted", F.col("before_cut") | F.col("inside")).drop("all_ignored", "compress")


_FACTS = (
    context._REPLAY
    + """, cov as (select distinct session_id, unnest(effective_message_ids) as id from rp where now_active),
mf as (
  select m.*, m.role = 'user' and coalesce(ai, true) as ignored_user, m.role = 'assistant' and coalesce(hc, false) as has_compress, coalesce(m.t < ca, false) as before_cut, cov.id is not null as inside,
         coalesce(m.t < ca, false) or cov.id is not null as compacted
  from m left join (select message_id, bool_and(ignored) as ai, bool_or(coalesce(type = 'tool' and tool = 'compress' and status = 'completed', false)) as hc from p group by 1) q on q.message_id = m.id
  left join (select session_id, max(t) as ca from m where summary group by 1) l on l.session_id = m.session_id left join cov on cov.session_id = m.session_id and cov.id = m.id)"""
)


@query
def message_rules(spark, d):
    """Per message: ignored, holding a compression, protected in message mode, compacted."""
    f = message_facts(spark, d, False)
    return f.select("session_id", "id", "ignored_user", "has_compress", ((F.col("role") == "user") & ~F.col("ignored_user")).alias("protected_user"), "compacted")


_sql("message_rules", f"{_FACTS} select session_id, id, ignored_user, has_compress, role = 'user' and not ignored_user as protected_user, compacted from mf")


@query
def message_aliases(spark, d):
    """References of the live messages. Saved ones stay (those of messages gone are dropped); new ones
    number on in order, but not for ignored user messages, the prompt of a sub-agent session (its
    first user message) and messages from before the last compaction. Null past m9999."""
    f = message_facts(spark, d).select("session_id", "id", "t", "day", "role", "seq", "ignored_user", "before_cut")
    child = views.sessions(spark, d).where(F.col("parent_id").isNotNull()).select(F.col("id").alias("session_id"))
    prompt = f.where((F.col("role") == "user") & ~F.col("ignored_user")).join(child, "session_id", "left_semi").groupBy("session_id").agg(F.min("seq").alias("prompt"))
    saved = context._refs(spark, d).join(f.select("session_id", "id"), ["session_id", "id"], "left_semi")
    top = saved.groupBy("session_id").agg(F.max("n").alias("top"))
    own = f.join(saved, ["session_id", "id"], "left").join(prompt, "session_id", "left")
    skipped = F.col("ignored_user") | F.coalesce(F.col("seq") == F.col("prompt"), F.lit(False)) | F.col("before_cut")
    fresh = scan(own.where(F.col("n").isNull() & ~skipped).select("session_id", "id", "t", "day"), ["session_id"], "day", ["t", "id"], {"rn": ("row_number", "")})
    fresh = fresh.join(top, "session_id", "left").select("session_id", "id", (F.coalesce("top", F.lit(0)) + F.col("rn")).alias("n"))
    return own.where(F.col("n").isNotNull()).select("session_id", "id", "n").unionByName(fresh).select("session_id", "id", fx.message_ref(F.col("n")).alias("ref"))


_ALIASES = (
    context._REFS
    + """, live as (select r.session_id, r.id, r.n from r join m using (session_id, id)),
pr as (select session_id, min(seq) as prompt from mf where role = 'user' and not ignored_user and session_id in (select id from s where parent_id is not null) group by 1),
al as (select session_id, id, n from live union all
  select f.session_id, f.id, coalesce(top, 0) + row_number() over (partition by f.session_id order by f.seq)
  from mf f anti join live on live.session_id = f.session_id and live.id = f.id left join pr on pr.session_id = f.session_id left join (select session_id, max(n) as top from live group by 1) t on t.session_id = f.session_id
  where not ignored_user and not coalesce(f.seq = prompt, false) and not before_cut)"""
)
_sql("message_aliases", f"{_FACTS}{_ALIASES} select session_id, id, case when n <= 9999 then 'm' || lpad(n::varchar, 4, '0') end as ref from al")


@query
def boundary_candidates(spark, d):
    """Per session: what a caller may name, up to ten references one by one, else the first and the last, with their number."""
    a = message_aliases(spark, d).where(F.col("ref").isNotNull())
    w = Window.partitionBy("session_id").orderBy("ref")  # row_number <= n is cut down before the shuffle
    few = a.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= LISTED).groupBy("session_id").agg(F.sort_array(F.collect_list("ref")).alias("listed"))
    per = a.groupBy("session_id").agg(F.count("*").alias("n"), F.min("ref").alias("a"), F.max("ref").alias("b"))
    return per.join(few, "session_id").select("session_id", "n", F.when(F.col("n") <= LISTED, F.array_join("listed", ", ")).otherwise(F.concat("a", F.lit(" to "), "b")).alias("hint"))


_sql(
    "boundary_candidates",
    f"""{_FACTS}{_ALIASES}, rf as (select session_id, 'm' || lpad(n::varchar, 4, '0') as ref from al where n <= 9999)
select session_id, count(*) as n, case when count(*) <= {LISTED} then string_agg(ref, ', ' order by ref) else min(ref) || ' to ' || max(ref) end as hint from rf group by 1""",
)


@query
def turn_anchor_pairs(spark, d):
    """After the last message holding a compression: each answer that a user's message follows (ignored
    ones aside) with the first message of that user's."""
    f = message_facts(spark, d).where(~F.col("ignored_user"))
    f = scan(f.select("session_id", "id", "t", "day", "seq", "role", "has_compress"), ["session_id"], "day", ["t", "id"], {"before": ("lag", F.struct("id", "role", "seq")), "cut": ("max_all", F.when(F.col("has_compress"), F.col("seq")))})
    new = (F.col("role") == "user") & (F.col("before.role") == "assistant") & (F.col("before.seq") > F.coalesce("cut", F.lit(-1)))
    return f.where(new).select("session_id", F.col("before.id").alias("answer_id"), F.col("id").alias("user_id"))


_sql(
    "turn_anchor_pairs",
    f"""{_FACTS}, w as (select *, lag(id) over o as bid, lag(role) over o as br, lag(seq) over o as bs, max(case when has_compress then seq end) over (partition by session_id) as cut from mf where not ignored_user window o as (partition by session_id order by seq))
select session_id, bid as answer_id, id as user_id from w where role = 'user' and br = 'assistant' and bs > coalesce(cut, -1)""",
)


@query
def tool_turns(spark, d):
    """Per session and call, at its first part: the number of step starts so far in messages that are not compacted."""
    m = message_facts(spark, d).where(~F.col("compacted")).select(F.col("id").alias("message_id"), F.col("session_id").alias("sid"), "t", "day")
    p = views.parts(spark, d, "type", "call_id").where(F.col("type").isin("step-start", "tool")).select("message_id", F.col("id").alias("part_id"), F.coalesce("pt", F.lit(0)).alias("pt"), "type", "call_id")
    rows = p.join(m, "message_id").withColumn("starts", F.when(F.col("type") == "step-start", 1).otherwise(0))
    rows = scan(rows, ["sid"], "day", ["t", "message_id", "pt", "part_id"], {"turn": ("sum", "starts")})
    first = rows.where((F.col("type") == "tool") & F.col("call_id").isNotNull()).groupBy("sid", "call_id").agg(F.min(F.struct("t", "message_id", "pt", "part_id", "turn")).alias("x"))
    return first.select(F.col("sid").alias("session_id"), "call_id", "x.turn")


_TURNS = """, st as (
  select m.session_id, p.call_id, p.type, m.seq, coalesce(p.pt, 0) as pt, p.id as pid, sum(case when p.type = 'step-start' then 1 else 0 end) over (partition by m.session_id order by m.seq, coalesce(p.pt, 0), p.id rows unbounded preceding)::bigint as turn
  from p join mf m on m.id = p.message_id where not m.compacted and p.type in ('step-start', 'tool'))"""
_sql("tool_turns", f"{_FACTS}{_TURNS} select session_id, call_id, arg_min(turn, (seq, pt, pid)) as turn from st where type = 'tool' and call_id is not null group by 1, 2")


@query
def turn_counts(spark, d):
    """Per session: step starts in messages that are not compacted."""
    m = message_facts(spark, d, False).where(~F.col("compacted")).select(F.col("id").alias("message_id"), F.col("session_id").alias("sid"))
    p = views.parts(spark, d, "type").where(F.col("type") == "step-start").select("message_id")
    return p.join(m, "message_id").groupBy(F.col("sid").alias("session_id")).agg(F.count("*").alias("n_turns"))


_sql("turn_counts", f"{_FACTS} select m.session_id, count(*) as n_turns from p join mf m on m.id = p.message_id where not m.compacted and p.type = 'step-start' group by 1")


@query
def unread_since(spark, d):
    """Per session: the last message that is not ignored, and how many of those follow the last user's."""
    f = message_facts(spark, d).where(~F.col("ignored_user"))
    last = f.groupBy("session_id").agg(F.max_by("id", "seq").alias("last_id"), F.max("seq").alias("last_seq"), F.max(F.when(F.col("role") == "user", F.col("seq"))).alias("user_seq"))
    after = f.join(last, "session_id").where(F.col("seq") > F.coalesce("user_seq", F.lit(-1))).groupBy("session_id").agg(F.count("*").alias("n_after"))
    return last.join(after, "session_id", "left").select("session_id", "last_id", "last_seq", F.coalesce("n_after", F.lit(0)).alias("n_after"))


_sql(
    "unread_since",
    f"""{_FACTS}, f as (select * from mf where not ignored_user), l as (select session_id, arg_max(id, seq) as last_id, max(seq) as last_seq, max(seq) filter (where role = 'user') as us from f group by 1)
select session_id, last_id, last_seq, count(*) filter (where seq > coalesce(us, -1)) as n_after from l join f using (session_id) group by all""",
)

# ---- contents and tokens of tools --------------------------------------------------------------


def _output_size() -> Column:
    """Characters of a tool part's completed output (of what stands for it once cleared), else of its error."""
    done = F.when(F.col("output").isNotNull(), F.when(F.coalesce("compacted", F.lit(0)) != 0, F.lit(len(CLEARED_OUTPUT))).otherwise(F.length("output")))
    failed = F.when(F.length("error") > 0, F.length("error"))
    return F.when(F.col("type") == "tool", F.when(F.col("status") == "completed", done).when(F.col("status") == "error", failed))


def _joined(sizes: list[Column]) -> Column:
    """Tokens of texts of these sizes (null: none) with one character between two."""
    n = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in sizes), F.lit(0))
    total = sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0))
    return F.round((total + F.greatest(n - 1, F.lit(0))) / 4).cast("bigint")


_OUT = f"""case when p.type = 'tool' then case when p.status = 'completed' then case when p.output is not null then case when coalesce(p.compacted, 0) <> 0 then {len(CLEARED_OUTPUT)} else length(p.output) end end
 when p.status = 'error' and length(p.error) > 0 then length(p.error) end end"""


def _tool_parts(spark, d) -> DataFrame:
    """Tool parts with the sizes of their input (kept with the call) and output."""
    p = views.parts(spark, d, "type", "tool", "call_id", "status", n_out=_output_size()).where(F.col("type") == "tool")
    c = views.calls(spark, d, n_in=F.length("parameters"), n_questions=F.length(F.get_json_object("parameters", "$.questions"))).select("call_id", "n_in", "n_questions")
    return p.join(c, "call_id", "left")


@query
def tool_tokens(spark, d):
    """Per tool part: tokens of input and output, and of what the scripts count (of questions the
    questions, of edits and writes both, else the output)."""
    tool = F.lower(F.trim("tool"))
    script = F.when(tool == "question", _joined([F.col("n_questions")])).when(tool.isin("edit", "write"), _joined([F.col("n_in"), F.col("n_out")])).otherwise(_joined([F.col("n_out")]))
    return _tool_parts(spark, d).select("id", "call_id", _joined([F.col("n_in"), F.col("n_out")]).alias("tokens"), script.alias("script_tokens"))


_TP = f""", tp as (
  select p.id, p.message_id, p.session_id, p.call_id, p.tool, p.status, length(c.parameters) as n_in, {_OUT} as n_out, case when json_valid(c.parameters) then length(c.parameters->>'questions') end as n_q
  from p left join c using (call_id) where p.type = 'tool')"""
_sql(
    "tool_tokens",
    f"""{_TP} select id, call_id, round((coalesce(n_in, 0) + coalesce(n_out, 0) + case when n_in is not null and n_out is not null then 1 else 0 end) / 4)::bigint as tokens,
 round(case when lower(trim(tool)) = 'question' then coalesce(n_q, 0) when lower(trim(tool)) in ('edit', 'write') then coalesce(n_in, 0) + coalesce(n_out, 0) + case when n_in is not null and n_out is not null then 1 else 0 end
   else coalesce(n_out, 0) end / 4)::bigint as script_tokens from tp""",
)


def _segments(spark, d) -> DataFrame:
    """(message_id, size): texts, tool inputs and tool outputs of messages."""
    texts = views.parts(spark, d, size=F.when(F.col("type") == "text", F.length("text"))).select("message_id", "size")
    tools = _tool_parts(spark, d).select("message_id", F.explode(F.array("n_in", "n_out")).alias("size"))
    return texts.unionByName(tools).where(F.col("size").isNotNull())


@query
def all_message_tokens(spark, d):
    """Per message: the number of its texts, tool inputs and outputs, and the tokens of all, joined by one blank."""
    g = _segments(spark, d).groupBy("message_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    m = views.messages(spark, d, False).select("session_id", "id")
    return m.join(g, F.col("id") == F.col("message_id"), "left").select("session_id", "id", F.coalesce("n", F.lit(0)).alias("n_segments"), F.coalesce(F.round((F.col("size") + F.col("n") - 1) / 4).cast("bigint"), F.lit(0)).alias("tokens"))


_ALL = f"""{_TP}, sg as (select message_id, length(text) as size from p where type = 'text' and text is not null union all select message_id, n_in from tp where n_in is not null union all select message_id, n_out from tp where n_out is not null),
am as (select m.session_id, m.id, coalesce(n, 0) as n_segments, coalesce(round((size + n - 1) / 4)::bigint, 0) as tokens from m left join (select message_id, count(*) as n, sum(size)::bigint as size from sg group by 1) q on q.message_id = m.id)"""
_sql("all_message_tokens", f"{_ALL} select * from am")


@query
def token_table(spark, d):
    """Per session: messages, tokens of all contents, the largest message, messages without and with tokens."""
    t = F.col("tokens")
    return all_message_tokens(spark, d).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.sum(t).alias("total"), F.max(t).alias("largest"), F.count_if(t == 0).alias("n_empty"), F.count_if(t > 0).alias("n_filled"))


_sql("token_table", f"{_ALL} select session_id, count(*) as n_messages, sum(tokens)::bigint as total, max(tokens) as largest, count(*) filter (where tokens = 0) as n_empty, count(*) filter (where tokens > 0) as n_filled from am group by 1")


def pruned_calls(spark, d) -> DataFrame:
    """(call_id) of the calls pruned as superseded or as old failures, distinct."""
    return analytics.superseded_calls(analytics.signed_calls(spark, d)).select("call_id").unionByName(analytics.QUERIES["purge_errors"](spark, d).select("call_id")).distinct()


_PRUNED = f"""{analytics._DEDUP}, gone as (select call_id from dd where rn > 1 union
  select call_id from c join (select session_id, max(turn) as now from c group by 1) using (session_id) where status = 'error' and tool not in ('task', 'todowrite') and now - turn >= {analytics.STALE_TURNS})"""


@query
def context_report(spark, d):
    """What fills the context of each session, by the rules of the report: total of the last answer,
    system (first prompt less the first user's text), user texts, tools (of calls that are not pruned)
    and the rest, all of messages that are not compacted; and how many tools and messages are pruned."""
    f = message_facts(spark, d).select("session_id", "id", "seq", "role", "has_tokens", "input", "output", "reasoning", "cache_read", "cache_write", "ignored_user", "compacted", "inside")
    said = views.parts(spark, d, size=F.when((F.col("type") == "text") & ~F.col("ignored"), F.length("text"))).where(F.col("size").isNotNull()).groupBy("message_id").agg(F.count("*").alias("n_texts"), F.sum("size").alias("size"))
    f = f.join(said, F.col("id") == F.col("message_id"), "left")
    answer, user = F.col("role") == "assistant", (F.col("role") == "user") & ~F.col("ignored_user")
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    five = prompt + F.col("output") + F.col("reasoning")
    shown = user & ~F.col("compacted")
    per = f.groupBy("session_id").agg(
        F.max_by(F.when(answer & (F.col("output") > 0), five), F.when(answer & (F.col("output") > 0), F.col("seq"))).alias("total"),
        F.min_by(F.when(answer & (prompt > 0), prompt), F.when(answer & (prompt > 0), F.col("seq"))).alias("first_prompt"),
        F.min_by(F.when(user, F.when(F.col("compacted"), 0).otherwise(F.coalesce("size", F.lit(0)))), F.when(user, F.col("seq"))).alias("first_user"),
        F.sum(F.when(shown, F.col("size"))).alias("user_size"), F.sum(F.when(shown, F.col("n_texts"))).alias("user_texts"), F.count_if("inside").alias("pruned_messages"),
    )
    t = _tool_parts(spark, d).where(F.col("call_id").isNotNull()).select("message_id", "call_id", "n_in", F.when(F.col("status") == "completed", F.col("n_out")).alias("n_out"))
    t = t.join(f.select(F.col("id").alias("message_id"), F.col("session_id"), "compacted"), "message_id").join(pruned_calls(spark, d).withColumn("pruned", F.lit(True)), "call_id", "left")
    within = context._replayed(spark, d).where("now_active").select("session_id", F.explode("effective_tool_ids").alias("call_id")).distinct().withColumn("within", F.lit(True))
    calls = t.withColumn("open", ~F.col("compacted") & F.col("pruned").isNull())
    tools = calls.groupBy("session_id").agg(*[F.sum(F.when(F.col("open"), F.col(c))).alias(c) for c in ("n_in", "n_out")], *[F.count(F.when(F.col("open"), F.col(c))).alias(f"k_{c}") for c in ("n_in", "n_out")])
    ids = calls.groupBy("session_id", "call_id").agg(F.min("compacted").alias("compacted"), F.max("pruned").alias("pruned")).join(within, ["session_id", "call_id"], "left")
    counts = ids.groupBy("session_id").agg(
        F.count("*").alias("tools"), F.count_if(~F.col("compacted") & F.col("pruned").isNull()).alias("tools_in_context"), F.count_if(F.col("pruned").isNotNull() | F.col("within").isNotNull()).alias("pruned_tools")
    )
    joined = lambda size, n: F.coalesce(F.round((F.col(size) + F.col(n) - 1) / 4).cast("bigint"), F.lit(0))
    out = per.join(tools, "session_id", "left").join(counts, "session_id", "left").na.fill(0, ["total", "tools", "tools_in_context", "pruned_tools"]).select(
        "session_id", "total", F.greatest(F.coalesce(F.col("first_prompt") - F.round(F.coalesce("first_user", F.lit(0)) / 4).cast("bigint"), F.lit(0)), F.lit(0)).alias("system_tokens"),
        joined("user_size", "user_texts").alias("user_tokens"), (joined("n_in", "k_n_in") + joined("n_out", "k_n_out")).alias("tool_tokens"), "tools", "tools_in_context", "pruned_tools", "pruned_messages",
    )
    return out.withColumn("assistant_tokens", F.greatest(F.col("total") - F.col("system_tokens") - F.col("user_tokens") - F.col("tool_tokens"), F.lit(0)))


_sql(
    "context_report",
    f"""{_FACTS}{_TP}{_PRUNED}, sz as (select message_id, count(*) as n, sum(length(text))::bigint as size from p where type = 'text' and not ignored and text is not null group by 1),
f as (select mf.*, n as n_texts, size, role = 'user' and not ignored_user as usr, input + cache_read + cache_write as prompt from mf left join sz on sz.message_id = mf.id),
per as (select session_id, arg_max(prompt + output + reasoning, seq) filter (where role = 'assistant' and output > 0) as total, arg_min(prompt, seq) filter (where role = 'assistant' and prompt > 0) as fp,
  arg_min(case when compacted then 0 else coalesce(size, 0) end, seq) filter (where usr) as fu, sum(size) filter (where usr and not compacted)::bigint as us, sum(n_texts) filter (where usr and not compacted)::bigint as ut, count(*) filter (where inside) as pruned_messages from f group by 1),
t as (select mf.session_id, tp.call_id, n_in, case when tp.status = 'completed' then n_out end as n_out, compacted, tp.call_id in (select call_id from gone) as pr from tp join mf on mf.id = tp.message_id where tp.call_id is not null),
tl as (select session_id, sum(n_in) filter (where o)::bigint as si, count(n_in) filter (where o) as ki, sum(n_out) filter (where o)::bigint as so, count(n_out) filter (where o) as ko from (select *, not compacted and not pr as o from t) group by 1),
wi as (select distinct session_id, unnest(effective_tool_ids) as call_id from rp where now_active),
ct as (select i.session_id, count(*) as tools, count(*) filter (where not compacted and not pr) as tools_in_context, count(*) filter (where pr or wi.call_id is not null) as pruned_tools
  from (select session_id, call_id, bool_and(compacted) as compacted, bool_or(pr) as pr from t group by all) i left join wi on wi.session_id = i.session_id and wi.call_id = i.call_id group by 1),
o as (select per.session_id, coalesce(total, 0) as total, greatest(coalesce(fp - round(coalesce(fu, 0) / 4)::bigint, 0), 0) as system_tokens, coalesce(round((us + ut - 1) / 4)::bigint, 0) as user_tokens,
  coalesce(round((si + ki - 1) / 4)::bigint, 0) + coalesce(round((so + ko - 1) / 4)::bigint, 0) as tool_tokens, coalesce(tools, 0) as tools, coalesce(tools_in_context, 0) as tools_in_context, coalesce(pruned_tools, 0) as pruned_tools, pruned_messages
  from per left join tl using (session_id) left join ct using (session_id))
select *, greatest(total - system_tokens - user_tokens - tool_tokens, 0) as assistant_tokens from o""",
)

# ---- pruned parts ------------------------------------------------------------------------------


@query
def pruned_parts(spark, d):
    """The tool parts that pruning rewrites, in messages that are not compacted: completed outputs give
    way to a notice (some tools keep theirs), of failed calls the texts of the input do, of question
    calls the questions. input is null where it stays."""
    m = message_facts(spark, d, False).where(~F.col("compacted")).select(F.col("id").alias("message_id"))
    p = views.parts(spark, d, "type", "call_id", "tool", "status", "output").where((F.col("type") == "tool") & F.col("status").isin("completed", "error"))
    gone = pruned_calls(spark, d)
    hit = p.join(m, "message_id", "left_semi").join(gone, "call_id", "left_semi")
    tool = F.coalesce(F.lower(F.trim("tool")), F.lit(""))
    inputs = context.QUERIES["prune_error_inputs"](spark, d).withColumnRenamed("parameters", "swapped")
    asked = views.calls(spark, d, asked=F.get_json_object("parameters", "$.questions").isNotNull()).select("call_id", "asked")
    out = hit.join(inputs, "call_id", "left").join(asked, "call_id", "left")
    done = F.col("status") == "completed"
    return out.select(
        "id", "call_id", F.when(done & ~tool.isin(KEPT_OUTPUTS), F.lit(OUTPUT_REMOVED)).otherwise(F.col("output")).alias("output"),
        F.when(F.col("status") == "error", F.col("swapped")).alias("input"), (done & (tool == "question") & F.coalesce("asked", F.lit(False))).alias("questions_removed"),
    )


_SWAPPED = """, sw as (
  select g.call_id, case when json_type(g.parameters) = 'OBJECT' then (select '{' || coalesce(string_agg(to_json(e.key)::varchar || ':' || case when e.type = 'VARCHAR' then '"[input removed due to failed tool call]"' else e.value::varchar end, ',' order by e.id), '') || '}' from json_each(g.parameters) e)
    else g.parameters end as swapped
  from (select call_id, json(parameters) as parameters from c where json_valid(parameters) and call_id in (
    select call_id from c join (select session_id, max(turn) as now from c group by 1) using (session_id) where status = 'error' and tool not in ('task', 'todowrite') and now - turn >= 4)) g)"""
_sql("prune_error_inputs", f"{_SWAPPED} select call_id, swapped as parameters from sw")
_sql(
    "pruned_parts",
    f"""{_FACTS}{_PRUNED}{_SWAPPED}, q as (select call_id from c where json_valid(parameters) and (parameters->'questions') is not null)
select p.id, p.call_id, case when p.status = 'completed' and coalesce(lower(trim(p.tool)), '') not in ({", ".join(f"'{t}'" for t in KEPT_OUTPUTS)}) then '{OUTPUT_REMOVED}' else p.output end as output,
 case when p.status = 'error' then sw.swapped end as input, p.status = 'completed' and coalesce(lower(trim(p.tool)), '') = 'question' and p.call_id in (select call_id from q) as questions_removed
from p join mf on mf.id = p.message_id and not mf.compacted left join sw using (call_id) where p.type = 'tool' and p.status in ('completed', 'error') and p.call_id in (select call_id from gone)""",
)

# ---- requests to compress single messages -------------------------------------------------------


@query
def compress_requests(spark, d):
    """Blocks of message mode as requests: why each is passed over, null where it is served. A request
    is a duplicate if an earlier one of its batch (the run) for the same reference was served."""
    f = message_facts(spark, d, False).select("session_id", "id", "ignored_user", "inside")
    refs = context._refs(spark, d).join(f, ["session_id", "id"], "left").select("session_id", "n", F.col("ignored_user").isNotNull().alias("live"), "ignored_user", "inside")
    return resolve_requests(views.blocks(spark, d).where(F.col("mode") == "message").select("session_id", F.col("run_id").alias("batch"), F.col("block_id").alias("ord"), F.col("start_id").alias("message_ref")), refs)


def resolve_requests(requests: DataFrame, refs: DataFrame, protect: bool = False) -> DataFrame:
    """requests (session_id, batch, ord, message_ref) with issue: blocked, invalid-format, block-id,
    not-in-context, protected, already-compressed, duplicate or null.

    refs: session_id, n, live, ignored_user, inside[, user]. protect: messages of users are never served.
    """
    own = requests.withColumn("given", F.regexp_replace("message_ref", r"(?U)^\s+|\s+$", "")).withColumn("n", fx.parse_message_ref(F.col("given")))
    known = own.join(refs, ["session_id", "n"], "left")
    kept = F.col("user") if protect else F.lit(False)
    issue = (
        F.when(F.upper("given") == "BLOCKED", "blocked")
        .when(F.col("n").isNull() & fx.parse_block_ref(F.col("given")).isNotNull(), "block-id")
        .when(F.col("n").isNull(), "invalid-format")
        .when(~F.coalesce("live", F.lit(False)) | F.coalesce("ignored_user", F.lit(False)), "not-in-context")
        .when(kept, "protected")
        .when(F.col("inside"), "already-compressed")
    )
    judged = known.withColumn("issue", issue)
    canonical = F.col("given") == fx.message_ref(F.col("n"))
    served = judged.where(F.col("issue").isNull()).groupBy("session_id", "batch", "n").agg(F.min("ord").alias("first"))
    out = judged.join(served, ["session_id", "batch", "n"], "left")
    again = F.coalesce(canonical & (F.col("ord") > F.col("first")), F.lit(False))
    return out.select("session_id", "batch", "ord", "message_ref", F.when(again, "duplicate").otherwise(F.col("issue")).alias("issue"))


_REQ = """, rq as (select session_id, run_id as batch, block_id as ord, start_id as message_ref, trim(start_id) as given, nullif(regexp_extract(lower(trim(start_id)), '^m(\\d{4})$', 1), '')::bigint as n from b where mode = 'message'),
jd as (select rq.*, case when upper(given) = 'BLOCKED' then 'blocked' when coalesce(rq.n, 0) < 1 and regexp_matches(lower(given), '^b[1-9]\\d*$') then 'block-id' when coalesce(rq.n, 0) < 1 then 'invalid-format'
   when mf.id is null or mf.ignored_user then 'not-in-context' when mf.inside then 'already-compressed' end as issue
 from rq left join r on r.session_id = rq.session_id and r.n = rq.n left join mf on mf.session_id = r.session_id and mf.id = r.id),
ji as (select jd.session_id, jd.batch, jd.ord, message_ref, case when given = 'm' || lpad(jd.n::varchar, 4, '0') and jd.ord > first then 'duplicate' else issue end as issue
 from jd left join (select session_id, batch, n, min(ord) as first from jd where issue is null group by all) q on q.session_id = jd.session_id and q.batch is not distinct from jd.batch and q.n = jd.n)"""
_sql("compress_requests", f"{_FACTS}{context._REFS}{_REQ} select * from ji")


@query
def request_issues(spark, d):
    """Per batch: its issues in the order in which they first came, with the references passed over."""
    r = compress_requests(spark, d).where(F.col("issue").isNotNull()).withColumn("message_ref", F.regexp_replace("message_ref", r"(?U)^\s+|\s+$", ""))
    g = r.groupBy("session_id", "batch", "issue").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "message_ref"))), lambda x: x["message_ref"]), ", ").alias("refs"))
    return g


_sql("request_issues", f"{_FACTS}{context._REFS}{_REQ} select session_id, batch, issue, min(ord) as first, count(*) as n, string_agg(trim(message_ref), ', ' order by ord) as refs from ji where issue is not null group by all")

# ---- sub-agents --------------------------------------------------------------------------------


@query
def subagent_texts(spark, d):
    """Sub-agent sessions with what they report: the last text of the last answer, preceded by that of the
    answer before where it holds a compression. Sessions without such a text are left out."""
    child = views.sessions(spark, d).where(F.col("parent_id").isNotNull()).select(F.col("id").alias("session_id"), "parent_id")
    f = message_facts(spark, d).where(F.col("role") == "assistant").select("session_id", "id", "seq", "has_compress")
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))  # row_number <= 2 is cut down before the shuffle
    last = f.withColumn("rn", F.row_number().over(w)).where("rn <= 2").where("rn = 1 or has_compress").join(child, "session_id")
    blank = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    said = views.parts(spark, d, text=F.when(F.col("type") == "text", F.nullif(blank, F.lit("")))).where(F.col("text").isNotNull())
    said = said.join(last.select(F.col("id").alias("message_id")), "message_id", "left_semi").groupBy("message_id").agg(F.max_by("text", F.struct(F.coalesce("pt", F.lit(0)), "id")).alias("text"))
    both = last.join(said, F.col("id") == F.col("message_id")).groupBy("session_id", "parent_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return both.select("session_id", "parent_id", F.array_join("x.text", "\n\n").alias("text"))


_sql(
    "subagent_texts",
    f"""{_FACTS}, lt as (select * from (select *, row_number() over (partition by session_id order by seq desc) as rn from mf where role = 'assistant') where rn = 1 or (rn = 2 and has_compress)),
tx as (select message_id, arg_max(trim(text, e' \\t\\n\\r'), (coalesce(pt, 0), id)) as text from p where type = 'text' and trim(text, e' \\t\\n\\r') <> '' group by 1)
select lt.session_id, s.parent_id, string_agg(tx.text, chr(10) || chr(10) order by seq) as text from lt join tx on tx.message_id = lt.id join s on s.id = lt.session_id and s.parent_id is not null group by all""",
)


def merge_subagent_results(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """parts (id, child_session, output) with the body of the first result tag of the output replaced
    by the text of the child session (session_id, text). Outputs without a tag or a text stay."""
    child = F.regexp_replace("child_session", r"(?U)^\s+|\s+$", "")
    own = parts.withColumn("child", F.when(child != "", child)).join(texts.select(F.col("session_id").alias("child"), F.col("text").alias("report")), "child", "left")
    pattern = r"(?is)^(.*?<task_result>\s*)(.*?)(\s*</task_result>.*)$"
    at = lambda k: F.regexp_extract("output", pattern, k)
    merged = F.when((F.length("report") > 0) & F.col("output").rlike(pattern), F.concat(at(1), F.col("report"), at(3))).otherwise(F.col("output"))
    return own.select("id", merged.alias("output"))


# ---- the context as a snapshot -----------------------------------------------------------------


@query
def minimized_context(spark, d):
    """What a snapshot of the context keeps: texts that are not ignored, reasoning and tools of the
    messages that are not compacted, without ids of parts and step marks."""
    m = message_facts(spark, d).where(~F.col("compacted")).select("session_id", "seq", F.col("id").alias("message_id"), "role")
    kept = F.when(F.col("type").isin("text", "reasoning") & ~F.col("ignored"), F.col("text")).when(F.col("type") == "tool", F.coalesce("output", "error"))
    p = views.parts(spark, d, "type", "tool", "status", body=kept, ignored_text=(F.col("type") == "text") & F.col("ignored")).where(F.col("type").isin("text", "reasoning", "tool") & ~F.col("ignored_text"))
    return p.select("message_id", "type", "tool", "status", "body").join(m, "message_id").select("session_id", "seq", "role", "type", "tool", "status", "body")


_sql(
    "minimized_context",
    f"""{_FACTS} select m.session_id, m.seq, m.role, p.type, p.tool, p.status, case when p.type in ('text', 'reasoning') and not p.ignored then p.text when p.type = 'tool' then coalesce(p.output, p.error) end as body
from p join mf m on m.id = p.message_id where not m.compacted and p.type in ('text', 'reasoning', 'tool') and not (p.type = 'text' and p.ignored)""",
)


@query
def session_page(spark, d):
    """A page of a listing: root sessions of the directory that comes first, by time of update, the second twenty."""
    s = views.sessions(spark, d)
    first = s.agg(F.min("directory").alias("directory"))
    page = s.where(F.col("parent_id").isNull()).join(F.broadcast(first), "directory").orderBy(F.desc("time_updated"), "id").offset(2).limit(20)  # one row is broadcast
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss")
    return page.select("id", "directory", "title", iso(F.col("time_created")).alias("created"), iso(F.col("time_updated")).alias("updated"))


_sql(
    "session_page",
    """ select id, directory, title, strftime(make_timestamp(time_created * 1000), '%Y-%m-%dT%H:%M:%S') as created, strftime(make_timestamp(time_updated * 1000), '%Y-%m-%dT%H:%M:%S') as updated
from s where parent_id is null and directory = (select min(directory) from s) order by time_updated desc, id limit 20 offset 2""",
)


@query
def call_labels(spark, d):
    """What each call is about, in short."""
    return views.calls(spark, d, label=display.call_label(F.col("tool"), F.col("parameters"))).select("call_id", "tool", "label")


_sql(
    "call_labels",
    r""", j as (select call_id, tool, case when json_valid(parameters) then parameters::json end as v from c),
f as (select call_id, tool, v, nullif(v->>'filePath', '') as file, nullif(v->>'offset', '') as o, nullif(v->>'limit', '') as l, nullif(v->>'pattern', '') as pat, nullif(v->>'path', '') as path, nullif(v->>'description', '') as descr, nullif(v->>'command', '') as cmd,
  list_distinct(list_transform(regexp_extract_all(coalesce(v->>'patchText', ''), '(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$', 1), lambda x: trim(x))) as fs from j)
select call_id, tool, coalesce(case when v is null then ''
 when tool = 'read' and file is not null then file || case when o is not null and l is not null then ' (lines ' || o || '-' || (o::bigint + l::bigint) || ')' when o is not null then ' (lines ' || o || '+)' when l is not null then ' (lines 0-' || l || ')' else '' end
 when tool in ('write', 'edit', 'multiedit') and file is not null then file
 when tool = 'apply_patch' and v->>'patchText' <> '' then case when len(fs) = 0 then 'patch' when len(fs) <= 2 then array_to_string(list_sort(fs), ', ') else len(fs) || ' files' end
 when tool in ('glob', 'grep') then coalesce('"' || pat || '"' || coalesce(' in ' || path, ''), '(unknown pattern)')
 when tool = 'bash' and coalesce(descr, cmd) is not null then coalesce(descr, case when length(cmd) > 50 then substr(cmd, 1, 50) || '...' else cmd end)
 when tool = 'todowrite' then coalesce(json_array_length(v->'todos'), 0) || ' todos'
 when tool = 'task' and descr is not null then descr
 when json(v)::varchar in ('{}', '[]', 'null') then '' else substr(json(v)::varchar, 1, 50) end, '') as label from f""",
)

# ---- limits ------------------------------------------------------------------------------------

#: Context windows of the models of the query below, in tokens.
WINDOWS = {"lumen-large": 200_000, "lumen-mini": 64_000, "orbita-2": 128_000, "cairn-7b": 32_000}
LEAST, MOST = 50, 85


def current_usage(messages: DataFrame) -> DataFrame:
    """(session_id, model, used): the five counters of the last answer with output, 0 where a later
    compaction has made them void or the answer is its summary."""
    spoke = (F.col("role") == "assistant") & (F.col("output") > 0)
    five = F.col("input") + F.col("output") + F.col("reasoning") + F.col("cache_read") + F.col("cache_write")
    per = messages.groupBy("session_id").agg(
        F.max_by(F.struct(five.alias("used"), "model", "t", "summary"), F.when(spoke, F.struct("t", "id"))).alias("u"), F.max(F.when(F.col("summary"), F.col("t"))).alias("compacted")
    )
    void = F.col("u.summary") | F.coalesce(F.col("u.t") < F.col("compacted"), F.lit(False))
    return per.where(F.col("u").isNotNull()).select("session_id", F.col("u.model").alias("model"), F.when(void, F.lit(0)).otherwise(F.col("u.used")).alias("used"))


def against_limits(usage: DataFrame, windows: DataFrame, buffers: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(session_id, used, over_min, over_max): used against percentages of the model's window.

    windows: model, win; buffers: session_id, buffer (tokens of active summaries, added to the upper
    limit). Models without a window are over the lower limit and never over the upper one.
    """
    known = usage.join(windows, "model", "left").join(buffers, "session_id", "left")
    over_max = F.col("used") * 100 > F.col("win") * most + F.coalesce("buffer", F.lit(0)) * 100
    return known.select("session_id", "used", F.coalesce(F.col("used") * 100 >= F.col("win") * least, F.lit(True)).alias("over_min"), F.coalesce(over_max, F.lit(False)).alias("over_max"))


@query
def over_limits(spark, d):
    """Per session: current usage and whether it passes half or 85 % of the window of its model."""
    windows = spark.createDataFrame(list(WINDOWS.items()), "model string, win bigint")
    buffers = context.active_summary_tokens(spark, d).select("session_id", F.col("tokens").alias("buffer"))
    return against_limits(current_usage(views.messages(spark, d, False)), windows, buffers)


_sql(
    "over_limits",
    f"""{context._REPLAY}, windows(model, win) as (values {", ".join(f"('{k}', {v})" for k, v in WINDOWS.items())}),
per as (
  select session_id, arg_max({{'used': input + output + reasoning + cache_read + cache_write, 'model': model, 't': t, 'summary': summary}}, t::varchar || id) filter (where role = 'assistant' and output > 0) as u,
         max(t) filter (where summary) as compacted from m group by 1),
u as (select session_id, u.model as model, case when u.summary or coalesce(u.t < compacted, false) then 0 else u.used end as used from per where u is not null)
select u.session_id, used, coalesce(used * 100 >= win * {LEAST}, true) as over_min, coalesce(used * 100 > win * {MOST} + coalesce(buffer, 0) * 100, false) as over_max
from u left join windows using (model) left join (select session_id, sum(summary_tokens)::bigint as buffer from rp where now_active group by 1) x on x.session_id = u.session_id""",
)

# ---- protected content -------------------------------------------------------------------------


@query
def protected_user_texts(spark, d):
    """Per block that covers messages of users: the first text of each that is not ignored, in order."""
    f = message_facts(spark, d).where((F.col("role") == "user") & ~F.col("ignored_user")).select("session_id", F.col("id").alias("message_id"), "seq")
    blank = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    said = views.parts(spark, d, text=F.when((F.col("type") == "text") & (blank != ""), F.col("text"))).where(F.col("text").isNotNull())
    first = said.groupBy("message_id").agg(F.min_by("text", F.struct(F.coalesce("pt", F.lit(0)), "id")).alias("text"))
    cover = views.blocks(spark, d).select("session_id", "block_id", F.explode(F.array_distinct("effective_message_ids")).alias("message_id"))
    rows = cover.join(f, ["session_id", "message_id"]).join(first, "message_id").groupBy("session_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return rows.select("session_id", "block_id", F.array_join("x.text", "\n\n").alias("text"))


_sql(
    "protected_user_texts",
    f"""{_FACTS}, ft as (select message_id, arg_min(text, (coalesce(pt, 0), id)) as text from p where type = 'text' and trim(text, e' \\t\\n\\r') <> '' group by 1),
cv as (select distinct session_id, block_id, unnest(effective_message_ids) as message_id from b)
select cv.session_id, cv.block_id, string_agg(ft.text, chr(10) || chr(10) order by seq) as text
from cv join mf on mf.session_id = cv.session_id and mf.id = cv.message_id and mf.role = 'user' and not ignored_user join ft on ft.message_id = mf.id group by all""",
)
