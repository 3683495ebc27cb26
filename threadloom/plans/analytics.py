"""Token, cache and tool-call analytics over many sessions, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as fx
from threadloom.operators.scan import scan
from threadloom.plans import views
from threadloom.plans.views import CTE

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Tools counted as context tools in the cache analyses.
CONTEXT_TOOLS = ["task", "todowrite"]
#: Tools that are never pruned.
PROTECTED = ["task", "todowrite"]
STALE_TURNS = 4
SWEEP_CALLS = 5


def query(f):
    """Register a query; the rest of its docstring after 'SQL:' is its oracle."""
    QUERIES[f.__name__] = f
    return f


def _sql(name: str, body: str, recursive: bool = False) -> None:
    SQL[name] = f"with {'recursive ' if recursive else ''}{CTE}{body}"


# ---- listings ----------------------------------------------------------------------------------


@query
def recent_sessions(spark, d):
    """The 50 root sessions updated last; a report of its nature limited."""
    s = views.sessions(spark, d).where(F.col("parent_id").isNull())
    return s.orderBy(F.desc("time_updated"), "id").limit(50).select("id", "project_id", "time_created", "time_updated")


_sql("recent_sessions", "select id, project_id, time_created, time_updated from s where parent_id is null order by time_updated desc, id limit 50")


@query
def session_search(spark, d):
    """Sessions by title: contained text and exact title without case, wildcards as in LIKE."""
    t = F.lower("title")
    return views.sessions(spark, d).where(t.like("%fix%") | (t == "remove cache")).select(
        "id", "title", (F.coalesce(F.nullif("time_updated", F.lit(0)), F.nullif("time_created", F.lit(0)), F.lit(0)) / 1000).alias("last_used"), t.contains("cache").alias("about_cache")
    )


_sql(
    "session_search",
    """select id, title, coalesce(nullif(time_updated, 0), nullif(time_created, 0), 0) / 1000 as last_used, contains(lower(title), 'cache') as about_cache
from s where lower(title) like '%fix%' or lower(title) = 'remove cache'""",
)


@query
def project_sessions(spark, d):
    """Sessions, roots and children per project."""
    return views.sessions(spark, d).groupBy("project_id").agg(
        F.count("*").alias("n_sessions"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"), F.max("time_updated").alias("last_updated")
    )


_sql("project_sessions", "select project_id, count(*) as n_sessions, count(*) filter (where parent_id is null) as n_roots, max(time_updated) as last_updated from s group by 1")


@query
def session_messages(spark, d):
    """Messages with the parts attached to them, none included."""
    m = views.messages(spark, d)
    p = views.parts(spark, d, "type").groupBy("message_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "tool").alias("nt"), F.min("pt").alias("first_part"))
    return m.join(p, m["id"] == p["message_id"], "left").select(
        "session_id", "seq", "id", "role", F.coalesce("n", F.lit(0)).alias("n_parts"), F.coalesce("nt", F.lit(0)).alias("n_tools"), "first_part"
    )


_sql(
    "session_messages",
    """select m.session_id, m.seq, m.id, m.role, coalesce(n, 0) as n_parts, coalesce(nt, 0) as n_tools, first_part
from m left join (select message_id, count(*) n, count(*) filter (where type = 'tool') nt, min(pt) as first_part from p group by 1) q on q.message_id = m.id""",
)


@query
def find_messages(spark, d):
    """Requested message ids in request order, with a row for those not found."""
    wanted = views.messages(spark, d, False).agg(F.min("id").alias("a"), F.max("id").alias("b")).select(
        F.posexplode(F.array("b", F.lit("msg_unknown"), "a")).alias("ord", "wanted")
    )
    m = views.messages(spark, d, False).select("id", "session_id", "role")
    return wanted.join(m, F.col("wanted") == F.col("id"), "left").select(F.col("ord").cast("bigint").alias("ord"), "wanted", F.col("id").isNotNull().alias("found"), "session_id", "role")


_sql(
    "find_messages",
    """, w as (select max(id) as id, 0 as ord from m union all select 'msg_unknown', 1 union all select min(id), 2 from m)
select w.ord::bigint as ord, w.id as wanted, m.id is not null as found, m.session_id, m.role from w left join m using (id)""",
)

# ---- predicates --------------------------------------------------------------------------------


def _message_facts(spark, d) -> DataFrame:
    """Per message: what its parts are, for the predicates."""
    said = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    p = views.parts(spark, d, "type", "status", "ignored", said=said, has_output=F.col("output").isNotNull())
    text = F.col("type") == "text"
    seen = text & ~F.col("ignored") & F.col("said")
    return p.groupBy("message_id").agg(
        F.count("*").alias("n_parts"), F.count_if("ignored").alias("n_ignored"), F.count_if(text).alias("n_text"), F.count_if(text & F.col("ignored")).alias("n_ignored_text"),
        F.count_if(seen).alias("n_seen"), F.count_if((F.col("type") == "tool") & (F.col("status") == "completed") & F.col("has_output")).alias("n_done"),
    )


@query
def message_predicates(spark, d):
    """Counts of messages by role: ignored by every part, ignored by its texts, with visible content."""
    m = views.messages(spark, d, False)
    f = _message_facts(spark, d)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.join(f, m["id"] == f["message_id"], "left").groupBy("role").agg(
        F.count("*").alias("n"),
        F.count_if(n("n_parts") == n("n_ignored")).alias("n_all_ignored"),
        F.count_if((n("n_parts") == 0) | ((n("n_text") > 0) & (n("n_text") == n("n_ignored_text")))).alias("n_texts_ignored"),
        F.count_if((n("n_seen") > 0) | (n("n_done") > 0)).alias("n_visible"),
    )


_FACTS = """, f as (
  select message_id, count(*) as n_parts, count(*) filter (where ignored) as n_ignored, count(*) filter (where type = 'text') as n_text,
         count(*) filter (where type = 'text' and ignored) as n_ignored_text, count(*) filter (where type = 'text' and not ignored and regexp_matches(text, '\\S')) as n_seen,
         count(*) filter (where type = 'tool' and status = 'completed' and output is not null) as n_done from p group by 1)"""
_sql(
    "message_predicates",
    f"""{_FACTS}
select role, count(*) as n, count(*) filter (where coalesce(n_parts, 0) = coalesce(n_ignored, 0)) as n_all_ignored,
       count(*) filter (where coalesce(n_parts, 0) = 0 or (n_text > 0 and n_text = n_ignored_text)) as n_texts_ignored,
       count(*) filter (where n_seen > 0 or n_done > 0) as n_visible
from m left join f on f.message_id = m.id group by 1""",
)


@query
def real_user_messages(spark, d):
    """Sessions with at least five user messages that are not ignored."""
    m = views.messages(spark, d, False).where(F.col("role") == "user")
    f = _message_facts(spark, d)
    real = ~((F.coalesce("n_parts", F.lit(0)) == 0) | ((F.col("n_text") > 0) & (F.col("n_text") == F.col("n_ignored_text"))))
    return m.join(f, m["id"] == f["message_id"], "left").groupBy("session_id").agg(F.count_if(real).alias("n_real")).where("n_real >= 5")


_sql(
    "real_user_messages",
    f"""{_FACTS}
select session_id, count(*) filter (where not (coalesce(n_parts, 0) = 0 or (n_text > 0 and n_text = n_ignored_text))) as n_real
from m left join f on f.message_id = m.id where role = 'user' group by 1 having n_real >= 5""",
)

# ---- tokens ------------------------------------------------------------------------------------


def _steps(spark, d) -> DataFrame:
    p = views.parts(spark, d, "type", "has_tokens", "reason", "input", "output_tokens", "reasoning", "cache_read", "cache_write", "cost_micro").where((F.col("type") == "step-finish") & F.col("has_tokens"))
    m = views.messages(spark, d, False).select(F.col("id").alias("mid"))
    return p.join(m, p["message_id"] == m["mid"], "left_semi")


_STEPS = ", steps as (select * from p where type = 'step-finish' and has_tokens and message_id in (select id from m))"


def _token_sums() -> list[Column]:
    return [
        *[F.sum(c).alias(a) for c, a in (("input", "sum_input"), ("output_tokens", "sum_output"), ("reasoning", "sum_reasoning"), ("cache_read", "sum_cache_read"), ("cache_write", "sum_cache_write"), ("cost_micro", "sum_cost_micro"))],
        F.count("*").alias("n_steps"),
        F.count_if(F.col("reason") == "stop").alias("n_stop"),
        F.count_if(F.col("reason") == "tool-calls").alias("n_tool_calls"),
        F.count_if(~F.coalesce(F.col("reason").isin("stop", "tool-calls"), F.lit(False))).alias("n_other"),
    ]


_SUMS = """sum(input)::bigint as sum_input, sum(output_tokens)::bigint as sum_output, sum(reasoning)::bigint as sum_reasoning, sum(cache_read)::bigint as sum_cache_read, sum(cache_write)::bigint as sum_cache_write,
 sum(cost_micro)::bigint as sum_cost_micro, count(*) as n_steps, count(*) filter (where reason = 'stop') as n_stop, count(*) filter (where reason = 'tool-calls') as n_tool_calls,
 count(*) filter (where coalesce(reason, '') not in ('stop', 'tool-calls')) as n_other"""


@query
def token_stats(spark, d):
    """Per session: sums of the step counters, finish reasons and cache hit rate in percent."""
    out = _steps(spark, d).groupBy("session_id").agg(*_token_sums())
    return out.withColumn("hit_pct", fx.hit_rate(F.col("sum_cache_read"), F.col("sum_input")))


_sql("token_stats", f"{_STEPS} select *, coalesce(sum_cache_read * 100.0::double / nullif(sum_cache_read + sum_input, 0), 0) as hit_pct from (select session_id, {_SUMS} from steps group by 1)")


@query
def token_stats_total(spark, d):
    """Totals over all sessions by re-aggregating the session rows."""
    t = QUERIES["token_stats"](spark, d)
    return t.agg(F.count("*").alias("n_sessions"), *[F.sum(c).alias(c) for c in ("sum_input", "sum_output", "sum_reasoning", "sum_cache_read", "sum_cache_write", "sum_cost_micro", "n_steps")])


_sql(
    "token_stats_total",
    f"""{_STEPS} select count(*) as n_sessions, sum(sum_input)::bigint as sum_input, sum(sum_output)::bigint as sum_output, sum(sum_reasoning)::bigint as sum_reasoning,
 sum(sum_cache_read)::bigint as sum_cache_read, sum(sum_cache_write)::bigint as sum_cache_write, sum(sum_cost_micro)::bigint as sum_cost_micro, sum(n_steps)::bigint as n_steps
from (select session_id, {_SUMS} from steps group by 1)""",
)


def _message_tokens(spark, d) -> DataFrame:
    """Messages with the tokens of their joined texts (one separator between two)."""
    said = (F.col("type") == "text") & ~F.col("ignored")
    p = views.parts(spark, d, size=F.when(said, F.length("text"))).where(F.col("size").isNotNull())
    p = p.groupBy("message_id").agg((F.sum("size") + F.count("*") - 1).alias("chars"))
    m = views.messages(spark, d)
    return m.join(p, m["id"] == p["message_id"], "left").withColumn("tokens", F.coalesce(F.round(F.col("chars") / 4).cast("bigint"), F.lit(0)))


_MT = """, mt as (
  select m.*, coalesce(round(chars / 4)::bigint, 0) as tokens
  from m left join (select message_id, sum(length(text)) + count(*) - 1 as chars from p where type = 'text' and not ignored and text is not null group by 1) q on q.message_id = m.id)"""


@query
def message_tokens(spark, d):
    return _message_tokens(spark, d).select("session_id", "seq", "id", "tokens", fx.priority(F.col("tokens")).alias("priority"))


_sql("message_tokens", f"{_MT} select session_id, seq, id, tokens, case when tokens >= 5000 then 'high' when tokens >= 500 then 'medium' else 'low' end as priority from mt")


@query
def largest_messages(spark, d):
    """The five largest messages, a report limited by nature."""
    return _message_tokens(spark, d).orderBy(F.desc("tokens"), "id").limit(5).select("session_id", "id", "tokens")


_sql("largest_messages", f"{_MT} select session_id, id, tokens from mt order by tokens desc, id limit 5")


@query
def priority_classes(spark, d):
    t = _message_tokens(spark, d)
    return t.groupBy("role", fx.priority(F.col("tokens")).alias("priority")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


_sql("priority_classes", f"{_MT} select role, case when tokens >= 5000 then 'high' when tokens >= 500 then 'medium' else 'low' end as priority, count(*) as n, sum(tokens)::bigint as tokens from mt group by all")


@query
def priority_refs_before(spark, d):
    """Per session: messages of 30 tokens or more strictly before the last user message."""
    t = _message_tokens(spark, d).select("session_id", "seq", "role", "tokens")
    last = t.where(F.col("role") == "user").groupBy("session_id").agg(F.max("seq").alias("anchor"))
    return t.join(last, "session_id").where((F.col("seq") < F.col("anchor")) & (F.col("tokens") >= 30)).groupBy("session_id").agg(
        F.count("*").alias("n_refs"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


_sql(
    "priority_refs_before",
    f"""{_MT} select session_id, count(*) as n_refs, min(seq) as first_seq, max(seq) as last_seq from mt join (select session_id, max(seq) as anchor from mt where role = 'user' group by 1) using (session_id)
where seq < anchor and tokens >= 30 group by 1""",
)


@query
def context_breakdown(spark, d):
    """Per session: system, user, tool and assistant tokens of the context and their total."""
    t = _message_tokens(spark, d)
    five = F.col("input") + F.col("output") + F.col("reasoning") + F.col("cache_read") + F.col("cache_write")
    answer = (F.col("role") == "assistant") & F.col("has_tokens")
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    user = F.col("role") == "user"
    per = t.groupBy("session_id").agg(
        F.max_by(F.when(answer & (F.col("output") > 0), five), F.when(answer & (F.col("output") > 0), F.col("seq"))).alias("total"),
        F.min_by(F.when(answer & (prompt > 0), prompt), F.when(answer & (prompt > 0), F.col("seq"))).alias("first_prompt"),
        F.min_by(F.when(user, F.col("tokens")), F.when(user, F.col("seq"))).alias("first_user"),
        F.sum(F.when(user, F.col("tokens")).otherwise(0)).alias("user_tokens"),
    )
    c = views.calls(spark, d, n_in=F.length("parameters")).select("call_id", "n_in")
    p = views.parts(spark, d, "type", "call_id", n_out=F.when(F.col("status") == "completed", F.length("output"))).where((F.col("type") == "tool") & F.col("call_id").isNotNull()).select("session_id", "call_id", "n_out")
    tools = p.join(c, "call_id", "left").groupBy("session_id").agg(F.count("*").alias("n_tools"), F.round((F.coalesce(F.sum("n_in"), F.lit(0)) + F.coalesce(F.sum("n_out"), F.lit(0))) / 4).cast("bigint").alias("tool_tokens"))
    out = per.join(tools, "session_id", "left").na.fill(0, ["total", "n_tools", "tool_tokens", "first_user"])
    out = out.withColumn("system_tokens", F.greatest(F.coalesce(F.col("first_prompt") - F.col("first_user"), F.lit(0)), F.lit(0)))
    rest = F.col("total") - F.col("system_tokens") - F.col("user_tokens") - F.col("tool_tokens")
    return out.select("session_id", "total", "system_tokens", "user_tokens", "tool_tokens", F.greatest(rest, F.lit(0)).alias("assistant_tokens"), "n_tools")


_sql(
    "context_breakdown",
    f"""{_MT}, per as (
  select session_id, arg_max(input + output + reasoning + cache_read + cache_write, seq) filter (where role = 'assistant' and has_tokens and output > 0) as total,
         arg_min(input + cache_read + cache_write, seq) filter (where role = 'assistant' and has_tokens and input + cache_read + cache_write > 0) as first_prompt,
         coalesce(arg_min(tokens, seq) filter (where role = 'user'), 0) as first_user, coalesce(sum(tokens) filter (where role = 'user'), 0)::bigint as user_tokens
  from mt group by 1),
tools as (
  select p.session_id, count(*) as n_tools, round((coalesce(sum(length(c.parameters)), 0) + coalesce(sum(length(p.output)) filter (where p.status = 'completed'), 0)) / 4)::bigint as tool_tokens
  from p left join c using (call_id) where p.type = 'tool' and p.call_id is not null group by 1),
j as (
  select session_id, coalesce(total, 0) as total, greatest(coalesce(first_prompt - first_user, 0), 0) as system_tokens, user_tokens, coalesce(tool_tokens, 0) as tool_tokens, coalesce(n_tools, 0) as n_tools
  from per left join tools using (session_id))
select session_id, total, system_tokens, user_tokens, tool_tokens, greatest(total - system_tokens - user_tokens - tool_tokens, 0) as assistant_tokens, n_tools from j""",
)

# ---- cache impact ------------------------------------------------------------------------------


def _answers(spark, d) -> DataFrame:
    m = views.messages(spark, d, False)
    return m.where((F.col("role") == "assistant") & F.col("has_tokens")).withColumn("day", F.floor(F.col("t") / 86_400_000))


_ANS = ", a as (select * from m where role = 'assistant' and has_tokens)"


@query
def step_timeline(spark, d):
    """Per answer: change of cache and input against the answer before, pause and duration."""
    a = scan(_answers(spark, d), ["session_id"], "day", ["t", "id"], {"prev_cache": ("lag", "cache_read"), "prev_input": ("lag", "input"), "prev_done": ("lag", "completed")})
    return a.select(
        "session_id", "id", (F.col("cache_read") - F.coalesce("prev_cache", F.lit(0))).alias("d_cache"), (F.col("input") - F.coalesce("prev_input", F.lit(0))).alias("d_input"),
        (F.col("t") - F.col("prev_done")).alias("gap_ms"), (F.col("completed") - F.col("t")).alias("duration_ms"), fx.hit_rate(F.col("cache_read"), F.col("input")).alias("hit_pct"),
    )


_sql(
    "step_timeline",
    f"""{_ANS} select session_id, id, cache_read - coalesce(lag(cache_read) over w, 0) as d_cache, input - coalesce(lag(input) over w, 0) as d_input, t - lag(completed) over w as gap_ms,
 completed - t as duration_ms, coalesce(cache_read * 100.0::double / nullif(cache_read + input, 0), 0) as hit_pct from a window w as (partition by session_id order by t, id)""",
)


@query
def timeline_totals(spark, d):
    """Per session: sums of the timeline and pooled hit rate."""
    return _answers(spark, d).groupBy("session_id").agg(
        F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read"), F.sum(F.coalesce(F.col("completed") - F.col("t"), F.lit(0))).alias("duration_ms"),
        fx.hit_rate(F.sum("cache_read"), F.sum("input")).alias("hit_pct"),
    )


_sql(
    "timeline_totals",
    f"""{_ANS} select session_id, sum(input)::bigint as input, sum(output)::bigint as output, sum(cache_read)::bigint as cache_read, sum(coalesce(completed - t, 0))::bigint as duration_ms,
 coalesce(sum(cache_read)::bigint * 100.0::double / nullif(sum(cache_read)::bigint + sum(input)::bigint, 0), 0) as hit_pct from a group by 1""",
)


def _context_steps(spark, d) -> DataFrame:
    p = views.parts(spark, d, "type", "tool").where((F.col("type") == "tool") & F.lower(F.trim("tool")).isin(CONTEXT_TOOLS))
    tools = p.groupBy("message_id").agg(F.count_if(F.lower(F.trim("tool")) == CONTEXT_TOOLS[0]).alias("n0"), F.count_if(F.lower(F.trim("tool")) == CONTEXT_TOOLS[1]).alias("n1"))
    a = _answers(spark, d)
    return a.join(tools, a["id"] == tools["message_id"], "left").na.fill(0, ["n0", "n1"])


_CST = f"""{_ANS}, cs as (
  select a.*, coalesce(n0, 0) as n0, coalesce(n1, 0) as n1 from a left join (
    select message_id, count(*) filter (where lower(trim(tool)) = '{CONTEXT_TOOLS[0]}') as n0, count(*) filter (where lower(trim(tool)) = '{CONTEXT_TOOLS[1]}') as n1
    from p where type = 'tool' and lower(trim(tool)) in ('{CONTEXT_TOOLS[0]}', '{CONTEXT_TOOLS[1]}') group by 1) q on q.message_id = a.id)"""


@query
def impact_by_tool(spark, d):
    """Per context tool: calls and the prompt before and after the step that made them."""
    s = scan(
        _context_steps(spark, d), ["session_id"], "day", ["t", "id"],
        {"p0": ("lag", "n0"), "p1": ("lag", "n1"), "prev_input": ("lag", "input"), "prev_cache": ("lag", "cache_read")},
    )
    pair = F.explode(F.array(F.struct(F.lit(CONTEXT_TOOLS[0]).alias("tool"), F.col("p0").alias("k")), F.struct(F.lit(CONTEXT_TOOLS[1]).alias("tool"), F.col("p1").alias("k"))))
    e = s.select("input", "cache_read", "prev_input", "prev_cache", pair.alias("x")).where(F.col("x.k") > 0)
    k = F.col("x.k")
    return e.groupBy(F.col("x.tool").alias("tool")).agg(
        F.sum(k).alias("n_calls"), F.sum(k * F.col("prev_input")).alias("input_before"), F.sum(k * F.col("input")).alias("input_after"),
        F.sum(k * F.col("prev_cache")).alias("cache_before"), F.sum(k * F.col("cache_read")).alias("cache_after"), F.sum(k * F.greatest(F.col("prev_cache") - F.col("cache_read"), F.lit(0))).alias("cache_lost"),
    )


_sql(
    "impact_by_tool",
    f"""{_CST}, l as (select lag(n0) over w as p0, lag(n1) over w as p1, lag(input) over w as pi, lag(cache_read) over w as pc, input, cache_read from cs window w as (partition by session_id order by t, id)),
e as (select '{CONTEXT_TOOLS[0]}' as tool, p0 as k, * from l where p0 > 0 union all select '{CONTEXT_TOOLS[1]}', p1, * from l where p1 > 0)
select tool, sum(k)::bigint as n_calls, sum(k * pi)::bigint as input_before, sum(k * input)::bigint as input_after, sum(k * pc)::bigint as cache_before, sum(k * cache_read)::bigint as cache_after,
 sum(k * greatest(pc - cache_read, 0))::bigint as cache_lost from e group by 1""",
)


def _impact_events(spark, d) -> DataFrame:
    """One row per context call: the counters of its own answer and of the next."""
    s = scan(
        _context_steps(spark, d), ["session_id"], "day", ["t", "id"],
        {"k": ("lag", F.col("n0") + F.col("n1")), "prev_input": ("lag", "input"), "prev_cache": ("lag", "cache_read")},
    )
    return s.where(F.col("k") > 0).select("session_id", "k", "input", "cache_read", "prev_input", "prev_cache")


@query
def impact_total(spark, d):
    """Over all context calls: pooled hit rates before and after, average prompts and what left the cache."""
    e, k = _impact_events(spark, d), F.col("k")
    sums = e.agg(*[F.coalesce(F.sum(k * F.col(c)), F.lit(0)).alias(c) for c in ("input", "cache_read", "prev_input", "prev_cache")], F.coalesce(F.sum(k), F.lit(0)).alias("n_calls"))
    return sums.select(
        "n_calls", fx.hit_rate(F.col("prev_cache"), F.col("prev_input")).alias("hit_before"), fx.hit_rate(F.col("cache_read"), F.col("input")).alias("hit_after"),
        F.try_divide(F.col("prev_input") + F.col("prev_cache"), F.col("n_calls")).alias("prompt_before"), F.try_divide(F.col("input") + F.col("cache_read"), F.col("n_calls")).alias("prompt_after"),
        F.greatest(F.col("prev_cache") - F.col("cache_read"), F.lit(0)).alias("cache_lost"),
    )


@query
def impact_by_session(spark, d):
    """Per session: context calls and the mean change of the hit rate, of changes in tenths of a percent."""
    e = _impact_events(spark, d)
    tenths = F.bround((fx.hit_rate(F.col("cache_read"), F.col("input")) - fx.hit_rate(F.col("prev_cache"), F.col("prev_input"))) * 10).cast("bigint")
    return e.groupBy("session_id").agg(F.sum("k").alias("n_calls"), (F.sum(F.col("k") * tenths) / F.sum("k") / 10).alias("mean_change"))


_EV = f"""{_CST}, ev as (select * from (select session_id, lag(n0 + n1) over w as k, lag(input) over w as pi, lag(cache_read) over w as pc, input, cache_read from cs window w as (partition by session_id order by t, id)) where k > 0)"""
_sql(
    "impact_total",
    f"""{_EV}, t as (select coalesce(sum(k), 0)::bigint as n_calls, coalesce(sum(k * input), 0)::bigint as i, coalesce(sum(k * cache_read), 0)::bigint as c, coalesce(sum(k * pi), 0)::bigint as pi, coalesce(sum(k * pc), 0)::bigint as pc from ev)
select n_calls, coalesce(pc * 100.0::double / nullif(pc + pi, 0), 0) as hit_before, coalesce(c * 100.0::double / nullif(c + i, 0), 0) as hit_after, (pi + pc) / nullif(n_calls, 0) as prompt_before, (i + c) / nullif(n_calls, 0) as prompt_after, greatest(pc - c, 0) as cache_lost from t""",
)
_sql(
    "impact_by_session",
    f"""{_EV}, dl as (select session_id, k, round_even((coalesce(cache_read * 100.0::double / nullif(cache_read + input, 0), 0) - coalesce(pc * 100.0::double / nullif(pc + pi, 0), 0)) * 10, 0)::bigint as x from ev)
select session_id, sum(k)::bigint as n_calls, sum(k * x)::bigint / sum(k)::bigint / 10 as mean_change from dl group by 1""",
)


@query
def recovery_by_distance(spark, d):
    """Cache hit rate by the number of answers since the last context tool (first answer after is 0)."""
    s = _context_steps(spark, d)
    s = scan(s, ["session_id"], "day", ["t", "id"], {"rn": ("row_number", "")})
    s = scan(s, ["session_id"], "day", ["t", "id"], {"last_rn": ("last_before", F.when(F.col("n0") + F.col("n1") > 0, F.col("rn")))})
    hit = fx.hit_rate(F.col("cache_read"), F.col("input"))
    s = s.where(F.col("last_rn").isNotNull()).select((F.col("rn") - F.col("last_rn") - 1).cast("bigint").alias("distance"), hit.alias("hit"), "cache_read", "input")
    return s.groupBy("distance").agg(F.count("*").alias("n"), F.min("hit").alias("min_hit"), F.max("hit").alias("max_hit"), fx.hit_rate(F.sum("cache_read"), F.sum("input")).alias("pooled_hit")).where("distance < 15")


_sql(
    "recovery_by_distance",
    f"""{_CST}, r as (select *, row_number() over (partition by session_id order by t, id) as rn from cs),
l as (select *, last_value(case when n0 + n1 > 0 then rn end ignore nulls) over (partition by session_id order by rn rows between unbounded preceding and 1 preceding) as last_rn from r),
h as (select rn - last_rn - 1 as distance, coalesce(cache_read * 100.0::double / nullif(cache_read + input, 0), 0) as hit, cache_read, input from l where last_rn is not null)
select distance, count(*) as n, min(hit) as min_hit, max(hit) as max_hit, coalesce(sum(cache_read)::bigint * 100.0::double / nullif(sum(cache_read)::bigint + sum(input)::bigint, 0), 0) as pooled_hit
from h where distance < 15 group by 1""",
)

# ---- tool calls --------------------------------------------------------------------------------


def signed_calls(spark, d) -> DataFrame:
    return views.calls(spark, d, sig=F.md5(fx.signature(F.col("tool"), F.col("parameters"))))


def superseded_calls(calls: DataFrame, protected: list[str] = PROTECTED) -> DataFrame:
    """Calls with a later call of the same signature in their session; protected tools are kept.

    The latest call of a group is found by aggregation, so a group of any size shrinks to one row per
    task before the shuffle. ``calls`` holds ``sig``, 128 bits of the signature (:func:`signed_calls`).
    """
    own = calls.where(~fx.tool_name_protected(F.col("tool"), protected))
    last = own.groupBy("session_id", "sig").agg(F.max(F.struct("seen_at", "call_id")).alias("last"))
    return own.join(last, ["session_id", "sig"]).where(F.col("call_id") != F.col("last.call_id"))


@query
def dedup_latest(spark, d):
    """Calls pruned because a later one in the session repeats them."""
    return superseded_calls(signed_calls(spark, d)).select("session_id", "call_id", "tool", "token_count")


_DEDUP = """, sig as (
  select c.call_id, list(t.fullkey || '|' || t.type || '|' || coalesce(t.atom::varchar, '') order by t.fullkey)::varchar as sig
  from (select call_id, parameters from c where json_valid(parameters)) c, json_tree(c.parameters) t
  where not (t.type = 'NULL' and t.parent = 0 and t.id > 0) group by 1),
cs as (select c.*, coalesce(sig.sig, parameters, '') as sig from c left join sig using (call_id) where tool not in ('task', 'todowrite')),
dd as (select *, row_number() over (partition by session_id, tool, sig order by seen_at desc, call_id desc) as rn from cs)"""
_sql("dedup_latest", f"{_DEDUP} select session_id, call_id, tool, token_count from dd where rn > 1")


@query
def purge_errors(spark, d):
    """Failed calls that are at least four turns old."""
    c = views.calls(spark, d).select("session_id", "call_id", "tool", "status", "turn", "token_count")
    now = c.groupBy("session_id").agg(F.max("turn").alias("now"))
    out = c.where((F.col("status") == "error") & ~fx.tool_name_protected(F.col("tool"), PROTECTED)).join(now, "session_id")
    return out.where(F.col("now") - F.col("turn") >= STALE_TURNS).select("session_id", "call_id", (F.col("now") - F.col("turn")).alias("age"), "token_count")


_sql(
    "purge_errors",
    "select session_id, call_id, now - turn as age, token_count from c join (select session_id, max(turn) as now from c group by 1) using (session_id) where status = 'error' and tool not in ('task', 'todowrite') and now - turn >= 4",
)


@query
def turn_protected(spark, d):
    """Per session: calls and tokens protected because they are less than four turns old."""
    c = views.calls(spark, d).select("session_id", "turn", "token_count")
    now = c.groupBy("session_id").agg(F.max("turn").alias("now"))
    return c.join(now, "session_id").where(F.col("now") - F.col("turn") < STALE_TURNS).groupBy("session_id").agg(F.count("*").alias("n_calls"), F.sum("token_count").alias("tokens"))


_sql("turn_protected", "select session_id, count(*) as n_calls, sum(token_count)::bigint as tokens from c join (select session_id, max(turn) as now from c group by 1) using (session_id) where now - turn < 4 group by 1")


@query
def sweep_last_n(spark, d):
    """The last five calls of each session, sliced before protected tools are left out."""
    c = views.calls(spark, d).select("session_id", "call_id", "tool", "seen_at", "token_count")
    w = Window.partitionBy("session_id").orderBy(F.desc("seen_at"), F.desc("call_id"))  # row_number <= n is cut down before the shuffle
    top = c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SWEEP_CALLS)
    return top.where(~fx.tool_name_protected(F.col("tool"), PROTECTED)).select("session_id", "call_id", "token_count")


_sql(
    "sweep_last_n",
    "select session_id, call_id, token_count from (select *, row_number() over (partition by session_id order by seen_at desc, call_id desc) as rn from c) where rn <= 5 and tool not in ('task', 'todowrite')",
)


@query
def sweep_since_user(spark, d):
    """Tool parts of messages after the last user message of their session."""
    m = views.messages(spark, d).select("session_id", "id", "seq", "role")
    last = m.where(F.col("role") == "user").groupBy("session_id").agg(F.max("seq").alias("last_user"))
    after = m.join(last, "session_id", "left").where(F.col("seq") > F.coalesce("last_user", F.lit(-1))).select(F.col("id").alias("message_id"), F.col("session_id").alias("sid"))
    p = views.parts(spark, d, "type", "call_id", "tool").where((F.col("type") == "tool") & F.col("call_id").isNotNull() & F.col("tool").isNotNull())
    return p.join(after, "message_id").select(F.col("sid").alias("session_id"), "message_id", "call_id")


_sql(
    "sweep_since_user",
    """select m.session_id, p.message_id, p.call_id from p join m on m.id = p.message_id left join (select session_id, max(seq) as lu from m where role = 'user' group by 1) l on l.session_id = m.session_id
where p.type = 'tool' and p.call_id is not null and p.tool is not null and m.seq > coalesce(lu, -1)""",
)


@query
def tool_errors(spark, d):
    """Calls, failures and tokens per tool and status."""
    return views.calls(spark, d).groupBy("tool", "status").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.max("turn").alias("last_turn"))


_sql("tool_errors", "select tool, status, count(*) as n, sum(token_count)::bigint as tokens, max(turn) as last_turn from c group by all")


@query
def prune_outputs(spark, d):
    """Completed outputs replaced because their call is pruned; edits and writes are exempt."""
    pruned = superseded_calls(signed_calls(spark, d)).select("call_id")
    p = views.parts(spark, d, "type", "status", "tool", "call_id", n_removed=F.length("output")).where((F.col("type") == "tool") & (F.col("status") == "completed") & ~F.lower(F.trim("tool")).isin("edit", "write", "question"))
    return p.join(pruned, "call_id", "left_semi").select("id", "call_id", F.lit("[output removed]").alias("output"), "n_removed")


_sql(
    "prune_outputs",
    f"""{_DEDUP} select id, call_id, '[output removed]' as output, length(p.output) as n_removed from p where type = 'tool' and status = 'completed' and lower(trim(tool)) not in ('edit', 'write', 'question')
 and call_id in (select call_id from dd where rn > 1)""",
)


@query
def prune_errors(spark, d):
    """Top-level text members of the inputs of purged failed calls, which are replaced."""
    gone = QUERIES["purge_errors"](spark, d).select("call_id")
    c = views.calls(spark, d, "parameters").select("call_id", F.from_json("parameters", "map<string,variant>").alias("m"), F.try_parse_json("parameters").alias("v"))
    kept = F.map_filter("m", lambda k, v: F.schema_of_variant(v) == "STRING")
    return c.join(gone, "call_id", "left_semi").where(F.col("v").isNotNull()).select("call_id", F.size(kept).cast("bigint").alias("n_replaced"), F.size("m").cast("bigint").alias("n_members"))


_sql(
    "prune_errors",
    """, g as (select call_id, parameters from c join (select session_id, max(turn) as now from c group by 1) using (session_id)
  where status = 'error' and tool not in ('task', 'todowrite') and now - turn >= 4 and json_valid(parameters))
select call_id, (select count(*) from json_each(parameters) e where e.type = 'VARCHAR')::bigint as n_replaced, (select count(*) from json_each(parameters))::bigint as n_members from g""",
)


@query
def call_durations(spark, d):
    """Calls first seen pending or running and later finished: time between the two, never negative."""
    src = views.load(spark, d, "tool_calls").where(F.col("call_id").isNotNull())
    began = F.min(F.when(F.col("status").isin("pending", "running"), F.col("synced_at")))
    ended = F.min(F.when(F.col("status").isin("completed", "error"), F.col("synced_at")))
    ms = F.expr("timestampdiff(MILLISECOND, began, ended)")
    return src.groupBy("session_id", "call_id").agg(began.alias("began"), ended.alias("ended")).where("began is not null and ended is not null").select("session_id", "call_id", F.greatest(ms, F.lit(0)).alias("duration_ms"))


_sql(
    "call_durations",
    """select session_id, call_id, greatest(date_diff('millisecond', began, ended), 0) as duration_ms from (
  select session_id, call_id, min(synced_at) filter (where status in ('pending', 'running')) as began, min(synced_at) filter (where status in ('completed', 'error')) as ended
  from tool_calls where call_id is not null group by all) where began is not null and ended is not null""",
)
