"""Message rows to ordered conversations and reply trees.

Channels interleave: rows of one session may belong to several exchanges. Every content message is
scored against every earlier message of its session:

    score = turn (0.25 if the role changes) + time (1 for the same moment, falling with the logarithm
    of the minutes between) + direct (0.5 for the answer to the prompt directly before) + mention (1 if
    the speaker is named) + overlap (the inverse document frequency, within the session and scaled to
    0..1, of the rarest word that both share)

The best one is its parent; a user's message whose best score is below ``LEAST_SCORE`` begins a tree
of its own. The links form trees.

The best of all earlier messages is found exactly without scoring pairs. A message is known under
keys: none, each of its words, its speaker, speaker and word together. Under one key and one role the
nearest earlier message is the best, since only time tells them apart, so it suffices to look up the
last user's and the last assistant's message under every key of the child, and the work is linear in
the words. A session may hold a third of all rows: sessions are cut by ranges of (session, time, id),
each range is looked up on its own, and what a session's earlier ranges hold last under a key is
carried in by a window over one row per range and key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.durable import cut, drop_cut
from threadloom.operators.hierarchy import resolve_roots
from threadloom.operators.store import epoch_ms, role_name

#: Most agents and models that may speak; their names are held by every task.
MAX_NAMES = 10_000
TURN, DIRECT, MENTION = 0.25, 0.5, 1.0
#: Below this score a user's message begins a tree of its own.
LEAST_SCORE = 0.5


def _words(c: Column) -> Column:
    return F.split(F.lower(c), r"[^\p{L}\p{N}_]+")


def _phrase(words: Column) -> Column:
    """The words of a text in their order, each between blanks."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _speaker(v: Column) -> Column:
    """The agent or model that speaks, as a phrase."""
    name = F.coalesce(F.try_variant_get(v, "$.agent", "string"), F.try_variant_get(v, "$.modelID", "string"))
    return _phrase(F.filter(_words(name), lambda w: w != ""))


def speaker_names(messages: DataFrame) -> list[str]:
    """Every name that speaks in the messages, as a phrase."""
    v = F.when(F.substring(F.ltrim("data"), 1, 1) == "{", F.try_parse_json("data"))
    names = messages.select(v.alias("v")).select(_speaker(F.col("v")).alias("name"))
    rows = names.where(F.trim("name") != "").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} agents and models speak")
    return sorted(r["name"] for r in rows)


def part_content(parts: DataFrame, names: list[str]) -> DataFrame:
    """(message_id, sessions, content, words, mentions) per message named by the parts.

    content: some readable part is a tool part, or a text part that is neither ignored nor blank.
    Unreadable parts count as no content but still name their message; parts that name none are
    left out. Repeated rows change nothing. sessions: the sessions of the parts. words: hashes of the
    distinct words of three letters or more of the texts. mentions: hashes of those ``names`` (phrases)
    whose words stand in a row in a text.
    """
    v = F.try_parse_json("data")
    read = parts.where(F.col("message_id").isNotNull()).select("message_id", "session_id", v.alias("v")).select(
        "message_id",
        "session_id",
        F.try_variant_get("v", "$.type", "string").alias("type"),
        F.when(~F.coalesce(F.try_variant_get("v", "$.ignored", "boolean"), F.lit(False)), F.try_variant_get("v", "$.text", "string")).alias("text"),
    )
    spoken = (F.col("type") == "text") & F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    split = read.select("message_id", "session_id", F.coalesce((F.col("type") == "tool") | spoken, F.lit(False)).alias("content"), F.when(spoken, _words(F.col("text"))).alias("w"))
    known = F.array(*map(F.lit, names)).cast("array<string>")
    hashes = F.transform(F.filter(F.array_distinct("w"), lambda w: F.length(w) > 2), lambda w: F.xxhash64(w))
    named = F.flatten(F.transform(F.array(_phrase(F.col("w"))), lambda t: F.transform(F.filter(known, lambda n: F.contains(t, n)), lambda n: F.xxhash64(n))))
    return (
        split.select("message_id", "session_id", "content", hashes.alias("words"), named.alias("mentions"))
        .groupBy("message_id")
        .agg(F.collect_set("session_id").alias("sessions"), F.max("content").alias("content"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("words", "mentions")])
    )


def message_heads(messages: DataFrame) -> DataFrame:
    """(id, session_id, t, role, removed, name) per message id.

    Of several rows the one with the greatest synced_at counts; removed if any row says so. role is
    null where data is no readable JSON object with a known role. t is in milliseconds; a missing
    time counts as 0. name: hash of the agent or model that speaks.
    """
    v = F.when(F.substring(F.ltrim("data"), 1, 1) == "{", F.try_parse_json("data"))
    own = messages.where(F.col("id").isNotNull()).select("id", "session_id", "time_created", "synced_at", F.col("removed_at").isNotNull().alias("removed"), v.alias("v"))
    one = own.select(
        "id",
        "removed",
        F.struct(
            "synced_at",
            "session_id",
            F.coalesce(epoch_ms("time_created"), F.lit(0)).alias("t"),
            role_name(F.try_variant_get("v", "$.role", "string")).alias("role"),
            F.xxhash64(_speaker(F.col("v"))).alias("name"),
        ).alias("m"),
    )
    return one.groupBy("id").agg(F.max("removed").alias("removed"), F.max("m").alias("m")).select("id", "removed", "m.session_id", "m.t", "m.role", "m.name")


def joined(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages with their content; parts whose message has no row keep a null id and, in
    ``part_sessions``, the sessions they stand in."""
    heads = message_heads(messages)
    content = part_content(parts, speaker_names(messages))
    return heads.join(content, F.col("id") == F.col("message_id"), "full").select(
        "id",
        "session_id",
        F.when(F.col("id").isNull(), F.col("sessions")).alias("part_sessions"),
        F.coalesce("removed", F.lit(False)).alias("removed"),
        "t",
        "role",
        "name",
        F.coalesce("content", F.lit(False)).alias("content"),
        *[F.coalesce(n, F.array().cast("array<bigint>")).alias(n) for n in ("words", "mentions")],
    )


_CARRY = "key bigint, df bigint, prior bigint, u struct<seq:bigint,t:bigint,id:string>, a struct<seq:bigint,t:bigint,id:string>"
_LINK = "session_id string, bucket bigint, seq bigint, id string, t bigint, role string, direct boolean, parent_id string, parent_seq bigint, parent_role string, score double"


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows by ranges of (session, t, id), one file a range; ``at`` is bucket * 2**33 and the place in it."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["session_id", "t", "id"]
    return cut(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("bucket", F.shiftright("at", 33))


def _carried(ordered: DataFrame) -> DataFrame:
    """Of sessions that lie in several ranges: per range and key that its messages ask for, the last
    user's and assistant's message under the key in earlier ranges (u, a), the number of messages under
    it there (prior) and in the whole session (df). Key 0 is every message."""
    spans = ordered.groupBy("session_id", "bucket").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    session = Window.partitionBy("session_id")
    several = (
        spans.withColumn("buckets", F.count("*").over(session))
        .where("buckets > 1")
        .withColumn("before", F.coalesce(F.sum("n").over(session.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("session_id", "bucket", "first", "before")
    )  # each border between two ranges cuts one session: at most two rows a range
    rows = ordered.join(F.broadcast(several), ["session_id", "bucket"]).withColumn("seq", F.col("at") - F.col("first") + F.col("before"))
    called = rows.select("session_id", F.explode("mentions").alias("name")).distinct().withColumn("called", F.lit(True))
    rows = rows.join(called, ["session_id", "name"], "left")
    both = lambda name: F.transform("words", lambda w: w.bitwiseXOR(name))
    nothing, none = F.array(F.lit(0).cast("bigint")), F.array().cast("array<bigint>")
    own = F.when(F.col("called"), F.concat(F.array("name"), both(F.col("name")))).otherwise(none)
    asked = F.concat(nothing, "words", "mentions", F.flatten(F.transform("mentions", both)))
    message = F.struct("seq", "t", "id")
    posts = rows.select("session_id", "bucket", F.explode(F.concat(nothing, F.col("words"), own)).alias("key"), F.lit(1).alias("posted"), F.when(F.col("role") == "user", message).alias("u"), F.when(F.col("role") != "user", message).alias("a"))
    asks = rows.select("session_id", "bucket", F.explode(asked).alias("key"), F.lit(0).alias("posted"), F.lit(None).cast(posts.schema["u"].dataType).alias("u"), F.lit(None).cast(posts.schema["a"].dataType).alias("a"))
    per = posts.unionByName(asks).groupBy("session_id", "bucket", "key").agg(F.sum("posted").alias("n"), F.min("posted").alias("least"), F.max("u").alias("u"), F.max("a").alias("a"))
    whole = Window.partitionBy("session_id", "key")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = per.select(
        "session_id", "bucket", "key", "least", F.sum("n").over(whole).alias("df"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("prior"),
        *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in ("u", "a")],
    )
    return held.where("least = 0").drop("least")


def _group_starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        session, bucket = table.column("session_id").to_numpy(), table.column("bucket").to_numpy()
        new[1:] = (session[1:] != session[:-1]) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(new)


def _best_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likeliest parent of each message; rows come in order of session, range, kind (what is
    carried first) and place, and a group may run over several batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held:  # a batch that only goes on with the group in hand is put by
            tail, first = held[-1], table.slice(0, 1)
            ends = pa.concat_tables([tail.slice(tail.num_rows - 1), table.slice(table.num_rows - 1)])
            if len(_group_starts(ends)) == 1:
                held.append(table)
                continue
            table = pa.concat_tables([*held, table]).combine_chunks()
        starts = _group_starts(table)
        if starts[-1]:
            yield _score(table.slice(0, starts[-1]), starts[:-1])
        held = [table.slice(starts[-1])]
    if held:
        yield _score(pa.concat_tables(held), np.zeros(1, np.int64))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _score(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    table = table.combine_chunks()
    group_of = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
    is_message = table.column("is_message").to_numpy()
    at = np.flatnonzero(is_message)
    own, carry = table.take(pa.array(at)), table.filter(pa.array(~is_message)).combine_chunks()
    g, cg = group_of[at], group_of[~is_message]
    m = len(at)
    who = np.arange(m)
    role = own.column("role").to_numpy() == "user"
    t, name = own.column("t").to_numpy(), own.column("name").to_numpy()
    key, df, prior = (carry.column(c).to_numpy() for c in ("key", "df", "prior"))
    before, total = np.zeros(len(starts), np.int64), np.bincount(g, minlength=len(starts))
    split = np.zeros(len(starts), bool)
    every = key == 0
    before[cg[every]], total[cg[every]], split[cg[every]] = prior[every], df[every], True
    seq = who - np.searchsorted(g, g) + before[g]

    words, n_words = _lists(own.column("words").combine_chunks())
    mentions, n_mentions = _lists(own.column("mentions").combine_chunks())
    word_of, mention_of = np.repeat(who, n_words), np.repeat(who, n_mentions)
    called = (name != 0) & np.isin(name, mentions)
    # posts and asks as (key, message); a word counts for df through its own post
    w_called = called[word_of]
    post_key = np.concatenate([np.zeros(m, np.int64), words, name[called], words[w_called] ^ name[word_of[w_called]]])
    post_of = np.concatenate([who, word_of, who[called], word_of[w_called]])
    first_word = np.cumsum(n_words) - n_words
    reps = n_words[mention_of]
    pair_word = np.repeat(first_word[mention_of] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    pair_name = np.repeat(mentions, reps)
    ask_key = np.concatenate([np.zeros(m, np.int64), words, mentions, words[pair_word] ^ pair_name])
    ask_of = np.concatenate([who, word_of, mention_of, word_of[pair_word]])

    def mixed(k: np.ndarray, group: np.ndarray) -> np.ndarray:
        return k.astype(np.uint64) ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    p, a = len(post_key), len(ask_key)
    _, number = np.unique(np.concatenate([mixed(post_key, g[post_of]), mixed(ask_key, g[ask_of]), mixed(key, cg)]), return_inverse=True)
    post_no, ask_no, carry_no = number[:p], number[p : p + a], number[p + a :]
    count = np.bincount(post_no, minlength=number.max(initial=0) + 1)
    count[carry_no] = df
    share = np.log((total[g[word_of]] + 1) / count[ask_no[m : m + len(words)]]) / np.log(total[g[word_of]] + 1)
    weight = np.concatenate([np.zeros(m), share, np.full(len(mentions), MENTION), MENTION + share[pair_word]])

    best: list[np.ndarray] = []
    for is_user, held in ((True, "u"), (False, "a")):
        mine = np.flatnonzero(role[post_of] == is_user)
        last = carry.column(held).combine_chunks()
        there = np.flatnonzero(last.is_valid().to_numpy(zero_copy_only=False))
        last = last.take(pa.array(there))
        last_seq, last_t = (last.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        place = np.concatenate([post_no[mine] * (m + 1) + post_of[mine] + 1, carry_no[there] * (m + 1)])
        order = np.argsort(place, kind="stable")
        place = np.concatenate([place[order], [-1]])  # ends with what no search finds
        found = np.searchsorted(place[:-1], ask_no * (m + 1) + ask_of + 1) - 1
        ok = np.flatnonzero((found >= 0) & (place[found] // (m + 1) == ask_no))
        at_post, child = order[found[ok]], ask_of[ok]
        p_seq = np.concatenate([seq[post_of[mine]], last_seq])[at_post]
        p_t = np.concatenate([t[post_of[mine]], last_t])[at_post]
        source = np.concatenate([post_of[mine], -1 - there])[at_post]
        s = weight[ok] + np.where(role[child] != is_user, TURN, 0.0) + 1.0 / (1.0 + np.log1p(np.maximum((t[child] - p_t) / 60_000.0, 0.0)))
        if is_user:
            s += np.where(~role[child] & (p_seq == seq[child] - 1), DIRECT, 0.0)
        best.append(np.stack([child, s, p_seq, source, np.full(len(child), is_user)]))
    child, s, p_seq, source, is_user = np.concatenate(best, axis=1)
    order = np.lexsort((p_seq, s, child))
    ends = order[np.flatnonzero(np.r_[child[order][1:] != child[order][:-1], len(order) > 0])] if len(order) else order
    ends = ends[(s[ends] >= LEAST_SCORE) | ~role[child[ends].astype(np.int64)]]
    parent_id, parent_seq, parent_role, score = [None] * m, np.zeros(m, np.int64), [None] * m, np.zeros(m)
    linked = np.zeros(m, bool)
    rows = child[ends].astype(np.int64)
    linked[rows], parent_seq[rows], score[rows] = True, p_seq[ends].astype(np.int64), s[ends]
    ids = own.column("id").to_pylist()
    for c, src, u in zip(rows.tolist(), source[ends].astype(np.int64).tolist(), is_user[ends].tolist()):
        parent_id[c] = ids[src] if src >= 0 else carry.column("u" if u else "a")[-1 - src].as_py()["id"]
        parent_role[c] = "user" if u else "assistant"
    # the message directly before: in the group, or the later one of the two carried under key 0
    direct = np.zeros(m, bool)
    direct[1:] = role[:-1] & (g[1:] == g[:-1])
    first_of = dict(zip(g[::-1].tolist(), who[::-1].tolist()))
    for k in np.flatnonzero(every).tolist():
        u, b = carry.column("u")[k].as_py(), carry.column("a")[k].as_py()
        if u and int(cg[k]) in first_of:
            direct[first_of[int(cg[k])]] = b is None or u["seq"] > b["seq"]
    direct &= ~role
    none = pa.array(~linked)
    return pa.RecordBatch.from_arrays(
        [
            own.column("session_id").combine_chunks(), own.column("bucket").combine_chunks(), pa.array(seq), own.column("id").combine_chunks(), own.column("t").combine_chunks(), own.column("role").combine_chunks(), pa.array(direct),
            pa.array(parent_id, pa.string()), pa.array(parent_seq, mask=~linked), pa.array(parent_role, pa.string()), pa.array(score, mask=~linked),
        ],
        names=[x.split()[0] for x in _LINK.split(", ")],
    )


def reply_links(rows: DataFrame) -> DataFrame:
    """Content messages in order with their likeliest parent.

    ``rows``: id, session_id, t, role, name, words, mentions (one row per message; without words
    nothing overlaps, without mentions nobody is named). Result: session_id, bucket (rises with seq),
    seq (from 0 by t and then id within the session), id, t, role, direct (an assistant's message after
    a user's), parent_id, parent_seq, parent_role and score; the parent is the best of all messages
    before it in the session, null where there is none or, for a user's, none scores enough. Ties go to
    the nearer message.
    """
    rows = rows.withColumns({n: F.array().cast("array<bigint>") for n in ("words", "mentions") if n not in rows.columns})
    ordered = _ordered(rows.select("session_id", "id", "t", "role", F.coalesce("name", F.lit(0).cast("bigint")).alias("name"), "words", "mentions"))
    fields = [(c.name, c.dataType) for c in ordered.schema]
    carried = _carried(ordered)
    extra = [(c, carried.schema[c].dataType) for c in ("key", "df", "prior", "u", "a")]
    both = ordered.withColumns({c: F.lit(None).cast(k) for c, k in extra}).unionByName(carried.withColumns({c: F.lit(None).cast(k) for c, k in fields if c not in carried.columns}))
    both = both.withColumn("is_message", F.col("id").isNotNull())
    keys = ["session_id", "bucket"]
    links = cut(both.repartition(*keys).sortWithinPartitions(*keys, "is_message", "at").mapInArrow(_best_parents, _LINK), "links")
    drop_cut(ordered)
    return links


def content_rows(all_rows: DataFrame) -> DataFrame:
    """The messages of ``joined`` that exist, stand in a session, have content and a known role."""
    return all_rows.where(F.col("id").isNotNull() & F.col("session_id").isNotNull() & ~F.col("removed") & F.col("content") & F.col("role").isNotNull())


def broken_sessions(all_rows: DataFrame) -> DataFrame:
    """Sessions with a message of unreadable data or unknown role, or a part without its message."""
    bad = F.when(F.col("id").isNull(), F.col("part_sessions")).when(~F.col("removed") & F.col("role").isNull(), F.array("session_id"))
    return all_rows.select(F.explode(bad).alias("session_id")).where(F.col("session_id").isNotNull()).distinct()


def conversations(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages of the kept sessions, in order, with their reply links.

    From the links: in a kept session every assistant's message has a parent, so that all trees begin
    with a user. From the definition of a kept session, checked exactly on the ordered rows: it is not
    broken, its first content message is a user's and an assistant's message stands directly after each
    user's. Messages without a session id belong to no conversation. Empty inputs give an empty result.
    """
    every = cut(joined(messages, parts), "joined")
    links = reply_links(content_rows(every))
    user = F.col("role") == "user"
    good = (
        links.groupBy("session_id")
        .agg(
            F.count_if(user).alias("asked"),
            F.count_if("direct").alias("answered"),
            F.count_if(~user & F.col("parent_id").isNull()).alias("loose"),
            F.count_if((F.col("seq") == 0) & user).alias("opened"),
        )
        .where((F.col("asked") == F.col("answered")) & (F.col("loose") == 0) & (F.col("opened") == 1))
        .select("session_id")
        .join(cut(broken_sessions(every), "broken"), "session_id", "left_anti")
    )
    drop_cut(every)
    return links.join(good, "session_id", "left_semi")


def reply_trees(links: DataFrame) -> DataFrame:
    """Adds tree_id, the first message of the link tree that a message belongs to.

    Runs of messages that each answer the one directly before are contracted first, so that the
    pointer doubling that finds the roots works on run heads only.
    """
    head = F.when(F.col("parent_seq").isNull() | (F.col("parent_seq") != F.col("seq") - 1), F.col("seq"))
    rows = links.withColumn("head", head)
    per_day = rows.groupBy("session_id", "bucket").agg(F.max("head").alias("last_head"))
    earlier = F.max("last_head").over(Window.partitionBy("session_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per_day = per_day.withColumn("before", earlier).drop("last_head")
    so_far = F.max("head").over(Window.partitionBy("session_id", "bucket").orderBy("seq"))
    runs = cut(
        rows.withColumn("so_far", so_far).join(per_day, ["session_id", "bucket"]).withColumn("run", F.coalesce("so_far", "before")).drop("so_far", "before"),
        "runs",
    )
    key = lambda s, r: F.concat_ws("\n", s, r.cast("string"))
    member = runs.select(F.col("session_id").alias("m_session"), F.col("seq").alias("m_seq"), F.col("run").alias("m_run"))
    heads = runs.where(F.col("head").isNotNull()).join(
        member, (F.col("session_id") == F.col("m_session")) & (F.col("parent_seq") == F.col("m_seq")), "left"
    )
    tree = resolve_roots(heads.select(key(F.col("session_id"), F.col("head")).alias("node"), F.when(F.col("m_run").isNotNull(), key(F.col("session_id"), F.col("m_run"))).alias("parent")))
    roots = tree.select(F.col("node").alias("run_key"), F.substring_index("root", "\n", -1).cast("bigint").alias("root_seq"))
    named = runs.withColumn("run_key", key(F.col("session_id"), F.col("run"))).join(roots, "run_key")
    return named.withColumn("tree_id", F.concat_ws("#", "session_id", F.col("root_seq").cast("string"))).drop("run_key", "head", "run", "bucket")
