"""The rules on tables that hold what the test data lack: compressions, ignored rows, sub-agents, questions."""

import json
from datetime import datetime as dt

import pytest

from threadloom.plans import rules

NOW = dt(2025, 1, 1)
T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("store"))
    ms, ps, calls = [], [], []

    def message(i, role, *parts, session="s", **info):
        mid = f"{session}{i}"
        ms.append((mid, session, T0 + i * 1000, json.dumps({"role": role, **info}), None, NOW))
        for k, part in enumerate(parts):
            ps.append((f"{mid}p{k}", mid, session, T0 + i * 1000 + k, json.dumps(part), NOW))

    def text(x, **more):
        return {"type": "text", "text": x, **more}

    def tool(name, call, status="completed", **state):
        return {"type": "tool", "tool": name, "callID": call, "state": {"status": status, **state}}

    tokens = {"input": 100, "output": 50, "reasoning": 0, "cache": {"read": 20, "write": 0}}
    message(0, "user", text("x" * 40))
    message(1, "assistant", {"type": "step-start"}, text("old"), tool("read", "c1", output="o" * 19), tokens=tokens)
    message(2, "user", text("hidden", ignored=True))
    message(3, "user")
    message(4, "assistant", {"type": "step-start"}, tool("compress", "c2", output="done"), tool("read", "c3", output="oo", time={"compacted": 5}))
    message(5, "user", text("first"), text("second"))
    message(6, "user", text("third"))
    message(7, "assistant", {"type": "step-start"}, tool("question", "c4", output="yes"), tool("bash", "c5", "error", error="bad thing"), tokens={**tokens, "output": 60})
    message(8, "user", text("last"))
    message(0, "user", text("prompt"), session="child")
    message(1, "assistant", text(" part one "), text("  "), tool("compress", "k1", output="x"), session="child")
    message(2, "assistant", text("part two"), session="child")
    message(3, "user", text("more"), session="child")
    message(0, "user", text("q"), session="cut")
    message(1, "assistant", text("s"), session="cut", summary=True)
    message(2, "user", text("r"), session="cut")
    for n, (c, t, p, status, turn) in enumerate([
        ("c1", "read", {"filePath": "a"}, "completed", 1), ("c3", "read", {"filePath": "b"}, "completed", 2), ("c4", "question", {"questions": [{"q": 1}]}, "completed", 3),
        ("c5", "bash", {"command": "ls", "n": 1.5, "o": {"z": 1, "a": "x"}}, "error", 1), ("c6", "read", {"filePath": "c"}, "completed", 9), ("c7", "question", {"questions": [{"q": 1}]}, "completed", 4), ("c8", "read", {"filePath": "a"}, "completed", 5),
    ]):
        calls.append(("s", c, t, json.dumps(p), status, turn, 5, dt(2025, 1, 1, 0, 0, n)))
    block = lambda i, mode, start, ids, anchor, **x: ("s", i, 7, True, False, 10, 5, 3, mode, "t", None, start, start, anchor, None, None, [], [], [], ids, [], ids, [], T0 + i, None, None, "sum", None, NOW)
    blocks = [block(1, "message", "m0001", ["s0"], "s1")] + [block(i, "message", r, [], "nowhere") for i, r in enumerate(["m0001", "BLOCKED", "b1", "zz", "m0003", "m0005 ", "m0005", "M0005", "m0099"], 2)]
    w = lambda rows, shape, name: spark.createDataFrame(rows, shape).write.mode("overwrite").parquet(f"{d}/{name}.parquet")
    w(ms, "id string, session_id string, time_created long, data string, removed_at timestamp_ntz, synced_at timestamp_ntz", "messages")
    w(ps, "id string, message_id string, session_id string, time_created long, data string, synced_at timestamp_ntz", "parts")
    w(calls, "session_id string, call_id string, tool string, parameters string, status string, turn long, token_count long, synced_at timestamp_ntz", "tool_calls")
    w(blocks, "session_id string, block_id long, run_id long, active boolean, deactivated_by_user boolean, compressed_tokens long, summary_tokens long, duration_ms long, mode string, topic string, batch_topic string, start_id string, end_id string, anchor_message_id string, compress_message_id string, compress_call_id string, included_block_ids array<long>, consumed_block_ids array<long>, parent_block_ids array<long>, direct_message_ids array<string>, direct_tool_ids array<string>, effective_message_ids array<string>, effective_tool_ids array<string>, created_at long, deactivated_at long, deactivated_by_block_id long, summary string, removed_at timestamp_ntz, synced_at timestamp_ntz", "blocks")
    w([("s", "p", None, "/d", "t", T0, T0, NOW), ("child", "p", "s", "/d", "t", T0, T0, NOW), ("cut", "p", " ", None, None, T0, T0, NOW)], "id string, project_id string, parent_id string, directory string, title string, time_created long, time_updated long, synced_at timestamp_ntz", "sessions")
    refs = {"byRef": {"m0001": "s0", "m0002": "s1", "m0003": "s2", "m0005": "s5", "m0007": "gone"}}
    w([("s", "n", None, json.dumps(refs), "2025-01-01T00:00:00Z", None, NOW), ("cut", "n", None, json.dumps({"byRef": {"m0004": "cut0"}}), "2025-01-01T00:00:00Z", None, NOW)], "session_id string, session_name string, prune_messages string, message_ids string, last_updated string, last_compaction long, synced_at timestamp_ntz", "session_states")
    return d


def table(spark, folder, name, key):
    return {r[key]: r for r in rules.QUERIES[name](spark, folder).collect()}


def test_message_rules(spark, folder):
    got = table(spark, folder, "message_rules", "id")
    assert {i for i, r in got.items() if r["ignored_user"]} == {"s2", "s3"}
    assert {i for i, r in got.items() if r["has_compress"]} == {"s4", "child1"}
    assert {i for i, r in got.items() if r["protected_user"]} == {"s0", "s5", "s6", "s8", "child0", "child3", "cut0", "cut2"}
    assert {i for i, r in got.items() if r["compacted"]} == {"s0", "cut0"}


def test_aliases(spark, folder):
    got = {i: r["ref"] for i, r in table(spark, folder, "message_aliases", "id").items()}
    # s2 keeps its saved reference though ignored, m0007 is dropped with its message; the child's prompt gets none; cut0 keeps one
    assert got == {"s0": "m0001", "s1": "m0002", "s2": "m0003", "s5": "m0005", "s4": "m0006", "s6": "m0007", "s7": "m0008", "s8": "m0009", "child1": "m0001", "child2": "m0002", "child3": "m0003", "cut0": "m0004", "cut1": "m0005", "cut2": "m0006"}
    hints = table(spark, folder, "boundary_candidates", "session_id")
    assert hints["child"]["hint"] == "m0001, m0002, m0003" and hints["s"]["n"] == 8


def test_turns_and_anchors(spark, folder):
    pairs = {(r["answer_id"], r["user_id"]) for r in rules.turn_anchor_pairs(spark, folder).collect()}
    assert pairs == {("s7", "s8"), ("child2", "child3"), ("cut1", "cut2")}
    assert {c: r["turn"] for c, r in table(spark, folder, "tool_turns", "call_id").items()} == {"c1": 1, "c2": 2, "c3": 2, "c4": 3, "c5": 3, "k1": 0}
    assert {c: r["n_turns"] for c, r in table(spark, folder, "turn_counts", "session_id").items()} == {"s": 3}
    assert table(spark, folder, "unread_since", "session_id")["s"]["last_id"] == "s8"


def test_tool_contents(spark, folder):
    got = {r["call_id"]: (r["tokens"], r["script_tokens"]) for r in rules.tool_tokens(spark, folder).collect()}
    n = lambda *sizes: int((sum(sizes) + len(sizes) - 1) / 4 + 0.5)
    assert got["c1"] == (n(17, 19), n(19)) and got["c3"] == (n(17, len(rules.CLEARED_OUTPUT)), n(len(rules.CLEARED_OUTPUT)))
    assert got["c5"] == (n(len('{"command": "ls", "n": 1.5, "o": {"z": 1, "a": "x"}}'), 9), n(9))
    assert got["c2"] == (1, 1) and got["c4"][1] == n(len('[{"q":1}]'))
    assert table(spark, folder, "all_message_tokens", "id")["s5"]["tokens"] == n(5, 6) and table(spark, folder, "token_table", "session_id")["s"]["n_empty"] == 1


def test_pruned_parts(spark, folder):
    got = {r["call_id"]: r for r in rules.pruned_parts(spark, folder).collect()}
    assert set(got) == {"c1", "c4", "c5"}  # c1 and c4 are repeated by later calls, c5 failed eight turns ago
    assert got["c1"]["output"] == rules.OUTPUT_REMOVED and got["c4"]["output"] == "yes" and got["c4"]["questions_removed"]
    assert got["c5"]["input"] == '{"command":"[input removed due to failed tool call]","n":1.5,"o":{"z":1,"a":"x"}}'


def test_context_report(spark, folder):
    r = table(spark, folder, "context_report", "session_id")["s"]
    assert (r["total"], r["system_tokens"]) == (180, 120)  # the first user's message is compacted, so its text counts nothing
    assert r["user_tokens"] == round((5 + 6 + 5 + 4 + 3) / 4 + 0.01) and r["tools"] == 5 and r["tools_in_context"] == 2 and r["pruned_tools"] == 3 and r["pruned_messages"] == 1


def test_requests(spark, folder):
    got = {r["ord"]: r["issue"] for r in rules.compress_requests(spark, folder).collect()}
    assert got == {1: "already-compressed", 2: "already-compressed", 3: "blocked", 4: "block-id", 5: "invalid-format", 6: "not-in-context", 7: None, 8: "duplicate", 9: None, 10: "not-in-context"}
    issues = [(r["issue"], r["n"], r["refs"]) for r in rules.request_issues(spark, folder).orderBy("first").collect()]
    assert issues[0] == ("already-compressed", 2, "m0001, m0001") and issues[-1][0] == "duplicate"


def test_subagents(spark, folder):
    texts = rules.subagent_texts(spark, folder)
    assert [tuple(r) for r in texts.collect()] == [("child", "s", "part one\n\npart two")]
    parts = spark.createDataFrame([("a", " child ", "pre <TASK_result>\nold\n</task_result> $1 <task_result>x</task_result>"), ("b", "child", "no tag"), ("c", None, "<task_result>x</task_result>")], "id string, child_session string, output string")
    got = {r["id"]: r["output"] for r in rules.merge_subagent_results(parts, texts).collect()}
    assert got == {"a": "pre <TASK_result>\npart one\n\npart two\n</task_result> $1 <task_result>x</task_result>", "b": "no tag", "c": "<task_result>x</task_result>"}


def test_snapshot(spark, folder):
    rows = rules.minimized_context(spark, folder).collect()
    assert {r["type"] for r in rows} <= {"text", "reasoning", "tool"} and not any(r["body"] == "hidden" or r["body"] == "x" * 40 for r in rows)
    assert [r["id"] for r in rules.session_page(spark, folder).collect()] == []


def test_limits(spark):
    usage = spark.createDataFrame([("a", "m", 84), ("b", "m", 86), ("c", "m", 86), ("d", "m", 49), ("e", "other", 5)], "session_id string, model string, used long")
    windows = spark.createDataFrame([("m", 100)], "model string, win long")
    buffers = spark.createDataFrame([("c", 3)], "session_id string, buffer long")
    got = {r["session_id"]: (r["over_min"], r["over_max"]) for r in rules.against_limits(usage, windows, buffers).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (True, False), "d": (False, False), "e": (True, False)}
