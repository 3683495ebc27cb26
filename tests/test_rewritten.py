import json
import sys
from datetime import datetime as dt
from pathlib import Path

import pytest

import __spark_entry__ as entry
from threadloom.plans import context

sys.path.insert(0, str(Path(__file__).parent))
import test_entry  # noqa: E402

NOW = dt(2025, 1, 1)
CALLS = "session_id string, call_id string, tool string, parameters string, status string, error string, turn long, token_count long, synced_at timestamp_ntz"
PARTS = "id string, message_id string, session_id string, time_created long, data string, synced_at timestamp_ntz"


@pytest.mark.skipif(not test_entry.DATA.exists(), reason="no test tables")
def test_range_texts_equal_sql(spark):
    test_entry.test_query_equals_sql(spark, "range_texts")


@pytest.mark.skipif(not test_entry.DATA.exists(), reason="no test tables")
def test_priority_ref_lists(spark):
    d = str(test_entry.DATA)
    seq = {(r["session_id"], r["id"]): r for r in entry.queries()["message_tokens"](spark, d).collect()}
    role = {(r["session_id"], r["id"]): r["role"] for r in context.views.messages(spark, d).collect()}
    refs = {(r["session_id"], r["id"]): r["ref"] for r in entry.queries()["message_refs"](spark, d).collect()}
    want = {}
    for k, m in sorted(seq.items(), key=lambda x: x[1]["seq"]):
        anchor = max((seq[o]["seq"] for o in seq if o[0] == k[0] and role[o] == "user"), default=-1)
        if m["seq"] < anchor and refs.get(k):
            want.setdefault((k[0], m["priority"]), []).append(refs[k])
    got = {(r["session_id"], r["priority"]): r["refs"] for r in entry.queries()["priority_ref_lists"](spark, d).collect()}
    assert want and got == want


def test_inputs_and_outputs(spark, tmp_path):
    given = {"a": {"cmd": "x", "n": 1, "o": {"s": "kept"}, "l": ["kept"]}, "b": ["x", 2], "new": {"cmd": "x"}}
    rows = [("s", k, "bash", json.dumps(v), "error", "e", 9 if k == "new" else 1, 1, NOW) for k, v in given.items()]
    spark.createDataFrame(rows, CALLS).write.parquet(f"{tmp_path}/tool_calls.parquet")
    got = {r["call_id"]: json.loads(r["parameters"]) for r in context.prune_error_inputs(spark, str(tmp_path)).collect()}
    gone = context.INPUT_REMOVED
    assert got == {"a": {"cmd": gone, "n": 1, "o": {"s": "kept"}, "l": ["kept"]}, "b": [gone, 2]}
    parts = [(s, "m", "s", 1, json.dumps({"type": "tool", "state": {"status": s, "output": "done\nm0001 "}}), NOW) for s in ("completed", "running")]
    spark.createDataFrame(parts, PARTS).write.parquet(f"{tmp_path}/parts.parquet")
    assert [tuple(r) for r in context.clean_outputs(spark, str(tmp_path)).collect()] == [("completed", "done")]
