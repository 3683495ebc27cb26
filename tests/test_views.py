import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from threadloom.operators import blocks as bx

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["token_stats", "purge_errors", "step_timeline", "tool_errors", "message_tokens", "dedup_latest", "impact_by_tool", "context_breakdown", "last_user_asof"])
def test_no_body_is_shuffled(spark, name):
    """No exchange or aggregation carries the data of a message or part or the parameters of a call."""
    plan = entry.queries()[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if re.search(r"\bAggregate\b", line):
            assert not re.search(r"\b(?:data|parameters|text)#", line), line


def test_boundaries_of_messages_and_blocks(spark):
    rows = [("s", 1, "a1", "m0001", "m0002"), ("s", 12, "a2", "b1", "m0002"), ("s", 3, "a3", "B12 ", "b1"), ("s", 4, "gone", "x", "m0001"), ("s", 5, "a1", "b4", "m0002"), ("s", 6, "a1", "b99", "m0009"), ("s", 7, "a1", "m0012", "m0012")]
    blocks = spark.createDataFrame(rows, "session_id string, block_id long, anchor_message_id string, start_id string, end_id string")
    live = spark.createDataFrame([("s", "a1", 0), ("s", "a2", 5), ("s", "a3", 7)], "session_id string, id string, seq long")
    refs = spark.createDataFrame([("s", "a1", 1), ("s", "a3", 2), ("s", "lost", 9)], "session_id string, id string, n long")
    got = {r["block_id"]: (r["problem"], r["s_seq"], r["e_seq"]) for r in bx.resolve_boundaries(blocks, refs, live).collect()}
    assert got == {1: ("ok", 0, 7), 12: ("ok", 0, 7), 3: ("reversed", 5, 0), 4: ("invalid", None, 0), 5: ("gone", None, 7), 6: ("unknown", None, None), 7: ("unknown", None, None)}
    assert bx.resolve_boundaries(blocks.limit(0), refs, live).count() == 0
