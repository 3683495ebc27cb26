import json
from datetime import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql.functions import countDistinct

from threadloom.operators import shredding as s
from threadloom.plans import general

SCHEMA = "record_id long, exported_at timestamp_ntz, payload string, node_id string"


def paths(spark, *payloads):
    df = spark.createDataFrame([(i, dt(2025, 1, 1 + i), p, "x") for i, p in enumerate(payloads)], SCHEMA)
    return sorted((r["message_id"], r["json_path"]) for r in s.list_objects(s.shred(s.counting_records(df))).collect())


def record(parts, mid="m"):
    return json.dumps({"parts": parts, "info": {"id": mid}})


def test_paths_and_bare_objects(spark):
    got = paths(spark, record({"state": {"input": {"questions": {"options": [{"a": 1}, 2]}, "x": {"y": [[{"z": []}]]}}}}))
    assert [p for _, p in got] == ["parts[0]", "parts[0].state.input.questions[0]", "parts[0].state.input.questions[0].options[0]", "parts[0].state.input.x.y[0][0]"]


def test_string_input(spark):
    got = paths(spark, record([{"state": {"input": json.dumps({"todos": {"id": "1"}})}}, {"state": {"input": "no json"}}]))
    assert [p for _, p in got] == ["parts[0]", "parts[0].state.input.todos[0]", "parts[1]"]


def test_counting_record(spark):
    assert paths(spark, record([{}, {}]), record([{}]), '{"info":{"id":"m"},"parts":[{}', "", None, "[]", '{"info":{}}', '{"info":{"id":" "}}') == [("m", "parts[0]")]
    assert paths(spark, record(None, "q"), record([], "r"), '{"info":{"id":"s"}}') == []


def test_deep_and_long(spark):
    deep = "[" * 300 + '{"a":1}' + "]" * 300
    got = paths(spark, f'{{"info":{{"id":"m"}},"parts":[{{"x":{deep}}}]}}', "{" * 100_000)
    assert len(got) == 2


def test_entity_table(spark):
    df = spark.createDataFrame([(1, dt(2025, 1, 1), record([{"type": "tool", "tool": "t", "state": {"input": {"todos": [{"id": "1"}, {"id": "2", "content": None}]}}}]), "x")], SCHEMA)
    nodes = s.shred(s.counting_records(df))
    todos = s.entity_table(nodes, "parts.state.input.todos", ["id", "content"]).orderBy("ordinal").collect()
    assert [(t["f_id"], t["f_content"], t["ordinal"]) for t in todos] == [("1", None, 0), ("2", None, 1)]
    part = s.entity_table(nodes, "parts", ["type", "tool"]).collect()
    assert [(p["f_type"], p["f_tool"]) for p in part] == [("tool", "t")]
    assert s.entity_table(nodes.limit(0), "parts", ["type"]).count() == 0


def test_every_scalar_reaches_a_table(spark):
    part = {"id": "p", "state": {"time": {"start": 1}, "output": [{"n": True, "tags": ["a", {"x": None}]}, {}]}, "a.b": 2, "ID": "q"}
    df = spark.createDataFrame([(1, dt(2025, 1, 1), record([part]), "x")], SCHEMA)
    nodes = s.shred(s.counting_records(df))
    rows = {r["json_path"]: r for r in s.flat_rows(nodes).collect()}
    assert {p: r["members"] for p, r in rows.items()} == {
        "info": {"id": "m"}, "parts[0]": {"id": "p", "state.time.start": "1", '"a.b"': "2", "ID": "q"}, "parts[0].state.output[0]": {"n": "true", "tags[0]": "a"},
        "parts[0].state.output[0].tags[1]": {"x": None}, "parts[0].state.output[1]": {},
    }
    assert rows["parts[0].state.output[1]"]["owner_id"] == rows["parts[0]"]["node_id"]
    assert rows["parts[0].state.output[0].tags[1]"]["owner_id"] == rows["parts[0].state.output[0]"]["node_id"]
    wide = s.entity_table(nodes, "parts")
    assert sorted(wide.columns[5:]) == ['f_"a.b"', "f_ID", "f_id#2", "f_state.time.start"]
    assert [r["f_state.time.start"] for r in wide.collect()] == ["1"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_entities_of_the_data_have_tables(spark):
    queries = general.QUERIES
    held = queries["p3_members"](spark, "/root/testdata/sf0.01").cache()
    objects = {r["entity"]: r["n"] for r in held.groupBy("entity").agg(countDistinct("message_id", "node_id").alias("n")).collect()}
    for name, entity in [*general.ENTITIES.items(), ("p3_messages", "info")]:
        assert queries[name](spark, "/root/testdata/sf0.01").count() == objects.pop(entity)
    assert not objects
