import json
import sqlite3

from threadloom.sources import sqlite, states


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as db:
        db.execute("create table message (id text, session_id text, time_created integer, data text)")
        db.executemany("insert into message values (?, ?, ?, ?)", [(f"m{i}", "s", i, None) for i in range(57)])
        db.execute("create table part (id text, session_id text, message_id text, time_created integer, data text)")
    spark.dataSource.register(sqlite.SqliteSource)
    read = lambda t: spark.read.format("sqlite").option("path", path).option("table", t).option("partitions", "5").load()
    assert sorted(r["time_created"] for r in read("message").where("id <> 'm3'").collect()) == [i for i in range(57) if i != 3]
    assert read("part").count() == 0


def test_states(spark, tmp_path):
    good = {"prune": {"tools": {"c": 5, "d": "x"}, "messages": {"blocksById": {"4": {"blockId": 4, "active": True}}, "nextBlockId": 2}}, "nudges": {"contextLimitAnchors": ["a", None, "a"]}, "stats": {"totalPruneTokens": 9}, "lastUpdated": "2025-01-01T00:00:00Z"}
    for sid, text in (("s1", json.dumps(good)), ("s2", "{"), ("s3", json.dumps({"prune": {}}))):
        (tmp_path / f"session_id={sid}").mkdir()
        (tmp_path / f"session_id={sid}" / "x.json").write_text(text)
    rows = states.read_states(spark, str(tmp_path)).collect()
    assert [(r["session_id"], r["next_block_id"], r["contextLimitAnchors"], r["total_tokens"]) for r in rows] == [("s1", 5, ["a"], 9)]
    out = tmp_path / "out"
    raw = spark.read.schema(states.SCHEMA).json(str(tmp_path / "session_id=s1")).selectExpr("* except (session_id)", "'s9' as session_id")
    states.write_states(raw, str(out))
    assert [r["session_id"] for r in states.read_states(spark, str(out)).collect()] == ["s9"]
