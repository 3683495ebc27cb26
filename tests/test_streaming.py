import json
import os
import random
import time

import pytest

from pyspark.sql import functions as F

from threadloom.streaming import durations as s

SCHEMA = "message_id string, call_id string, status string, event_ms long, start_ms long, end_ms long"


def events():
    rng = random.Random(4)
    out = [("m", "c", "pending", 100, None, None), ("m", "c", "pending", 150, None, None), ("m", "c", "running", 160, None, None), ("m", "c", "completed", 325, 1, 2), ("m", "d", "completed", 9, 5, 3), (None, "x", "completed", 1, 1, 2)]
    for i in range(60):
        out.append(("n", f"c{i % 9}", rng.choice(["pending", "running", "completed", "error"]), 1000 + i, 10, 15))
    return out


def expected(rows=None):
    groups = {}
    for r in events() if rows is None else rows:
        if r[0]:
            groups.setdefault(r[:2], []).append(r[2:])
    return sorted((m, c, x) for (m, c), rows in groups.items() for x in s.fold(None, sorted(rows, key=lambda r: (r[1], s._ORDER.get(r[0], 3))))[1])


def test_batch(spark):
    got = s.batch_durations(spark.createDataFrame(events(), SCHEMA)).collect()
    assert sorted(map(tuple, got)) == expected()
    assert ("m", "c", 225) in expected()


@pytest.mark.parametrize("ttl_ms", [None, 3_600_000])
def test_stream(spark, tmp_path, ttl_ms):
    """Two batches, then a restart from the checkpoint with a third: each duration comes out once."""
    src = tmp_path / "in"
    src.mkdir()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = sorted(events(), key=lambda r: r[3])

    def read():
        done = (tmp_path / "out" / "_spark_metadata").exists()
        return sorted(map(tuple, spark.read.schema(s.OUTPUT).parquet(str(tmp_path / "out")).collect())) if done else []

    def run(files, whole):
        for n, part in files:
            (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in part))
            os.utime(src / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files arrive in this order
        q = (
            s.stream_durations(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src)), ttl_ms)
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
            .trigger(**({"availableNow": True} if ttl_ms is None else {"processingTime": "1 second"})).start()
        )
        if ttl_ms is None:
            assert q.awaitTermination(120)
        else:  # with a time to live empty batches go on, so the stream is stopped once the files are through
            end = time.time() + 100
            while time.time() < end and read() != whole:
                time.sleep(0.5)
            q.stop()

    run([(0, rows[:22]), (1, rows[22:44])], expected(rows[:44]))
    run([(2, rows[44:])], expected())
    assert read() == expected()


def test_tool_events(spark):
    part = {"type": "tool", "tool": "compress", "callID": "c", "messageID": "m", "state": {"status": "completed", "time": {"start": 3, "end": 9}}}
    event = lambda t, time=None, inner=None, **x: json.dumps({"type": t, "time": time, "properties": {"time": inner, "part": {**part, **x}}})
    up = "message.part.updated"
    raw = [event(up, 5, 6), event(up, None, 6), event(up), event(up, state={"status": "pending"}), event("session.idle", 1), event(up, 1, type="text"), event(up, 1, tool="read"), event(up, 1, callID=None), "{", None]
    got = [tuple(r) for r in s.tool_events(spark.createDataFrame([(x,) for x in raw], "value string"), "compress").collect()]
    assert got[:3] == [("m", "c", "completed", 5, 3, 9), ("m", "c", "completed", 6, 3, 9), ("m", "c", "completed", None, 3, 9)]
    assert len(got) == 4 and got[3][2] == "pending" and got[3][3] > 1_700_000_000_000
    assert s.tool_events(spark.createDataFrame([(x,) for x in raw], "value string")).count() == 5


def test_attach(spark):
    blocks = spark.createDataFrame([("m", "c", 1, 7), ("m", "z", 2, 8)], "compress_message_id string, compress_call_id string, block_id long, duration_ms long")
    took = spark.createDataFrame([("m", "c", 225)], s.OUTPUT)
    assert {r["block_id"]: r["duration_ms"] for r in s.attach(blocks, took).collect()} == {1: 225, 2: 8}
    assert s.batch_durations(spark.createDataFrame([], SCHEMA).withColumn("extra", F.lit(1))).count() == 0
