import random

from threadloom.operators import blocks as b
from threadloom.operators import compress as c

SCHEMA = "session_id string, block_id long, created_at long, anchor_message_id string, deactivated_by_user boolean, consumed_block_ids array<long>, effective_message_ids array<string>, mode string, run_id long, compressed_tokens long, duration_ms long, topic string"


def fold(blocks, live):
    active, killer = set(), {}
    for x in sorted(blocks, key=lambda x: (x[2], x[1])):
        if x[3] not in live or x[4]:
            continue
        for y in x[5]:
            if y in active:
                active.discard(y)
                killer[y] = x[1]
        active.add(x[1])
    return active, killer


def test_replay_equals_fold(spark):
    rng = random.Random(9)
    live = {f"m{i}" for i in range(6)}
    rows, want = [], {}
    for s in range(40):
        n = rng.randrange(1, 8)
        own = [(f"s{s}", i, rng.randrange(4), f"m{rng.randrange(8)}", rng.random() < 0.2, [rng.randrange(-1, 9) for _ in range(rng.randrange(4))], [f"m{rng.randrange(9)}"], "range", 1, 1, 1, "t") for i in range(n)]
        rows += own
        active, killer = fold(own, live)
        want |= {(f"s{s}", x[1]): (x[1] in active, killer.get(x[1])) for x in own}
    got = b.replay(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(m,) for m in live], "message_id string"))
    found = {(r["session_id"], r["block_id"]): (r["now_active"], r["killer"]) for r in got.collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in found.items() if v[1] is not None} == {k: v[1] for k, v in want.items() if v[1] is not None}


def test_targets(spark):
    rows = [("s", i, i, "m", False, [], [], mode, run, tokens, ms, f"t{i}") for i, mode, run, tokens, ms in ((1, "message", 10, 1, 225), (2, "message", 10, 2, 225), (3, "range", 11, 4, 80))]
    got = b.targets(spark.createDataFrame(rows, SCHEMA)).orderBy("first_block").collect()
    assert [(r["first_block"], r["n_blocks"], r["tokens"], r["duration_ms"], r["topic"]) for r in got] == [(1, 2, 3, 225, "t1"), (3, 1, 4, 80, "t3")]
    assert sum(r["duration_ms"] for r in got) == 305


def test_newly_compressed_equals_fold(spark):
    rows = [("s", 1, 1, "m", False, [], ["a", "b", "a"], "range", 1, 0, 0, ""), ("s", 2, 2, "m", False, [1], ["b", "c"], "range", 1, 0, 0, "")]
    tokens = spark.createDataFrame([("s", "a", 5), ("s", "c", 7)], "session_id string, message_id string, tokens long")
    got = c.newly_compressed(spark.createDataFrame(rows, SCHEMA), tokens).orderBy("block_id").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 2, 2, 5), (2, 2, 1, 7)]


def test_placeholders(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("see (b2) and {block_1}, not (b9)", [(1, "one (b2)"), (2, "two $1"), (3, "three")])], "s string, bodies array<struct<id:long,body:string>>")
    r = df.select(c.placeholders(F.col("s")).alias("p"), c.inject(F.col("s"), F.col("bodies")).alias("t"), c.unwrap(c.wrap(F.lit(4), F.lit(" x\ny "))).alias("u")).first()
    assert r["p"] == [2, 1, 9]
    assert r["t"] == "see two $1 and one (b2), not (b9)\n\nthree"
    assert r["u"] == "x\ny"
