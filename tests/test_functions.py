import re

import pytest
from pyspark.sql import functions as F

from threadloom import config
from threadloom.functions import text as t


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("**/*.env", "a/b/.env", True), ("**/*.env", "x.env", True), ("src/*", "src/a/b", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("", "x", False), ("a.b", "axb", False)],
)
def test_globs(pattern, path, hit):
    assert bool(re.match(t.glob_regex(pattern), path)) == hit


def test_wildcards():
    assert re.match(t.wildcard_regex("git *"), "git") and re.match(t.wildcard_regex("git *"), "git push\nx")
    assert not re.match(t.wildcard_regex("git *"), "gitx")


def test_columns(spark):
    df = spark.createDataFrame([(" M0042 ", "b12", "a<context-ref>b3</context-ref>b\nm0007\n", '{"b":1,"a":{"d":null,"c":[2]},"z":null}')], "m string, b string, x string, j string")
    r = df.select(
        t.parse_message_ref(F.col("m")).alias("m"), t.parse_block_ref(F.col("b")).alias("b"), t.parse_message_ref(F.lit("m0000")).alias("zero"), t.strip_tags(F.col("x")).alias("x"),
        t.mask_block_tags(F.col("x")).alias("masked"), t.canonical_json(F.col("j")).alias("j"), t.message_ref(F.lit(10_000)).alias("over"), t.count_tokens(F.lit("12345678901234")).alias("n"),
        t.append_once(F.lit("base\n"), F.lit("\n add")).alias("app"), t.duration_text(F.lit(3_725_000)).alias("d"), t.boundary(F.lit("b7")).alias("bd"),
    ).first()
    assert (r["m"], r["b"], r["zero"], r["over"], r["n"]) == (42, 12, None, None, 4)
    assert r["x"] == "ab" and "BLOCKED" in r["masked"]
    assert r["j"] == '{"a":{"c":[2],"d":null},"b":1}'
    assert r["app"] == "base\n\n add" and r["d"] == "1h 2m" and tuple(r["bd"]) == ("block", 7)


def test_config():
    read = config.read_jsonc('{"a": [1, 2,], // x\n "u": "http://y", /* z */ "compress": {"mode": "message",},}')
    assert read == {"a": [1, 2], "u": "http://y", "compress": {"mode": "message"}}
    out = config.effective({"protected_tools": ["x", "task"]}, read, env={"THREADLOOM_MODEL_URL": "u", "THREADLOOM_MODEL_NAME": "m", "THREADLOOM_MODEL_RETRIES": "0", "THREADLOOM_MODEL_TIMEOUT": "0"})
    assert out["protected_tools"] == ["task", "todowrite", "x"] and out["compress"]["mode"] == "message"
    assert out["compress"]["external_model"] == {"url": "u", "model": "m", "retries": 0}
    assert config.unknown_keys({"enabled": 1, "nope": {"x": 1}}) == ["nope", "nope.x"]
    assert config.type_errors({"enabled": 1}) == [("enabled", "bool", "int")]
    assert config.token_limit("50%", 200_001) == 100_000 and config.token_limit("x", 1) is None and config.token_limit("150%", 10) == 10
    assert config.permitted("allow", "compress", {"*": "ask"}, {"compress": {"*": "deny"}}) == "deny"
    assert config.permitted("allow", "compress", {"compress": "deny"}, {"comp*": "allow"}) == "allow"
