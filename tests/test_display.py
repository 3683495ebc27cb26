import json
from datetime import datetime

from pyspark.sql import functions as F

from threadloom.functions import display as d
from threadloom.functions import parts as p
from threadloom.sources import sinks


def rows(spark, shape, data, **columns):
    return [tuple(r) for r in spark.createDataFrame(data, shape).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_labels(spark):
    cases = [
        ("read", {"filePath": "a", "offset": 2, "limit": 3}, "a (lines 2-5)"), ("read", {"filePath": "a", "offset": 2}, "a (lines 2+)"), ("read", {"filePath": "a", "limit": 9}, "a (lines 0-9)"), ("edit", {"filePath": "b"}, "b"),
        ("apply_patch", {"patchText": "*** Add File: x\n*** Update File: y\n*** Delete File: z\n"}, "3 files: x, y..."), ("apply_patch", {"patchText": "none"}, "patch"), ("list", {"x": 1}, "(current directory)"),
        ("grep", {"pattern": "q", "path": "src"}, '"q" in src'), ("glob", {"path": "src"}, "(unknown pattern)"), ("bash", {"command": "c" * 60}, "c" * 50 + "..."), ("bash", {"command": "c", "description": "run"}, "run"),
        ("webfetch", {"url": "u"}, "u"), ("websearch", {"query": "q"}, '"q"'), ("todowrite", {"todos": [1, 2]}, "2 todos"), ("todoread", {"a": 1}, "read todo list"), ("skill", {"name": "n"}, "n"),
        ("lsp", {"operation": "hover", "filePath": "f", "line": 1, "character": 2}, "hover f:1:2"), ("lsp", {"filePath": "f"}, "lsp f"), ("question", {"questions": [{"header": "h"}, {}, {"header": "i"}, {}]}, "4 questions: h, i (+1 more)"),
        ("question", {"questions": []}, "question"), ("other", {"z": 1, "a": 2}, '{"z":1,"a":2}'), ("other", {}, ""),
    ]
    got = rows(spark, "t string, p string", [(t, json.dumps(x)) for t, x, _ in cases] + [("read", None), ("read", "{")], x=d.call_label(F.col("t"), F.col("p")))
    assert [g[0] for g in got] == [w for *_, w in cases] + ["", ""]


def test_numbers(spark):
    n = F.col("n")
    got = rows(spark, "n long", [(950,), (1234,), (3000,), (None,)], a=d.token_text(n), b=d.token_text(n, True), c=d.duration_brief(n), e=d.size_bar(n, F.lit(3000)))
    assert [g[:3] for g in got] == [("950 tokens", "950", "0.9s" if got[0][2] == "0.9s" else "1.0s"), ("1.2K tokens", "1.2K", "1.2s"), ("3K tokens", "3K", "3.0s"), (None, None, "-")]
    assert [g[3] for g in got[:3]] == ["###.....  32%", "###.....  41%", "######## 100%"]
    big = rows(spark, "n long", [(245_000,), (7_500_000,), (0,)], c=d.duration_brief(n), e=d.size_bar(n, F.lit(0)), f=d.removal_text(n, F.lit(0)), g=d.saved_text(n, F.lit(10)), h=d.removal_text(n, F.lit(5)))
    assert [b[0] for b in big] == ["4m5s", "2h5m", "0.0s"] and big[0][1] == "........   0%" and big[2][2] == "-0 removed" and big[2][3] == "~10 tokens saved total" and big[2][4] == "-0 removed, +5 summary"


def test_texts(spark):
    t = F.col("t")
    got = rows(spark, "t string", [("/w/a/b",), ("/w",), ('"x" in /w/c',), ("/other",), (None,)], x=d.short_path(t, "/w"))
    assert [g[0] for g in got] == ["a/b", ".", '"x" in c', "/other", None]
    assert rows(spark, "t string", [(" a \n  b",)], x=d.collapse_whitespace(t)) == [("a b",)]
    assert rows(spark, "t string", [("1\n2\n3\n4",), ("1",)], x=d.first_lines(t, 3)) == [("1\n2\n... and 2 more",), ("1",)]
    assert rows(spark, "t string, m map<string,string>", [("m0001", {"b": '"', "a": "x", "c": "", "d": None})], x=d.tag_text(t, F.col("m"))) == [('\n<context-ref a="x" b="&quot;">m0001</context-ref>',)]


PARTS = "role string, parts array<struct<id:string,type:string,text:string,status:string,output:string>>"


def test_parts(spark):
    text, tool = ("1", "text", "one", None, None), ("2", "tool", None, "completed", "out")
    data = [("user", [text, tool, ("3", "text", "two\n", None, None)]), ("assistant", [tool, text]), ("assistant", [("9", "reasoning", "r", None, None), tool]), ("user", []), ("user", None)]
    df = spark.createDataFrame(data, PARTS)
    once = lambda c: df.select(c.alias("x")).collect()
    last = once(p.append_to_last_text(p.append_to_last_text(F.col("parts"), F.lit("\nadd")), F.lit("add")))
    assert [q["text"] for q in last[0]["x"]] == ["one", None, "two\n\nadd"] and [q["text"] for q in last[1]["x"]] == [None, "one\n\nadd"] and last[3]["x"] == [] and last[4]["x"] is None
    outs = once(p.append_to_outputs(p.append_to_outputs(F.col("parts"), F.lit("<t>")), F.lit("<t>")))
    assert outs[0]["x"][1]["output"] == "out<t>"
    placed = once(p.place_text(F.col("role"), F.col("parts"), F.lit("new"), F.lit("seed")))
    assert [[q["text"] for q in r["x"]] for r in placed[:4]] == [["one", None, "two\n\nnew"], [None, "one\n\nnew"], ["r", "new", None], ["new"]]
    assert placed[2]["x"][1]["id"].startswith("prt_") and placed[4]["x"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), (None, 3, "y")], "session_id string, seq long, body string")
    out = str(tmp_path / "snap")
    sinks.write_snapshot(df, out, "t1")
    sinks.write_snapshot(df.where("seq = 1"), out, "t2")
    sinks.write_snapshot(df.where("seq = 2"), out, "t1")
    assert {(r["session_id"], r["stamp"], r["seq"]) for r in spark.read.json(out).collect()} == {("a", "t1", 1), ("a", "t2", 1), ("b", "t1", 2)}
    sinks.export_json(df, str(tmp_path / "e"))
    assert '"body":null' in "".join(f.read_text() for f in (tmp_path / "e").glob("part-*"))
    log = spark.createDataFrame([(datetime(2025, 1, 1, 5), "x")], "at timestamp, m string")
    sinks.append_log(log, str(tmp_path / "l"))
    sinks.append_log(log, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
