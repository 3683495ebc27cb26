import json
import random
from datetime import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import conversations as c
from threadloom.llm import duplicates as d
from threadloom.llm import secrets as s

M = "id string, session_id string, time_created long, data string, removed_at timestamp_ntz, synced_at timestamp_ntz, content string"
P = "id string, message_id string, session_id string, time_created long, data string, synced_at timestamp_ntz"
NOW = dt(2025, 1, 1)


def store(spark, sessions):
    """sessions: id -> list of (role or raw data, text or None, removed)."""
    ms, ps = [], []
    for sid, rows in sessions.items():
        for i, (role, text, removed) in enumerate(rows):
            data = role if role is None or role.startswith("{") else json.dumps({"role": role, "agent": "build"})
            ms.append((f"{sid}m{i}", sid, 1_700_000_000 + i if i % 2 else (1_700_000_000 + i) * 1000, data, NOW if removed else None, NOW, "x"))
            if text is not None:
                ps.append((f"{sid}p{i}", f"{sid}m{i}", sid, i, json.dumps({"type": "text", "text": text}), NOW))
    return spark.createDataFrame(ms + ms[:2], M), spark.createDataFrame(ps + ps[:1], P)


def test_conversations(spark):
    ok = [("user", "hi", False), (" Assistant", "yes", False), ("user", "  ", False), ("USER", "more", False), ("assistant", "ok", False), ("assistant", "and", False)]
    sessions = {
        "good": ok,
        "noreply": ok[:1],
        "first": ok[1:],
        "badrole": [*ok[:2], ("tool", None, False)],
        "unread": [*ok[:2], ("{", None, False)],
        "gone": [*ok[:2], ("tool", "x", True)],
        "empty": [("user", None, False)],
    }
    m, p = store(spark, sessions)
    got = c.conversations(m, p).orderBy("session_id", "seq").collect()
    assert [(r["session_id"], r["seq"], r["id"], r["role"]) for r in got] == [
        ("gone", 0, "gonem0", "user"), ("gone", 1, "gonem1", "assistant"), ("good", 0, "goodm0", "user"), ("good", 1, "goodm1", "assistant"),
        ("good", 2, "goodm3", "user"), ("good", 3, "goodm4", "assistant"), ("good", 4, "goodm5", "assistant"),
    ]
    orphan = spark.createDataFrame([("o", "nowhere", "good", 1, None, NOW)], P)
    assert {r["session_id"] for r in c.conversations(m, p.unionByName(orphan)).collect()} == {"gone"}
    assert c.conversations(m.limit(0), p.limit(0)).count() == 0


LINKS = "session_id string, id string, t long, role string, name long, words array<long>, mentions array<long>"
DAY = 86_400_000


def test_trees_and_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("sssu"), f"i{i:03}", rng.randrange(5) * DAY + rng.randrange(3), rng.choice(["user", "assistant"]), i) for i in range(200)]
    links = c.reply_links(spark.createDataFrame(rows, "session_id string, id string, t long, role string, name long"))
    for sid in "su":
        got = links.where(links["session_id"] == sid).orderBy("seq").collect()
        assert [(r["id"], r["seq"]) for r in got] == [(r[1], k) for k, r in enumerate(sorted((r for r in rows if r[0] == sid), key=lambda r: (r[2], r[1])))]
        assert [r["direct"] for r in got] == [False, *[(a["role"], b["role"]) == ("user", "assistant") for a, b in zip(got, got[1:])]]
        parent = {r["seq"]: r["parent_seq"] for r in got}

        def root(x):
            while parent[x] is not None:
                x = parent[x]
            return x

        assert {r["seq"]: r["tree_id"] for r in c.reply_trees(links).collect() if r["session_id"] == sid} == {x: f"{sid}#{root(x)}" for x in parent}


def scored(rows, sid):
    """Parent of each message of a session, all pairs scored."""
    order = sorted((r for r in rows if r[0] == sid), key=lambda r: (r[2], r[1]))
    n = len(order)
    df = {}
    for r in order:
        for w in r[5]:
            df[w] = df.get(w, 0) + 1
    want = {}
    for k, x in enumerate(order):
        best = (0, 0, None)
        for j, p in enumerate(order[:k]):
            score = c.DIRECT if j == k - 1 and (p[3], x[3]) == ("user", "assistant") else 0.0
            score += (p[3] != x[3]) * c.TURN + 1 / (1 + np.log1p((x[2] - p[2]) / 60_000)) + (p[4] in x[6]) * c.MENTION
            score += max((np.log((n + 1) / df[w]) / np.log(n + 1) for w in {*p[5]} & {*x[5]}), default=0)
            best = max(best, (round(score, 9), j, p[1]))
        want[x[1]] = best[2] if best[0] >= c.LEAST_SCORE or x[3] != "user" else None
    return want


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    names = [(i + 1) << 40 for i in range(3)]
    word = lambda: 1 + int(200 * rng.random() ** 2)
    rows = [(f"s{i % 7 % 2}", f"i{i:03}", rng.randrange(9) * DAY + rng.randrange(9) * 300_000, rng.choice(["user", "assistant"]), rng.choice(names), sorted({word() for _ in range(rng.randrange(9))}), rng.sample(names, 2 * (i % 5 == 0))) for i in range(240)]
    rows += [(f"t{i % 50}", f"j{i:03}", i, "user" if i < 50 else "assistant", 0, [5], []) for i in range(100)]
    want = {}
    for sid in {r[0] for r in rows}:
        want |= scored(rows, sid)
    df = spark.createDataFrame(rows, LINKS)
    ranges = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "2", "13"):  # sessions in one range, in two, in many
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = c.reply_links(df).collect()
            assert {r["id"]: r["parent_id"] for r in got} == want
            assert sum(r["parent_seq"] is not None and r["seq"] - r["parent_seq"] > 6 for r in got) > 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)


def test_interleaved_channels_are_told_apart(spark):
    """Two exchanges run through one session by turns; the true parent is the message before in the same exchange."""
    rng = random.Random(5)
    topics = [[f"{k}topic{i}" for i in range(40)] for k in "ab"]
    ms, ps, true = [], [], {}
    last = [None, None]
    for i in range(120):
        k = rng.randrange(2)
        words = rng.sample(topics[k], 8) + rng.sample(["please", "the", "look", "again", "file"], 3)
        if last[k]:  # a reply takes up two words of what it answers
            true[f"m{i}"] = last[k][0]
            words += last[k][1][:2]
        last[k] = (f"m{i}", rng.sample(words[:8], 8))
        ms.append((f"m{i}", "s", 1_700_000_000_000 + i * 120_000, json.dumps({"role": rng.choice(["user", "assistant"]), "agent": "build"}), None, NOW, "x"))
        ps.append((f"p{i}", f"m{i}", "s", i, json.dumps({"type": "text", "text": " ".join(words)}), NOW))
    every = c.joined(spark.createDataFrame(ms, M), spark.createDataFrame(ps, P))
    got = {r["id"]: r["parent_id"] for r in c.reply_links(c.content_rows(every)).collect()}
    channel = {x: x for x in got}
    for x in sorted(true, key=lambda x: int(x[1:])):
        channel[x] = channel[true[x]]
    same = sum(channel[got[x]] == channel[x] for x in true if got[x])
    assert same >= 0.85 * len(true)
    assert sum(got[x] == true[x] for x in true) >= 0.5 * len(true)
    nearest = sum(channel[f"m{int(x[1:]) - 1}"] == channel[x] for x in true)
    assert nearest < 0.65 * len(true)  # time alone would not do


def test_without_links_nothing_is_kept(spark, monkeypatch):
    m, p = store(spark, {"good": [("user", "hi", False), ("assistant", "yes", False)]})
    assert c.conversations(m, p).count() == 2
    links = c.reply_links
    monkeypatch.setattr(c, "reply_links", lambda rows: links(rows).withColumn("parent_id", F.lit(None).cast("string")))
    assert c.conversations(m, p).count() == 0


def test_words_and_mentions(spark):
    long = " ".join(f"word{i}x" for i in range(3000))
    texts = ["Ask Cairn-7B now", "cairn has 7b", "the cairn-7bs", long, long + " so, build it", "more words here"]
    ps = [(f"p{i}", f"m{i}", "s", i, json.dumps({"type": "text", "text": t}), NOW) for i, t in enumerate(texts)]
    ms = [(f"m{i}", "s", i, json.dumps({"role": "user", "agent": "Build"} if i % 2 else {"role": "user", "modelID": "cairn-7b"}), None, NOW, "x") for i in range(6)]
    rows = {r["id"]: r for r in c.joined(spark.createDataFrame(ms, M), spark.createDataFrame(ps, P)).collect()}
    build, cairn = rows["m1"]["name"], rows["m0"]["name"]
    assert [rows[f"m{i}"]["mentions"] for i in range(6)] == [[cairn], [], [], [], [build], []]
    assert not set(rows["m3"]["words"]) & set(rows["m5"]["words"]) and len(rows["m3"]["words"]) == 3000


CALLS = "call_id string, tool string, parameters string, h1 string"


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = [{"filePath": f"src/a{i}.py", "limit": i % 3, "todos": [{"id": "1", "x": f"b {i}"}]} for i in range(40)]
    rows = []
    for n in range(300):
        j = dict(sorted(rng.choice(base).items(), key=lambda _: rng.random()))
        j["filePath"] = rng.choice(["{}", " {} ", "'{}'"]).format(j["filePath"].upper() if rng.random() < 0.3 else j["filePath"])
        rows.append((f"c{n:03}", rng.choice(["read", "READ ", "re-ad"]), json.dumps(j, indent=rng.choice([None, 2])), "clash"))
    rows += [("c999", "read", None, ""), ("c998", "read", "{", ""), (None, "read", "{}", ""), rows[0], ("solo", "x", '{"n": 1.0}', ""), ("solo2", "x", '{"n": 1}', ""), ("solo3", "x", '{"n": "1"}', "")]
    groups = {}
    for cid, tool, text, _ in rows:
        form = d.canonical(tool, text)
        if cid and form:
            groups.setdefault(form, set()).add(cid)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    df = spark.createDataFrame(rows, CALLS)
    assert {tuple(r) for r in d.duplicate_calls(df).collect()} == want
    sizes = {min(g): len(g) for g in groups.values()}
    for most in (d.SEGMENT, d.MAX_CELLS):
        assert {r["call_id"]: r["n_calls"] for r in d.collapsed_calls(df, most).collect()} == sizes
    assert d.duplicate_calls(df.limit(0)).count() == 0


def test_filter_lets_few_singletons_through_at_every_size(spark, monkeypatch):
    """With filters of one segment (16,384 rows at most) 60,000 rows take several ranges; the share shuffled stays small."""
    monkeypatch.setattr(d, "hashed_calls", lambda rows: rows)
    hashes = spark.range(60_000).selectExpr("concat('c', id) as call_id", "xxhash64(case when id < 600 then id div 2 else id end) as h1", "xxhash64(case when id < 600 then id div 2 else id end, 7) as h2")
    for most, n in ((d.SEGMENT, 8), (d.MAX_CELLS, 1)):
        marked = d.split_by_filter(hashes, most)
        assert max(1, d.cells_for(60_000) // most) in (n // 2, n)
        maybe = {r["call_id"] for r in marked.where("maybe").collect()}
        assert marked.count() == 60_000 and {f"c{i}" for i in range(600)} <= maybe and len(maybe) < 1200


def test_filter_merge():
    a = np.zeros(d.SEGMENT // 8, np.uint8)
    a[0] = 0b11000000
    pack = lambda x: d.zlib.compress(bytes(x), 1)
    once, twice = map(d._unpack, d._merge([pack(a.tobytes()), pack(a.tobytes())], [pack(bytes(len(a))), pack(bytes(len(a)))]))
    assert once[0] == 0b11000000 and twice[0] == 0b11000000


KEY = "Zx81" + "kQ93mN20pL47vB65tR18"


def lines(text):
    auto = s._automaton()
    return sorted({n for n, _, _ in s.text_spans(text, auto)})


def test_secrets():
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1" * 12 + "\n-----END RSA PRIVATE KEY-----"
    yes = [f"token = '{KEY}'", "x\n" + pem, f"curl -H 'Authorization: Bearer {KEY}' u", f"https://u:{KEY}@h.example/x", f"https://h.example/?api_key={KEY}", "DB_PASSWORD=kubafa9065!", f"key: >-\n  {KEY}\n", f'k = "{KEY[:12]}" + "{KEY[12:]}x9y8"', f"mysql -u me -p'{KEY}' db", "+  password: 'abc12345',"]
    assert [lines(t) for t in yes] == [[1], [2], [1], [1], [1], [1], [2], [1], [1], [1]]
    no = ["password = ''", "token = '<your-token>'", "token=${TOKEN}", "PASSWORD = os.environ['X']", "sha = '" + "a1b2c3d4" * 5 + "'", "-----BEGIN PUBLIC KEY-----\nAb1Ab1Ab1Ab1Ab1Ab1\n-----END PUBLIC KEY-----", "passwordMinLength: 12", "", "key" * 30_000, "api_key: xxxxxxxxxxxxxxxx", "password: !vault a/b"]
    assert [lines(t) for t in no] == [[]] * len(no)


def test_every_shape_of_parameters_is_scanned():
    auto, hexed = s._automaton(), "9f86d081884c7d659a2feaa0c55ad015"
    cases = {
        '{"price": 1.10, "a": {"b" : "x\\u00e9 token = \\"%s\\""}, "a": [null, ""], "": "k"}': [("a", 1)],
        '{"content": "token = \'%s\'\\nx", "cut': [("", 1)],
        '["token = \'%s\'"]': [("", 1)],
        '"token = \'%s\'"': [("", 1)],
        '{"env": {"DB_PASSWORD": "%s", "SORT_KEY": "%s-"}}': [("env", 1)],
        '{"c": "password = (\\n\\n    \'%s\'\\n)"}': [("c", 3)],
        '{"c": "Fernet(b\'%s\')"}': [("c", 1)],
        '{"c": "FIXME %s"}': [("c", 1)],
        '{"c": "curl -u me:%s \\\\\\n  https://h"}': [("c", 1)],
        '{"c": "\\"me:%s@tcp(db)\\""}': [("c", 1)],
    }
    for text, want in cases.items():
        raw = text.replace("%s", KEY)
        rows, masked = s.scan_parameters(raw, auto)
        assert list(dict.fromkeys(rows)) == want, raw
        assert len(masked) == len(raw) and masked.startswith(raw[: raw.index(KEY)]) and KEY not in masked.replace(f"{KEY}-", "")
        kept = [i for i, (a, b) in enumerate(zip(raw, masked)) if a != b]
        assert all(raw.index(KEY) <= i < raw.index(KEY) + len(KEY) for i in kept)
    sendgrid = "SG." + "aB3" * 7 + "." + "xY9" * 12
    assert lines(sendgrid) == [1]
    assert s._masked(hexed) == "0a00a000000a0a000a0aaaa0a00aa000" and s._masked("aB3-x!") == "xX0-x!"
    assert s.mask("key=abc", [(4, 7), (5, 7)]) == "key=xxx"
    good = "ghp_" + "A1b2C3" * 5
    good = next(t for n in [__import__("zlib").crc32(good[4:].encode())] for t in [good + "".join(s._BASE62[n // 62**k % 62] for k in range(5, -1, -1))])
    assert s._checksum(good) and not s._checksum(good[:-1] + ("A" if good[-1] != "A" else "B")) and lines("x " + good) == [1]
    many = ("-----BEGIN PRIVATE KEY-----\n" * 20_000) + "token = '" + KEY + "'"
    assert lines(many) == [20_000]  # the last one is open to the end and has a body


def test_redaction(spark):
    rows = [("a", json.dumps({"content": f"x = 1\ntoken = '{KEY}'\n", "n": [1]}), "z"), ("b", None, "z"), ("c", "{", "z"), ("d", "", "z"), ("e", "[1]", "z")]
    df = spark.createDataFrame(rows, "call_id string, parameters string, hits string")
    got = {r["call_id"]: r for r in s.redact_calls(df).collect()}
    masked = json.loads(got["a"]["parameters"])["content"]
    assert len(masked) == len(json.loads(rows[0][1])["content"]) and KEY not in masked and masked.startswith("x = 1\ntoken = 'Xx00")
    assert [(h["field_name"], h["line_no"]) for h in got["a"]["hits"]] == [("content", 2)]
    assert [got[k]["parameters"] for k in "bcde"] == [None, "{", "", "[1]"]
    assert [tuple(r) for r in s.found_in_calls(df.unionByName(df)).collect()] == [("a", "content", 2)]
    cfg = spark.createDataFrame([("x", f"Bearer {KEY}", "https://h.example/v1"), ("y", "your-api-key", f"https://u:{KEY}@h.example"), ("z", None, None)], "config_id string, api_key string, url string")
    assert {r["config_id"]: r["hits"] for r in s.redact_configs(cfg).collect()} == {"x": ["api_key"], "y": ["url"], "z": []}
