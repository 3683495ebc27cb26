import random
import json

from threadloom.llm import pii

GIVEN, FAMILY = ["Anna", "Berit", "Cora", "Will"], ["Dalgren", "Eskimo", "Falk"]
LEX = [(w, "given") for w in GIVEN] + [(w, "family") for w in FAMILY] + [(None, "given"), ("", "family")]


def run(spark, texts):
    t = spark.createDataFrame([(f"p{i}", x, "clash") for i, x in enumerate(texts)], "part_id string, text string, kind string")
    found = pii.personal_information(t, spark.createDataFrame(LEX, "name_form string, kind string"))
    kinds = {(r["part_id"], r["line_no"], r["kind"]) for r in found.collect()}
    return kinds, {r["part_id"]: r["text"] for r in pii.redact(t, found).collect()}


def test_kinds_and_bootstrapping(spark):
    seeds = [f"Reported by {g} {f} today" for g, f in zip(GIVEN, FAMILY)]
    texts = [
        *seeds,
        "Reported by Zorka Unbekant today",
        "mail a.b+c@x.example or a.b (at) x dot example\ncall me on 212-555-0100 now\nSSN 900-11-2222 is wrong",
        "212-555-0177",
        "row holds record 901-22-3333, active",
        "ship to Flat 3, 14 Elm Rd, Town\nMusterstraße 12a",
        "Will Retry is the flag; v1.2.3 pkg@1.2.3 @dec order 48-720-830 ip 10.1.2.3 Street View",
        "9 Oak\nStreet is where",
        "",
        "x" * 50_000,
        seeds[0],
    ]
    kinds, out = run(spark, texts)
    n = len(seeds)
    assert {(f"p{i}", 1, "name") for i in range(n + 1)} <= kinds
    assert {("p%d" % (n + 1), 1, "email"), ("p%d" % (n + 1), 2, "phone"), ("p%d" % (n + 1), 3, "id_number")} <= kinds
    assert ("p%d" % (n + 2), 1, "phone") in kinds and ("p%d" % (n + 3), 1, "id_number") in kinds
    assert {("p%d" % (n + 4), 1, "address"), ("p%d" % (n + 4), 2, "address"), ("p%d" % (n + 6), 1, "address")} <= kinds
    assert not any(k[0] == "p%d" % (n + 5) for k in kinds)
    assert out[f"p{n}"] == "Reported by [NAME] today"
    assert out["p%d" % (n + 1)].startswith("mail [EMAIL] or [EMAIL]\ncall me on [PHONE] now\nSSN [ID_NUMBER] is wrong")
    assert out["p%d" % (n + 8)] == "x" * 50_000


def test_parts_and_empty(spark):
    rows = [("a", json.dumps({"type": "text", "text": "hi"})), ("b", json.dumps({"type": "tool", "text": "x"})), ("c", '{"type":"text"'), (None, json.dumps({"type": "text", "text": "hi"})), ("d", None)]
    assert [r["part_id"] for r in pii.text_parts(spark.createDataFrame(rows, "id string, data string")).collect()] == ["a"]
    assert run(spark, [])[0] == set()


def test_two_keys(spark):
    _, out = run(spark, ['{"firstName":"Anna","lastName":"Falk","n":1}'])
    assert out["p0"] == '{"firstName":"[NAME]","lastName":"[NAME]","n":1}'


def test_prefilters_cover_their_patterns():
    rng = random.Random(4)
    bits = ["Bahnhof", "str.", "Straße", "straße", "weg", " ", " ", "\t", "5", "12", "1234", "bis", "ter", ",", "rue", "de la", "Paix", "Main", "Street", "A1B2", "C3D4", "AB", "(", "-", ".", "Frau", "Dr", "Xyz", "\n", "N"]
    texts = ["Bahnhofstr. 5", "12bis rue de la Paix", "A1B2C3D4", "1234ABC", "Frau Xyz", *("".join(rng.choices(bits, k=rng.randrange(2, 9))) for _ in range(40_000))]
    for has, patterns in ((pii._HAS_STREET, (pii._ADDRESS_EN, pii._ADDRESS_DE, pii._ADDRESS_FR, pii._ADDRESS_ANY)), (pii._HAS_NUMBER, (pii._NUMBER,)), (pii._HAS_TITLE, (pii._TITLED,))):
        for x in texts:
            assert has.search(x) or not any(p.search(x) for p in patterns), x
    assert {w for m in pii._LOWER_WORD.finditer('ask "anna schmidt", or x-anna-lena') for w in (m[0], m[1])} >= {"anna", "schmidt"}


def test_rounds_find_what_seeds_do_not(spark):
    texts = [
        "Reported by Anna Dalgren today", "Reported by Berit Eskimo today", "Reported by Cora Falk today", "Reported by Zorka Unbekant today", "Reported by Milka Sondar today", "Reported by Zorka Unbekant today", "Reported by Milka Sondar today",
        "thanks Zorka Unbekant for it", "thanks Milka Sondar for it", "thanks Quilla Vestor for it", "thanks Ronja Tarnov for it", "thanks Quilla Vestor for it", "thanks Ronja Tarnov for it",
        "asked Quilla Vestor twice", "asked Ronja Tarnov twice", "asked Selma Ostrik twice",
        "ship to 3 Elm Road, Xyz", "ship to 5 Fir Lane, Xyz", "ship to 9 Oak Skarn, Xyz", "living near 7 Birch Skarn, now",
        "call me on 212-555-0100 now", "call me on 212-555-0101 now", "row holds 212-555-0102 active", "row holds 0049 30 23 125 active", "seen beside 0049 30 23 126 once",
    ]
    t = spark.createDataFrame([(f"p{i:02}", x) for i, x in enumerate(texts)], "part_id string, text string")
    names = spark.createDataFrame(LEX, "name_form string, kind string")
    found = {n: {(r["part_id"], r["kind"]) for r in pii.personal_information(t, names, n).collect()} for n in (0, 1, None)}
    assert found[0] < found[1] < found[None]
    late = found[None] - found[1]
    assert late >= {("p15", "name"), ("p19", "address"), ("p24", "phone")}  # a name, a street and a number shape never seen beside a seed
    assert found[None] == {(f"p{i:02}", "name" if i < 16 else "address" if i < 20 else "phone") for i in range(len(texts))}


def test_long_texts_take_time_in_proportion():
    import time

    finder = pii.Finder({w.lower() for w in GIVEN}, {w.lower() for w in FAMILY})
    line = "Anna Falk, mail a@b.example, call me on 212-555-0100 at 14 Elm Road, Town\n"
    took = []
    for n in (1_000, 8_000):
        began = time.process_time()
        assert len(finder.mentions(line * n)) >= 4 * n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]
