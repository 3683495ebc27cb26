import random
from pathlib import Path

import numpy as np
import pytest

from threadloom.llm import leakage, mixing, residue

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "po", "ri") for b in ("ver", "den", "sul", "tam", "gor")]


def brute(items, docs):
    out = set()
    for d, text in docs:
        if not text:
            continue
        doc = leakage.Letters(text)
        for i, t in items:
            item = leakage.Letters(t or "")
            for k in range(len(item.starts) - leakage.MIN_WORDS + 1):
                run = item.text[item.starts[k] : item.ends[k + leakage.MIN_WORDS - 1]]
                at = doc.text.find(run)
                while at >= 0:
                    if at in doc.starts and at + len(run) in doc.ends:
                        out.add((d, i))
                    at = doc.text.find(run, at + 1)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40)) + "\nQuestion: x?") for i in range(12)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for d in range(120):
        w = items[rng.randrange(12)][1].split()
        a = rng.randrange(25)
        w = w[a : a + rng.randrange(9, 18)]
        dress = rng.randrange(5)
        text = " ".join(w)
        if dress == 1:
            text = text.upper().replace(" ", "  (applause) ")
        if dress == 2:
            text = "\n".join(x[:2] + "-\n" + x[2:] for x in w)
        if dress == 3:
            text = ", ".join(w)
        docs.append((d, f"start. {text}, end"))
    docs += [(500, None), (501, ""), (502, "z" * 200_000), docs[0]]
    it = spark.createDataFrame(items, "item_id long, text string")
    dd = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    want = brute(items, docs)
    assert want
    for chars in (200, leakage.GROUP_CHARS):
        got = leakage.find_leaks(dd, it, chars)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    text = dict(docs)
    for r in got.collect():
        assert len(leakage._WORD.findall(leakage.blank_brackets(text[r["doc_id"]][r["start_at"] : r["end_at"]]))) >= leakage.MIN_WORDS
    assert leakage.find_leaks(dd, it.limit(0)).count() == 0


def test_permutation():
    for n in (1, 2, 3, 100, 257):
        with np.errstate(over="ignore"):
            p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(p) == list(range(n))


@pytest.mark.parametrize("seed", range(4))
def test_slots_within_supply(spark, seed):
    blocks, targets = {"a": 1000, "b": 67, "c": 0, "d": 300}, {"a": (0.5, 1), "b": (0.2, 3), "c": (1.0, 1), "d": (0.3, 1)}
    plan = mixing.Plan.of(blocks, targets)
    assert plan.names == ["a", "b", "d"] and plan.total == 1000
    rows = mixing.draw_slots(spark, plan, 8, seed, 10).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(i // 8, i % 8) for i in range(1000)]
    use = {}
    for r in rows:
        assert r["block"] < blocks[r["source"]]
        use.setdefault((r["source"], r["block"]), set()).add(r["pass_no"])
    assert sum(map(len, use.values())) == 1000 and all(len(p) <= targets[s][1] for (s, _), p in use.items())
    assert rows == mixing.draw_slots(spark, plan, 8, seed, 10).collect() or sorted(rows) == sorted(mixing.draw_slots(spark, plan, 8, seed, 10).collect())
    late = [sum(r["source"] == "b" for r in rows if half == (r["shard"] >= 63)) for half in (False, True)]
    assert abs(late[0] - late[1]) < 70  # what exceeds the supply leaves all shards alike
    assert mixing.draw_slots(spark, mixing.Plan.of({}, targets)).count() == 0


@pytest.mark.skipif(not Path(mixing.TOKENIZER_FOLDER).exists(), reason="no tokenizer files")
def test_mix(spark):
    docs = [(i, f"word {i} " * (i % 40), "Plenary Text" if i % 3 else "small_one", None) for i in range(300)] + [(900, None, "small_one", None), (901, "x", None, None), (902, "y", "other", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("plenary_text", 0.6, 1), ("SMALL one", 0.6, 2), ("ghost", 0.1, 1), (None, 0.2, 1), ("other", None, None)], "source string, target_share double, max_repeats int")
    mixed, blocks = mixing.mix(df, targets, block_tokens=16, shard_slots=8)
    rows = mixed.collect()
    use = {}
    for r in rows:
        use[(r["source"], r["block"])] = use.get((r["source"], r["block"]), 0) + 1
        assert sum(p["to_token"] - p["from_token"] for p in r["pieces"]) == r["n_tokens"]
    assert all(n <= {"plenary_text": 1, "small_one": 2}[s] for (s, _), n in use.items())
    counts = {(r["doc_id"]): r["n_tokens"] for r in mixing.token_counts(df).collect()}
    assert sum(r["n_tokens"] for r in blocks.collect()) == sum(n for d, n in counts.items() if d < 900)
    share = {r["source"]: r for r in mixing.shares(mixed, blocks, targets).collect()}
    assert set(share) == {"plenary_text", "small_one", "ghost"} and abs(share["small_one"]["actual_share"] - 0.5) < 0.2 and share["ghost"]["mix_tokens"] == 0
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[0].count() == 0


@pytest.mark.skipif(not Path(mixing.TOKENIZER_FOLDER).exists(), reason="no tokenizer files")
def test_mix_holds_the_tokens(spark):
    docs = [(i, f"Speech {i} of the day, " * (i % 30), "one" if i % 3 else "two") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("one", 0.5, 1), ("two", 0.5, 3)], "source string, target_share double, max_repeats int")
    ids = {r["doc_id"]: r["tokens"] for r in mixing.token_ids(df).collect()}
    mixed, blocks = mixing.mix(df, targets, block_tokens=16, shard_slots=8)
    assert "tokens" in mixed.columns and mixed.count()
    for r in [*mixed.collect(), *blocks.collect()]:
        assert r["tokens"] == [x for p in r["pieces"] for x in ids[p["doc_id"]][p["from_token"] : p["to_token"]]] and len(r["tokens"]) == r["n_tokens"]
    assert sum(len(r["tokens"]) for r in blocks.collect()) == sum(map(len, ids.values()))
    last = {r["source"]: r["b"] for r in blocks.groupBy("source").agg({"block": "max"}).toDF("source", "b").collect()}
    assert all(len(r["tokens"]) == 16 for r in mixed.collect() if r["block"] < last[r["source"]])


SPEECH = ["The committee has reviewed the new tariff, because a deadline was missed.", "Of the 40 letters I received, most say that the treasury delayed the seed bank.", "I call the next speaker on the list.", "The ministry tells pensioners to enable JavaScript, as if that were a policy.", "The form asks for {date} in curly brackets, a farmer told me.", "The portal answered error 503, said the auditor of the house."]
RESIDUE = ["Please enable JavaScript to read this page.", "404 Not Found.", "As {{ speaker }} told this house, we agree.", "Lorem ipsum dolor sit amet magna aliqua.", "TBD.", "xxxx xxx xxxxx xx.", "[INSERT PARTY].", "Connection timed out.", "Access denied."]


def test_residue(spark):
    rng = random.Random(1)
    docs = []
    for i in range(240):
        body = [rng.choice(SPEECH) for _ in range(4)]
        if i % 4 == 0:
            body[rng.randrange(4)] = RESIDUE[i // 4 % len(RESIDUE)]
        docs.append((i, "Anna Falk (Greens): " + body[0] + ("\n" if i % 8 else " ") + "\n".join(body[1:]), "Plenary" if i % 2 else "upper house", "Item 3"))
    docs += [(800, None, None, None), (801, "", "x", None), (802, "word " * 20_000, None, None), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, agenda_item string")
    model = residue.train(df)
    got = {r["doc_id"] for r in residue.residue(df, model).collect()}
    want = {i for i in range(0, 240, 4)}
    assert want - {i for i in want if i % 8 == 0} <= got <= want | {802}
    assert len(want - got) <= 3
    tp, fp, fn, tn = np.array([x[1:] for x in residue.validation(df)]).sum(0)
    assert tp > 0 and (tp + tn) / (tp + fp + fn + tn) >= 0.9
    assert residue.residue(df.limit(0), residue.train(df.limit(0))).count() == 0
    # the classifier alone decides: without its weights nothing is found, and without stock phrases in a text it still is
    assert residue.residue(df, residue.Model(0 * model.weights, -5.0, model.threshold)).count() == 0
    new = [(1, "Read timed connection request.", None, None), (2, "{{ " + "a" * 90 + " }}", None, None), (3, SPEECH[0], None, None)]
    assert not residue.trigger(new[0][1])
    assert {r["doc_id"] for r in residue.residue(spark.createDataFrame(new, "doc_id long, text string, source string, agenda_item string"), model).collect()} == {1, 2}


DOCUMENTS = Path("/root/testdata/sf0.1/documents.parquet")


@pytest.mark.skipif(not DOCUMENTS.exists(), reason="no test tables")
def test_residue_wording_never_seen():
    """Positives grouped by wording (digits and placeholder names aside); of the groups kept from the
    classifier at least nine in ten are found, and notices longer than any weak label are."""
    import re
    import zlib

    import pyarrow.parquet as pq

    seen, unseen, negative = [], [], []
    for n, (text, title) in enumerate(zip(*(c.to_pylist() for c in pq.read_table(DOCUMENTS, columns=["text", "agenda_item"]).columns))):
        if not text or n >= 2500 and not (residue.has_placeholder(text) or residue.trigger(text) or "lorem" in text.lower()):
            continue
        for k, s in enumerate(residue.segments(text)):
            label = residue.weak_label(s)
            if label:
                group = re.sub(r"\d+", "0", residue.PLACEHOLDER.sub("{}", s.lower()))
                (unseen if zlib.crc32(group.encode()) % 5 == 0 else seen).append((s, title, k == 0))
            elif label == 0:
                negative.append((s, title, k == 0))
    model = residue.fit(seen + negative, [1] * len(seen) + [0] * len(negative))
    assert len(unseen) > 30 and (model.scores(unseen) >= 0.5).mean() >= 0.9
    assert (model.scores(negative) >= 0.5).mean() < 0.005  # the threshold in use is chosen higher
    notice = "The page you are looking for could not be found because it was moved or deleted by the web editors last week"
    assert residue.weak_label(notice) is None and model.scores([(notice, None, True)])[0] >= 0.5
