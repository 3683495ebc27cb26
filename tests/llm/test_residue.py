import random

import numpy as np

from threadloom.llm import residue

SPEECH = ["We vote on the ferry subsidy number {n} after the summer.", "The auditors found {n} cases in the river towns.", "He said the page {n} was not found, and the house laughed about it."]
RESIDUE = ["Error {n}: page not found.", "Lorem ipsum dolor sit amet {n}.", "As {{{{ name_{n} }}}} told us.", "Please enable JavaScript."]
SHAPE = "doc_id long, text string, source string, agenda_item string"


def corpus(n):
    rng = random.Random(3)
    return [(i, (RESIDUE[i // 50 % 4] if i % 50 == 0 else rng.choice(SPEECH)).format(n=rng.randrange(1000)), f"House {i % 7}", "Ferry") for i in range(n)]


def test_every_segment_is_learnt_from(spark):
    """More documents and negatives than were once sampled: all are counted, and the weights are those of
    a fit on all rows at once."""
    docs = corpus(22_000)
    items = [(s, title, k == 0) for _, text, _, title in docs for k, s in enumerate(residue.segments(text))]
    labels = [residue.weak_label(s) for s, _, _ in items]
    rows = [(x, y) for x, y in zip(items, labels) if y is not None]
    df = spark.createDataFrame(docs, SHAPE)
    learned = residue.learn(df)
    assert sum(n for *_, n in learned.counts) == len(rows) > 21_000
    assert sum(n for _, y, _, n in learned.counts if y) == sum(y for _, y in rows)
    alone = residue.fit([x for x, _ in rows], [y for _, y in rows])
    assert (learned.model.weights == alone.weights).all() and learned.model.bias == alone.bias
    other = residue.learn(df.repartition(5))
    assert (other.model.weights == alone.weights).all() and sorted(other.counts) == sorted(learned.counts) and other.model.threshold == learned.model.threshold


def test_found(spark):
    docs = corpus(600)
    docs += [(None, RESIDUE[0], "x", None), (900, None, None, None), (901, "", "x", None), docs[50]]
    df = spark.createDataFrame(docs, SHAPE)
    got = [r["doc_id"] for r in residue.found(df).collect()]
    assert sorted(got) == list(range(0, 600, 50))
    assert {r["doc_id"] for r in residue.residue(df, residue.train(df)).collect()} == set(got)
    assert residue.found(df.limit(0)).count() == 0
    assert residue.found(df.where("doc_id % 50 = 1")).count() == 0  # no positive at all


def test_sums_of_many_partitions(spark):
    parts = spark.range(0, 70, 1, 70).select("id").mapInArrow(lambda b: (x.from_arrays([[residue._squeeze(np.array([i, 1], np.int64)) for i in x.column(0).to_pylist()]], names=["sums"]) for x in b), "sums binary")
    assert parts.rdd.getNumPartitions() > residue.DIRECT
    assert residue._total(parts).tolist() == [69 * 35, 70]


def test_labels_that_need_no_asking_are_0():
    rng = random.Random(5)
    words = ["the", "A", "xx", "bbb", "lorem", "dolor", "{x}", "[[a b]]", "404", "not found", "1", "_", "né", "İ", "TBD", "n/a", "error", "foo", "foo", "<<b c>>", "%%ab%%", ". ", "-", "ÄÄ", "cannot load", "faux texte", "script", "enable"]
    texts = [" ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))).split()) for _ in range(8000)]
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        doubtful = residue.features([(s, None, False) for s in some])[3]
        assert [s for s, d in zip(some, doubtful) if not d and residue.weak_label(s) != 0] == []
