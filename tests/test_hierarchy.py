import random
import sys
from pathlib import Path

import pytest

from threadloom.operators import hierarchy as h

sys.path.insert(0, str(Path(__file__).parent))
import test_entry  # noqa: E402

SCHEMA = "node string, parent string"


def rows(df):
    return {r["node"]: (r["root"], r["depth"], "/".join(r["path"])) for r in df.collect()}


def walk(links):
    out = {}
    for node in links:
        path, cur = [node], node
        while links.get(cur) in links and links[cur] not in path:
            cur = links[cur]
            path.insert(0, cur)
        looped = links.get(cur) in links
        out[node] = (None, -1, "") if looped else (path[0], len(path) - 1, "/".join(path))
    return out


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    for n in (1, 40, 120):
        ids = [f"n{i}" for i in range(n)]
        links = {i: rng.choice([None, "gone", *ids]) for i in ids}
        assert rows(h.resolve_hierarchy(spark.createDataFrame(list(links.items()), SCHEMA))) == walk(links)


def test_long_chain_and_self_link(spark):
    links = {f"c{i:04}": f"c{i - 1:04}" if i else None for i in range(150)} | {"self": "self", "below": "self"}
    assert rows(h.resolve_hierarchy(spark.createDataFrame(list(links.items()), SCHEMA))) == walk(links)


def test_empty(spark):
    assert h.resolve_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_latest_links(spark):
    df = spark.createDataFrame(
        [("a", " p ", 1, "x"), ("a", "q", 2, "x"), ("b", "  ", 1, "x"), (None, "p", 1, "x"), ("c", None, None, "x"), ("a", "q", 2, "x")], "id string, parent_id string, time_updated long, node string"
    )
    got = {r["node"]: r["parent"] for r in h.latest_links(df, "id", "parent_id", "time_updated").collect()}
    assert got == {"a": "q", "b": None, "c": None}


def test_descendants(spark):
    tree = h.resolve_hierarchy(spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")], SCHEMA))
    got = {r["node"]: (r["n_children"], r["n_descendants"], r["height"]) for r in h.descendant_counts(tree).collect()}
    assert got == {"r": (1, 2, 2), "a": (1, 1, 1), "b": (0, 0, 0)}


@pytest.mark.skipif(not test_entry.DATA.exists(), reason="no test tables")
def test_pairs_equal_sql(spark):
    test_entry.test_query_equals_sql(spark, "p4_pairs")


def test_roots_equal_the_paths(spark):
    import random

    rng = random.Random(6)
    rows = [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.95 else rng.choice([None, "nowhere"])) for i in range(300)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("self", "self")]
    rows += [(f"deep{i}", f"deep{i - 1}" if i else None) for i in range(70)]
    links = spark.createDataFrame(rows, "node string, parent string")
    got = {r["node"]: r["root"] for r in h.resolve_roots(links).collect()}
    assert got == {r["node"]: r["root"] for r in h.resolve_hierarchy(links).collect()} and got["d"] is None and got["deep69"] == "deep0"
    assert h.resolve_roots(links.limit(0)).count() == 0
