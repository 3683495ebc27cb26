from datetime import datetime as dt

from threadloom.operators import references as r

P = "parent_table string, parent_key string, deleted boolean, seen_at timestamp_ntz"
C = "parent_table string, parent_key string, taken_at timestamp_ntz, period string, deleted string"


def test_reasons(spark):
    parents = spark.createDataFrame(
        [("m", "a", False, dt(2025, 1, 1)), ("m", "a", False, dt(2025, 3, 1)), ("m", "b", True, dt(2025, 5, 1)), ("m", "c", None, dt(2025, 2, 1)), ("n", "z", False, dt(2025, 1, 1)), ("m", None, False, None)], P
    )
    refs = spark.createDataFrame(
        [("m", k, dt(2025, 1, 15), "2025-01", "clash") for k in ("a", "b", "c", "z", "z", None)] + [("m", "c", dt(2025, 2, 2), "2025-02", ""), ("m", "c", None, "", "")], C
    )
    found = r.orphans(parents, refs)
    got = sorted((x["parent_key"], x["period"], x["reason"]) for x in found.collect())
    assert got == [("b", "2025-01", "deleted"), ("c", "2025-01", "late"), ("z", "2025-01", "missing"), ("z", "2025-01", "missing")]
    report = {(x["reason"], x["period"]): (x["n_references"], x["n_keys"]) for x in r.orphan_report(found, "period").collect()}
    assert report[("missing", "2025-01")] == (2, 1)


def test_empty(spark):
    parents, refs = spark.createDataFrame([], P), spark.createDataFrame([("m", "a", dt(2025, 1, 1), "p", "")], C).drop("deleted")
    assert [x["reason"] for x in r.orphans(parents, refs).collect()] == ["missing"]
    assert r.orphans(parents, refs.limit(0)).count() == 0
