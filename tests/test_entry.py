import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CORE = ["token_stats", "step_timeline", "recovery_by_distance", "dedup_latest", "message_refs", "blocks_active", "compressed_view", "decompress_diff", "range_selection", "p4_found", "p7_report"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    return str(v) if isinstance(v, list) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    cur = db.execute(entry.oracle_sql()[name])
    cols = sorted(c[0] for c in cur.description)
    assert sorted(df.columns) == cols
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
