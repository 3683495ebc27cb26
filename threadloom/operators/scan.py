"""Ordered scans over a key without a task per key.

A session may hold a third of all rows, so a window over a whole session would put them into one
task. Rows carry a bucket that rises with their order (here: the day). The scan runs in windows of
(key, bucket) and over one small row per key and bucket, and the two are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day_of(t: str | Column) -> Column:
    """The bucket of a time in milliseconds; null times fall into day 0."""
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(F.coalesce(t, F.lit(0)) / DAY_MS)


def scan(rows: DataFrame, key: list[str], bucket: str, order: list, adds: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """``rows`` with one column per entry of ``adds``: name -> (kind, expression).

    Kinds, all in the order of ``order`` within ``key``:
    row_number (expression unused), sum, max, last (last value that is not null), each including the row
    itself; sum_before, last_before and lag without it; count_all, max_all, sum_all over the whole key.
    ``bucket`` must not fall as the order rises. Null keys are a group of their own.
    """
    inner = Window.partitionBy(*key, bucket).orderBy(*order)
    upto, prior = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    exprs = {n: (k, F.lit(1) if k in ("row_number", "count_all") else F.col(e) if isinstance(e, str) else e) for n, (k, e) in adds.items()}
    rows = rows.select("*", *[e.alias(f"__e_{n}") for n, (_, e) in exprs.items()])
    totals = rows.groupBy(*key, bucket).agg(
        *[
            {
                "row_number": F.count("*"), "count_all": F.count("*"), "sum": F.sum(f"__e_{n}"), "sum_before": F.sum(f"__e_{n}"), "sum_all": F.sum(f"__e_{n}"), "max": F.max(f"__e_{n}"), "max_all": F.max(f"__e_{n}"),
                "last": F.max_by(F.struct(f"__e_{n}"), F.when(F.col(f"__e_{n}").isNotNull(), F.struct(*order))),
                "last_before": F.max_by(F.struct(f"__e_{n}"), F.when(F.col(f"__e_{n}").isNotNull(), F.struct(*order))),
                "lag": F.max_by(F.struct(f"__e_{n}"), F.struct(*order)),
            }[k].alias(f"__t_{n}")
            for n, (k, _) in exprs.items()
        ]
    )
    over = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    lagged = Window.partitionBy(*key).orderBy(bucket)
    carried = []
    for n, (k, _) in exprs.items():
        t = F.col(f"__t_{n}")
        carried.append(
            {
                "row_number": lambda: F.coalesce(F.sum(t).over(over), F.lit(0)), "sum": lambda: F.sum(t).over(over), "sum_before": lambda: F.sum(t).over(over), "max": lambda: F.max(t).over(over),
                "last": lambda: F.last(t, ignorenulls=True).over(over), "last_before": lambda: F.last(t, ignorenulls=True).over(over), "lag": lambda: F.lag(t).over(lagged),
                "count_all": lambda: F.sum(t).over(whole), "sum_all": lambda: F.sum(t).over(whole), "max_all": lambda: F.max(t).over(whole),
            }[k]().alias(f"__c_{n}")
        )
    before = totals.select(*[F.col(k).alias(f"__k_{k}") for k in [*key, bucket]], *carried)
    local = []
    for n, (k, _) in exprs.items():
        e = F.col(f"__e_{n}")
        local.append(
            {
                "row_number": lambda: F.row_number().over(inner), "sum": lambda: F.sum(e).over(upto), "sum_before": lambda: F.sum(e).over(prior), "max": lambda: F.max(e).over(upto),
                "last": lambda: F.last(e, ignorenulls=True).over(upto), "last_before": lambda: F.last(e, ignorenulls=True).over(prior), "lag": lambda: F.lag(F.struct(e.alias(f"__e_{n}"))).over(inner),
            }.get(k, lambda: F.lit(None))().alias(f"__l_{n}")
        )
    on = F.lit(True)
    for k in [*key, bucket]:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = rows.select("*", *local).join(before, on)
    done = []
    for n, (k, _) in exprs.items():
        inside, past = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        done.append(
            {
                "row_number": lambda: inside + past,
                "sum": lambda: F.coalesce(inside + past, inside, past), "sum_before": lambda: F.coalesce(inside + past, inside, past),
                "max": lambda: F.greatest(inside, past), "last": lambda: F.coalesce(inside, past[f"__e_{n}"]), "last_before": lambda: F.coalesce(inside, past[f"__e_{n}"]),
                "lag": lambda: F.coalesce(inside, past),
                "count_all": lambda: past, "sum_all": lambda: past, "max_all": lambda: past,
            }[k]().alias(n)
        )
    kept = [c for c in rows.columns if not c.startswith("__")]
    out = joined.select(*kept, *done)
    for n, (k, _) in exprs.items():
        if k == "lag":
            out = out.withColumn(n, F.col(n)[f"__e_{n}"])
    return out
