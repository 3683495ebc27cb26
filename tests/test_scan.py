import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators.scan import day_of, scan


def test_against_plain_windows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randrange(0, 9 * 86_400_000), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t long, id long, v long").withColumn("day", day_of("t"))
    kinds = {"row_number": "row_number", "s": "sum", "sb": "sum_before", "mx": "max", "la": "last", "lb": "last_before", "lg": "lag", "ca": "count_all", "ma": "max_all", "sa": "sum_all"}
    got = scan(df, ["k"], "day", ["t", "id"], {n: (k, "v") for n, k in kinds.items()})
    w = Window.partitionBy("k").orderBy("t", "id")
    up, prior, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k")
    want = df.select(
        "*", F.row_number().over(w).alias("row_number"), F.sum("v").over(up).alias("s"), F.sum("v").over(prior).alias("sb"), F.max("v").over(up).alias("mx"), F.last("v", True).over(up).alias("la"),
        F.last("v", True).over(prior).alias("lb"), F.lag("v").over(w).alias("lg"), F.count("*").over(whole).alias("ca"), F.max("v").over(whole).alias("ma"), F.sum("v").over(whole).alias("sa"),
    )
    order = ["id", *kinds]
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select(order).collect()), key=key) == sorted(map(tuple, want.select(order).collect()), key=key)
    assert scan(df.limit(0), ["k"], "day", ["t"], {"n": ("row_number", "")}).count() == 0
