"""Running values over groups of any size, against one group at a time."""

import random

from pyspark.sql import functions as F

from marlstone.functions.running import running


def test_hot_null_and_small_groups(spark):
    g = random.Random(1)
    rows = [(g.choice(["hot", "hot", "hot", "b", None, "c"]), g.randint(0, 50), i, g.choice([None, g.randint(-5, 5)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").withColumn("at", F.lit("clash")).repartition(7)
    got = {r.i: (r.n, r.s, r["last"]) for r in running(df, ["k"], [F.desc("t"), F.col("i")], {"n": ("count", None), "s": ("sum", F.col("v")), "last": ("last", F.col("v"))}).collect()}
    want, seen = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        n, s, last = seen.get(k, (0, None, None))
        seen[k] = want[i] = (n + 1, s if v is None else (s or 0) + v, last if v is None else v)
    assert got == want
    assert running(df.limit(0), ["k"], [F.col("i")], {"n": ("count", None)}).count() == 0
