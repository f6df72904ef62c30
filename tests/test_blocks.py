import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import blocks, text


def vectors(n: int) -> dict[int, dict[str, float]]:
    g = random.Random(5)
    return {i: {t: g.random() + 0.1 for t in g.sample("abcdefghijkl", g.randint(1, 4))} for i in range(n)}


def cosine(a: dict, b: dict) -> float:
    return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 8)  # several blocks of few vectors


def rows(spark, v):
    return spark.createDataFrame([(i, t, w) for i, d in v.items() for t, w in d.items()], "id long, term string, weight double")


def test_pairs_over_several_blocks_and_no_row_for_others(spark, small):
    v = vectors(60)
    df = text.cosine_pairs(rows(spark, v), 0.4)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # vectors meet as blocks, not by their terms
    got = {(r.i, r.j): r.cosine for r in df.collect()}
    want = {(i, j): c for i, j in itertools.combinations(v, 2) if (c := cosine(v[i], v[j])) >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sums_and_best_over_several_blocks(spark, small):
    v = vectors(50)
    d = blocks.unit_vectors(rows(spark, v)).withColumn("clusters", F.array(F.col("id") % 3, F.lit(7).cast("long"))).withColumn("counts", F.array(F.lit(2).cast("long"), F.lit(1).cast("long")))
    whole = lambda x: (x >= 0.3) * (x * 1000).round()
    got = {(r.x, r.c): r.s for r in blocks.met(d, blocks.sums_by(whole, 1000), "x bigint, c bigint, s bigint").groupBy("x", "c").agg(F.sum("s").alias("s")).collect()}
    want: dict = {}
    for i, j in itertools.product(v, v):
        s = 1000 if i == j else round(cosine(v[i], v[j]) * 1000) if cosine(v[i], v[j]) >= 0.3 else 0
        for c, n in ((j % 3, 2), (7, 1)):
            want[i, c] = want.get((i, c), 0) + s * n
    assert got == {k: s for k, s in want.items() if s}
    best = blocks.met(d, blocks.best_by(lambda x, a, b, at: x), "x bigint, v double, y bigint").groupBy("x").agg(F.max(F.struct(F.round("v", 9), (-F.col("y")).alias("y"))).alias("b"))
    assert {r.x: -r.b.y for r in best.collect()} == {i: max((round(cosine(v[i], v[j]), 9), -j) for j in v if j != i)[1] * -1 for i in v}
