"""Best siblings write no sets and no candidates; runs are those of plain_words; turns meet all blocks once."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_blocks import rows, vectors

from marlstone.functions import runs
from marlstone.operators import blocks, topics
from marlstone.operators.text import plain_words, shingle_set


def test_what_siblings_write_is_small_beside_the_texts(spark, monkeypatch):
    g = random.Random(3)
    texts = [(i, " ".join(f"{g.getrandbits(40):x}" for _ in range(300)) + " one line that all have", "s") for i in range(400)]
    size = lambda path: sum(os.path.getsize(f) for f in glob.glob(path.removeprefix("file:") + "/*"))
    df, sizes, real = spark.createDataFrame(texts, "doc long, t string, source string"), [], topics.materialize

    def noted(d):
        table = real(d)
        sizes.append(sum(size(p) for p in {f.rsplit("/", 1)[0].replace("file://", "file:") for f in table.inputFiles()}))
        return table

    monkeypatch.setattr(topics, "materialize", noted)
    got = {r.id: (r.sibling, round(r.similarity, 9)) for r in topics.best_siblings(df, "doc", "source", F.col("t")).collect()}
    assert sizes and 0 < sum(sizes) < 0.25 * sum(len(t) for _, t, _ in texts)
    shared = round(3 / (2 * 303 - 3), 9)  # runs of the line, of 303 of each text
    assert got == {i: (0 if i else 1, shared) for i in range(400)}


def test_run_sets_are_those_of_plain_words(spark, monkeypatch):
    g = random.Random(6)
    texts = ["", "a b", "a b c", "A-b.C a b c", "é a b c é", "KK İx y z", "x" * 5000 + " y z", "a b c d e " * 50, "abc", "tail w", "ord in next"]
    texts += ["".join(g.choice("ab1 Zé.\n") for _ in range(g.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    words = df.select("id", F.lower("t").alias("t"), plain_words(F.col("t")).alias("w")).localCheckpoint()
    want = words.select("id", "t", F.size(shingle_set("w")).alias("n"), F.to_json(F.array_sort(shingle_set("w"))).alias("s")).orderBy("id").collect()
    for at_once in (runs.AT_ONCE, 40):
        monkeypatch.setattr(runs, "AT_ONCE", at_once)
        column = pa.array([None, *[r.t for r in want]])[1:]  # with an offset
        n, names = [], []
        for _, x, ends, classes in runs.run_sets(column, np.full(len(want), 5), 3):
            n += np.diff(ends).tolist()
            names += classes.tolist()
        assert n == [r.n for r in want]
        assert len(set(names)) == len({r.s for r in want}) == len(set(zip(names, (r.s for r in want))))


def test_lists_go_on_in_the_next_batch():
    x, c = [1, 1, 2, 2, 2, 3, 4, 4, 5, 5], [7, 7, 1, 7, 8, 1, 1, 7, 1, 7]
    for wide in (1, 3, 10):
        parts = [pa.record_batch({"x": pa.array(x[i : i + wide], pa.int64()), "class": pa.array(c[i : i + wide], pa.int64())}) for i in range(0, 10, wide)]
        got = pa.Table.from_batches(topics._shared(iter(parts))).to_pylist()
        assert [r["class"] for r in got] == [1, 7, 8, 1, 7, 1, 7]
        assert len({r["list"] for r in got[:3]}) == 1 and len({r["list"] for r in got[3:]}) == 1 and got[0]["list"] != got[3]["list"]


def test_turns_meet_every_two_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 8)
    d = blocks.unit_vectors(rows(spark, vectors(60))).localCheckpoint()
    pairs = lambda **how: sorted((r.i, r.j) for r in blocks.met(d, blocks.pairs_from(0.2), "i bigint, j bigint, v double", few=5, **how).collect())
    parts = blocks.turns(d, 2, few=5)
    assert parts == [(0, 2), (2, 4), (4, 5)] and blocks.turns(d.limit(0), 2) == []
    assert sorted(p for only in parts for p in pairs(only=only)) == pairs()
