"""Search and compression of vectors, and fill-in-the-middle, against plain versions and on edge rows."""

import hashlib
import re

import numpy as np
import pytest
from conftest import SF
from oracle import same
from pyspark.sql import functions as F

from marlstone.llm import infill, lloyd, mtree, queries, vectors

NEW = ("op11_mtree_topk", "op12_filtering_lloyd", "op13_infill_rank_select")


@pytest.mark.parametrize("name", NEW)
def test_query_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def table(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    return df.withColumn("row", F.lit("clash")).withColumn("vec", F.lit(1)).withColumn("id", F.lit(None).cast("string")).withColumn("error", F.lit(2.0))


def floors(v, length, scale=256):
    x = [min(max(int(np.floor(float(c) * scale)), -(2**63)), 2**63 - 1) if abs(float(c)) < 1e300 else (2**63 - 1 if c > 0 else -(2**63)) for c in v]
    return x + [0] * (length - len(x))


def kept(rows, multiple=1):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    length = max([len(r[1]) for r in rows], default=0)
    length = -(-length // multiple) * multiple
    return [(i, floors(v, length), label) for i, v, label in rows]


def plain_top(rows, k=5, every=50):
    rows, out = kept(rows), []
    for a, (q, v, _) in enumerate(rows):
        if q is None or q % every:
            continue
        scores = [(-min(max(sum(x * y for x, y in zip(v, w)), -(2**63) + 1), 2**63 - 1), i is None, i or 0, b) for b, (i, w, _) in enumerate(rows) if b != a]
        out += [(q, rank + 1, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def plain_codes(rows, rounds=2, parts=16, entries=64):
    rows = kept(rows, parts)
    cut = lambda v: [tuple(v[k * len(v) // parts : (k + 1) * len(v) // parts]) for k in range(parts)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in first))]
    off = lambda p, z: sum((x - y) ** 2 for x, y in zip(p, z))
    code = lambda v: [min(range(len(b)), key=lambda e: (off(p, b[e]), e)) for p, b in zip(cut(v), books)]
    for _ in range(rounds):
        of = [code(v) for _, v, _ in rows]
        for k in range(parts):
            for e in range(len(books[k])):
                own = [cut(v)[k] for (_, v, _), c in zip(rows, of) if c[k] == e]
                if own:
                    books[k][e] = tuple(sum(c) // len(own) for c in zip(*own))
    codes = [code(v) for _, v, _ in rows]
    errors = [min(sum(off(p, b[e]) for p, b, e in zip(cut(v), books, c)), 2**63 - 1) for (_, v, _), c in zip(rows, codes)]
    labels = {}
    for (_, _, label), e in zip(rows, errors):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for z in b for x in z).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for e in c), e, min(labels[label], 2**63 - 1), digest) for (i, _, label), c, e in zip(rows, codes, errors)], key=str)


def clustered(n, length, seed, groups=7):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(groups, length))
    x = centres[g.integers(0, groups, n)] + 0.05 * g.normal(size=(n, length))
    x[: n // 3] = x[0]  # a third of all rows are equal
    return [(i, v.tolist(), int(g.integers(0, 3)) if i % 5 else None) for i, v in enumerate(x)]


EDGES = [
    (0, None, 1), (50, [1.0, None], 1), (100, [float("nan"), 1.0], 1), (150, [float("inf"), 1.0], 1), (200, [0.5, -0.25, 0.001], 1), (200, [0.5, -0.25, 0.001], None),
    (None, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 2), (250, [], 2), (-50, [1.0, 1.0, 1.0], 2), (7, [1.0, 1.0, 1.0], 2), (3, [-0.0, 0.0, 0.0], 2),
]
HUGE = [(0, [1e30, -1e30], 1), (50, [3e9, 2.5e9], 1), (2, [-1e300, 1e300], None), (3, [1.0, 2.0], 1), (4, [1.7e308, 1.7e308], 1)]


@pytest.mark.parametrize("rows", [EDGES, HUGE, EDGES[:4], EDGES[8:9], []], ids=["edges", "huge", "none take part", "one", "empty"])
def test_edge_vectors(spark, rows):
    df = table(spark, rows)
    got = sorted([tuple(r) for r in mtree.top_k(df, F.col("id") % 50 == 0, 5).collect()], key=str)
    assert got == plain_top(rows)
    got = sorted([tuple(r[c] for c in ("id", "code", "error", "label_error", "codebooks_sha256")) for r in lloyd.product_codes(df).collect()], key=str)
    assert got == (plain_codes(rows) if kept(rows) else [])


def test_many_pages_shards_and_blocks(spark, monkeypatch):
    for name, value in (("PAGE", 4), ("FAN", 3), ("PIVOTS", 6), ("LEAST", 20), ("MOST", 40), ("PARTS", 4), ("BLOCK", 7)):
        monkeypatch.setattr(mtree, name, value)
    rows = clustered(600, 6, 1)
    got = sorted([tuple(r) for r in mtree.top_k(table(spark, rows).repartition(3), F.col("id") % 10 == 0, 3).collect()], key=str)
    want = plain_top(rows, 3, 10)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert got == want  # ties go to the smaller id, whichever shard it is in


def test_bounds_avoid_comparisons():
    rows = np.array([floors(v, 8) for _, v, _ in clustered(4000, 8, 2, groups=40)], np.int16)
    of = vectors.Shape(len(rows), 8, int(np.abs(rows).max()), float((rows.astype(float) ** 2).sum(1).max()))
    metric = mtree.Metric(of)
    tree, ids = mtree.Tree(rows, metric), np.arange(len(rows))
    covers = [metric.objects(tree.x[n["start"] : n["end"]], tree.x[n["centre"]][None]).max() <= n["radius"] + 1e-9 for n in tree.nodes]
    assert all(covers) and len(tree.nodes) > 50
    asked = np.arange(0, 4000, 100)
    best = mtree.Best(asked, np.full(len(asked), mtree.NONE), 5)
    compared = mtree.search(tree, tree.x[asked], best, mtree._ranks(ids, np.zeros(len(ids), bool), ids), ids)
    assert compared < 0.5 * len(asked) * len(rows)
    scores = tree.x[asked].astype(int) @ tree.x.T.astype(int)
    scores[np.arange(len(asked)), asked] = -(10**9)
    assert (np.sort(scores, 1)[:, ::-1][:, :5] == best.score).all()


def test_codes_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "CHUNK", 100)
    rows = clustered(900, 40, 3)
    got = sorted([tuple(r[c] for c in ("id", "code", "error", "label_error", "codebooks_sha256")) for r in lloyd.product_codes(table(spark, rows).repartition(3)).collect()], key=str)
    assert got == plain_codes(rows)


def test_subtrees_go_whole_and_sums_agree():
    g = np.random.default_rng(4)
    x = np.floor(g.normal(size=(3000, 32)) * 60).astype(np.int64)
    books = np.ascontiguousarray(x[:64].reshape(64, 16, 2).transpose(1, 0, 2))
    trees = lloyd.Trees.read(lloyd.Trees(x).stored("<i2"), np.int64)
    p = x.reshape(-1, 16, 2)
    near = ((p[:, :, None, :] - books[None]) ** 2).sum(3).argmin(2)
    code, error = trees.codes(books)
    assert (code == near).all() and (error == ((p - books[np.arange(16)[None], near]) ** 2).sum((1, 2))).all()
    number, total = trees.sums(books)
    assert number.sum() == 3000 * 16
    for k in (0, 15):
        assert all((total[k, e] == p[near[:, k] == e, k].sum(0)).all() and number[k, e] == (near[:, k] == e).sum() for e in range(64))
    whole = sum((trees.levels[level][2][part, node]).sum() for level, part, node, _ in trees.assigned(books) if level is not None)
    assert whole > 0.1 * 3000 * 16


TEXTS = [None, "", " ", "word", " two words \n\t", "é😀 日本\x1c\x85x Σ\x00 end", "has <P> mark", "a < S> <S", "\x0b\x0c\r x", "long " * 30_000, "x" * 100_000, "same text twice here", "same text twice here"]


def plain_infill(doc_id, text):
    text = text or ""
    k = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    r = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((r[0] % (len(k) + 1), r[1] % (len(k) + 1)))
    prefix, middle, suffix = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 50:
        form, out, sizes = "plain", text, (None, None)
    elif r[3] % 100 < 80:
        form, out, sizes = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (len(prefix), len(middle))
    else:
        form, out, sizes = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (len(prefix), len(middle))
    return (doc_id, len(k), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out)


def test_infill_matches_plain(spark):
    rows = [(None, t) for t in TEXTS] + [(i, TEXTS[i % len(TEXTS)]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit("x")).withColumn("form", F.lit(None).cast("int"))
    got = infill.infill(df)
    assert got.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_infill(*r)) for r in rows)
    assert {r["form"] for r in got.select("form").collect()} == {"plain", "psm", "spm"}
    assert infill.infill(df.limit(0)).count() == 0


def test_rank_and_select():
    g = np.random.default_rng(5)
    for n, share in ((0, 0.5), (1, 1.0), (63, 0.5), (512, 0.0), (5000, 0.01), (5000, 0.9)):
        flags = g.random(n) < share
        bits, ones = infill.Bits(flags), np.flatnonzero(flags)
        assert (bits.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
        assert (bits.select(np.arange(len(ones))) == ones).all()
