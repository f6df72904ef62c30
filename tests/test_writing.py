"""Keywords in copy, edits and Markdown against plain scans, an exact alignment and hand-made cases."""

import random
import re

import pytest
from oracle import same
from pyspark.sql import functions as F

from marlstone.operators import writing

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(writing.ORACLE_SQL))
def test_query_matches_sql_on_more_documents(spark, name):
    same(writing.QUERIES[name](spark, SF01), writing.ORACLE_SQL[name], SF01)


def stems(s):
    words = re.sub(r"[^a-z0-9\s]", " ", (s or "").lower()).split()
    return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words]


def plain_uses(text, phrases, window=8):
    words, sets = stems(text), [[w for w in stems(p) if w not in writing.STOP] for p in phrases]
    counts, i = [0] * len(sets), 0
    while i < len(words):
        part = words[i : i + window]
        hit = next((k for k, s in enumerate(sets) if s and all(w in part for w in s)), None)
        if hit is None:
            i += 1
        else:
            counts[hit] += 1
            i += max(part.index(w) for w in sets[hit]) + 1
    return counts


def test_uses_equal_a_plain_scan(spark):
    g = random.Random(5)
    pool = "roof roofs repair Repairs cost of the in boston a-b glass".split()
    texts = [None, "", "the of", *[" ".join(g.choice(pool) for _ in range(g.randint(1, 40))) for _ in range(200)]]
    phrases = [["roof repair", "cost in boston"], ["the", "roof"], [], ["roof roof", "boston the roof cost"]]
    rows = [(k, t, p) for k, t in enumerate(texts) for p in phrases]
    d = spark.createDataFrame(rows, "id long, text string, phrases array<string>").withColumn("w", F.lit(0))
    got = {(r.id, tuple(r.phrases)): (r.counts, r.total, r.matched) for r in writing.close_variants(d, "text", "phrases").collect()}
    for k, t, p in rows:
        counts = plain_uses(t, p)
        have = set(stems(t))
        first = next((x for x in p if (own := [w for w in stems(x) if w not in writing.STOP]) and set(own) <= have), None)
        assert got[k, tuple(p)] == (counts, sum(counts), first), (t, p)


def test_forced_phrases_questions_and_asks(spark):
    rows = [
        (1, "We discuss Aligner cost Boston, and Boston Veneers. Aligner in Boston. Boston, Aligner", "Boston", "", ["cost Boston", "Boston Veneers"]),
        (2, "Bright Dental Boston and bright dental of boston and dental  Boston and Dental\nBoston", "Boston", "Bright Dental", ["dental Boston", "Dental Boston"]),
        (3, "cost St. Paul? costs St. Paul", "St. Paul", None, ["cost St. Paul", "costs St. Paul"]),
        (4, "cost Boston", "", "", []), (5, None, "Boston", "", []), (6, "accost Boston, cost Bostonia", "Boston", "", []),
    ]
    d = spark.createDataFrame([r[:4] for r in rows], "id long, text string, city string, brand string")
    phrases = F.array(F.lit("aligner cost in Boston"), F.lit("veneer dental"))
    got = {r.id: r.f for r in d.select("id", writing.forced(F.col("text"), phrases, F.col("city"), F.col("brand")).alias("f")).collect()}
    assert got == {r[0]: r[4] for r in rows}
    assert spark.range(1).select(writing.forced(F.lit("cost Boston"), F.array(F.lit("in Boston"), F.lit("")), F.lit("Boston"), F.lit("")).alias("f")).first().f == []
    asked = [("Does it hurt in Quincy?", True), ("Do you offer it in Quincy, and is it safe?", False), ("Does it hurt?", False), ("Who should have it in QUINCY", True), ("Is it safe in Quincyville?", False), (None, False)]
    d = spark.createDataFrame(asked, "q string, want boolean")
    assert all(r.got == r.want for r in d.select("want", writing.decorated_question(F.col("q"), F.lit("Quincy")).alias("got")).collect())
    asks = [("We mend roofs. Book online today!", True), ("Book today. We mend roofs.", False), ("Our team schedules visits.", False), ("We help, call us", True), ("", False), (None, False)]
    d = spark.createDataFrame(asks, "s string, want boolean")
    assert all(r.got == r.want for r in d.select("want", writing.closes_with_ask(F.col("s")).alias("got")).collect())
    near = [("anxiety care in Anaheim Hills", "anxiety treatment in anaheim hills", True), ("hills", "anaheim hills", True), ("x", "hill", False), ("a hill", "hills", True), ("care", "anaheim hills care", False), ("x", "the", False)]
    d = spark.createDataFrame(near, "t string, p string, want boolean")
    assert all(r.got == r.want for r in d.select("want", writing.all_but_one(F.col("t"), F.col("p")).alias("got")).collect())


ORIGINAL = "# The heading of an old article\nThe first sentence is long enough to count. The second one, too, has many letters.\n- an item that is long enough to count\nShort."


def test_guards(spark):
    edits = {
        "same": ORIGINAL, "marked": ORIGINAL + "\n[NEW]Something that nobody has ever read or written before.[/NEW]", "lost": ORIGINAL.replace("The second one, too, has many letters.", ""), "slipped": ORIGINAL + "\nSomething that nobody has ever read or written before.",
        "restated": ORIGINAL + " [NEW]The first sentence, is long enough to count![/NEW] [NEW]- the first sentence is long enough to count[/NEW]", "echo": "Mark every insertion", "none": None,
    }
    d = spark.createDataFrame([(k, ORIGINAL, e) for k, e in edits.items()] + [("both", None, None), ("prose", "word " * 12, "x")], "id string, original string, edited string").withColumn("lost", F.lit("clash"))
    got = {r.id: r for r in writing.guards(d, "original", "edited").collect()}
    flags = {k: (r.preserved, r.honest, r.redundant) for k, r in got.items()}
    assert flags == {"same": (True, True, 0), "marked": (True, True, 0), "lost": (False, True, 0), "slipped": (True, False, 0), "restated": (True, True, 1), "echo": (False, True, 0), "none": (False, True, 0), "both": (True, True, 0), "prose": (False, True, 0)}
    assert got["lost"].lost == 0.25 and got["slipped"].foreign == 1 / 3 and got["echo"].echo and not got["same"].echo
    assert got["restated"].cleaned == ORIGINAL + "  [NEW]- the first sentence is long enough to count[/NEW]"
    assert (got["same"].substantive, got["prose"].substantive, got["both"].substantive) == (True, True, False)


def common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_keeps_order_and_is_longest():
    g = random.Random(2)
    for _ in range(400):
        unique = g.random() < 0.5
        pool = [f"block {i}" for i in range(30)] if unique else ["x", "y", "z"]
        a, b = (g.sample(pool, g.randint(0, 20)) if unique else g.choices(pool, k=g.randint(0, 12)) for _ in range(2))
        found = writing.anchors(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(found) <= common(a, b) and (not unique or len(found) == common(a, b))
        assert writing.anchors(a, a) == [(i, i) for i in range(len(a))]
        marked = [g.random() < 0.3 for _ in b]
        changes = writing.aligned(a, b, marked)
        assert sorted(c["original"] for c in changes if c["original"] is not None) == list(range(len(a)))
        assert sorted(c["edited"] for c in changes if c["edited"] is not None) == list(range(len(b)))


def test_block_changes(spark):
    edited = "# The heading of an old article\n[NEW]All new.[/NEW] The first sentence is long enough to matter. And this.\n[NEW]\n- an item\n- two\n[/NEW]- an item that is long enough to count\nShort."
    d = spark.createDataFrame([(1, ORIGINAL, edited), (2, None, None), (3, "Gone.", ""), (3, "", "[NEW]N")], "id long, original string, edited string").withColumn("kind", F.lit(0))
    got = {}
    for r in writing.block_changes(d, "id", "original", "edited").collect():
        got.setdefault(r.id, []).append((r.kind, r.original, r.edited))
    assert sorted(got[1], key=str) == sorted([("kept", 0, 0), ("marked", None, 1), ("changed", 1, 2), ("lost", 2, None), ("unmarked", None, 3), ("marked", None, 4), ("marked", None, 5), ("kept", 3, 6), ("kept", 4, 7)], key=str)
    assert 2 not in got and sorted(got[3], key=str) == [("lost", 0, None), ("unmarked", None, 0)]


def test_content_scores(spark):
    answer = "A roof lasts for forty years. It must be looked after."
    rows = {
        "none": (None, (0, 0, 0, 0, 0, 0)),
        "answer": (answer, (15, 0, 5, 0, 0, 10)),  # opens at once, two sentences, short ones
        "filler": ("Welcome to the roof. It leaks.", (11, 0, 5, 0, 0, 10)),
        "late": ("# " + "word " * 75 + "\n" + answer, (12, 0, 5, 0, 0, 10)),  # 76 words in: half of 6
        "long": ("One " + "word " * 39 + "ends.", (10, 0, 5, 0, 0, 0)),  # one sentence of 41 words
        "evidence": (answer + ' Some 45% and 1,200 of them. According to all (Smith and sons, 2020). "A quotation of more than a few letters."', (10, 10 + 8 + 4, 5, 0, 0, 10)),
        "lists": (answer + "\n- a\n* b\n1. c\n2) d\n|a|b|\n|-|-|\n|1|2|\n\n|c|\n> quote\n---", (15, 0, 7 + 7 + 5, 0, 0, 10)),
        "structure": (answer + "\n## A\n" + "word " * 100 + "\n### B\n## C\nx", (15, 0, 5, 8 + 4 + 5, 0, 0)),  # of two sections one is thin
        "faq": (answer + "\n## FAQ\n### Why?\n### How\n### When?\n## Other?\n", (15, 0, 5, 4 + 0 + 5, 4 + 2, 10)),
        "new": ("[NEW]" + answer + "[/NEW]", (15, 0, 5, 0, 0, 10)),
    }
    d = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "id string, text string").withColumn("lines", F.lit("clash"))
    got = {r.id: r for r in writing.content_scores(d, "text").collect()}
    dims = {k: tuple(got[k][c] for c in writing.DIMENSIONS) for k in rows}
    for k, (_, want) in rows.items():
        if k not in ("structure", "faq"):
            assert dims[k] == want, k
    assert dims["structure"][3] == 8 + 4 + 5 and dims["faq"][3:5] == (8 + 0 + 5, 4 + 2)
    assert got["answer"].total == 30 and got["answer"].grade == "Poor" and got["evidence"].grade == "Weak"
