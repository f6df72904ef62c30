"""Small tables for branches that the landed data doesn't have."""

import importlib

from pyspark.sql import functions as F

from marlstone.functions import numbers, urls
from marlstone.operators import keywords, market, sites, store, text


def test_buckets_put_position_zero_on_page_two(spark):
    rows = spark.createDataFrame([("a", p) for p in (0, 1, 10, 11, 20, 21, 50, 51, 100, 101)], "domain string, position long")
    got = keywords.position_buckets(rows).first()
    assert (got.page1, got.page2, got.page3to5, got.page6to10, got.total) == (2, 3, 2, 2, 10)


def test_half_up_rounds_towards_plus_infinity(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.half_up(F.col("x"))).collect()] == [-2.0, 3.0, None]


def test_urls(spark):
    df = spark.createDataFrame([("HTTPS://WWW.Ab.co/x//?q#f",), ("http://h",), ("no scheme",), (None,)], "u string")
    got = [tuple(r) for r in df.select(urls.normalize_url(F.col("u")), urls.root_domain(F.col("u"))).collect()]
    assert got[:2] == [("https://www.ab.co/x", "ab.co"), ("http://h/", "h")]
    assert got[2][0] is None and got[3][0] is None


def test_shingles_of_short_texts_are_empty(spark):
    df = spark.createDataFrame([("a b",), ("a b c d a b c",), (None,)], "t string")
    rows = df.select(text.plain_words(F.col("t")).alias("w"))
    assert [len(r[0]) for r in rows.select(text.shingle_set("w")).collect()] == [0, 4, 0]
    dashed = spark.createDataFrame([("Foo-bar, it's 3.5%",)], "t string").select(text.plain_words(F.col("t"))).first()[0]
    assert dashed == ["foo", "bar", "it", "s", "3", "5"]


def test_item_in_a_long_document_is_paired(spark, tmp_path):
    item = " ".join(f"i{k}" for k in range(37))
    long = " ".join(f"d{k}" for k in range(4000))
    spark.createDataFrame([(1, f"{long} {item}"), (2, long)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in text.shingle_jaccard_benchmark(spark, str(tmp_path)).collect()]
    assert got == [(1, 7, 0.0087)]


def test_all_keywords_are_scored(spark):
    from conftest import SF

    rows = keywords.ranking(spark, SF)
    got = keywords.kw_composite_score(spark, SF).collect()
    assert len(got) == rows.select("keyword").distinct().count() > 100
    assert [(-r.score, r.keyword) for r in got] == sorted((-r.score, r.keyword) for r in got)


def test_scenarios_of_all_regions_are_compared(spark):
    from conftest import SF

    t = market.region_terms(spark, SF).collect()
    volume = {(r.geo, r.term): r.volume for r in t}
    got = {r.geo: (r.left_volume, r.right_volume) for r in market.scenario_diff(spark, SF).collect()}
    want = {g: (volume.get((g, "1-URGENT")), volume.get((g, "5-LOW"))) for g, term in volume if term in ("1-URGENT", "5-LOW")}
    assert got == want
    rows = spark.createDataFrame([(1, "a", 6), (1, "b", 5), (2, "a", 3), (3, "b", 1), (4, "c", 9)], "geo int, term string, volume long")
    got = {tuple(r) for r in market.term_diff(rows, "a", "b").collect()}
    assert got == {(1, 6, 5, -1, 5), (2, 3, None, None, 3), (3, None, 1, None, 1)}


def test_asof_takes_the_same_instant_and_nothing_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 3, "y")], "k int, t int, v string")
    got = {(r.k, r.t): r.asof_value for r in store.asof_backward(left, right, "k", "t", "v").collect()}
    assert got == {(1, 5): "x", (1, 1): None, (2, 9): None}


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "domain long, keyword long, volume long, position long")
    assert keywords.gap_bands(rows, 1).count() == 0 and keywords.detail_pivot(rows).count() == 0


def test_library_without_llm_imports():
    entry = importlib.import_module("__spark_entry__")
    assert "kw_gap_bands" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_links_of_pages(spark):
    rows = [
        (1, "https://a.co/", '<a href="/x/">x</a> <a class=b href="https://a.co/y?q#z">y</a> <a href="#top">t</a> <a href="https://b.co/">b</a>'),
        (2, "https://a.co/x", '<a href="/">home</a><a href="/">again</a><a href="/x">self</a>'),
        (3, "https://a.co/y", None), (4, "https://a.co/y", "<a href='/gone'>"), (5, None, "<a href='/'>"),
    ]
    got = {tuple(r) for r in sites.page_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, 2), (1, 4), (2, 1)}


def test_click_depth_stops_at_cycles_and_leaves_islands(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "node long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (6, 7), (4, 99)], "src long, dst long")
    got = {r.node: r.depth for r in sites.click_depth(nodes, edges, spark.createDataFrame([(2,), (2,), (50,)], "node long")).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 4: 3, 5: None, 6: None, 7: None}


def test_boost_counts_both_ways(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.9)], "i long, j long, similarity double")
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (2, 3), (3, 2), (4, 5)], "src long, dst long")
    got = {(r.i, r.j): round(r.similarity, 6) for r in sites.boosted(pairs, edges).collect()}
    assert got == {(1, 2): 0.86, (1, 3): 0.6, (2, 3): 1.0, (4, 5): 0.1}


def test_average_linkage_against_one_merge_at_a_time(spark):
    import random

    r = random.Random(4)
    n, least = 26, 0.3
    near = {(i, j): round(r.random() ** 2, 9) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
    near |= {(i, j): 0.6 + r.random() / 3 for i in range(5) for j in range(i + 1, 5)}
    groups = [[i] for i in range(n)]
    while True:
        mean = lambda a, b: sum(near.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / (len(a) * len(b))
        best = max(((mean(a, b), -a[0], -b[0], a, b) for k, a in enumerate(groups) for b in groups[k + 1 :]), key=lambda x: x[:3])
        if best[0] <= least:
            break
        groups = [g for g in groups if g not in best[3:]] + [sorted(best[3] + best[4])]
        groups.sort()
    pairs = spark.createDataFrame([(i, j, s) for (i, j), s in near.items()], "i long, j long, similarity double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    got = {}
    members = sites.average_linkage(nodes, pairs, least)
    for x in members.collect():
        got.setdefault(x.cluster, []).append(x.node)
    assert sorted(map(sorted, got.values())) == sorted(groups) and any(len(g) >= 3 for g in groups)
    small = {x.node for x in sites.sized_clusters(members).collect() if x.cluster is None}
    assert small == {x for g in groups if len(g) < 3 for x in g}


def test_cosine_pairs_against_all_pairs(spark):
    import math
    import random

    r = random.Random(2)
    docs = {i: {f"t{int(r.random() ** 2 * 30)}": r.random() for _ in range(r.randrange(1, 8))} for i in range(60)}
    norm = {i: math.sqrt(sum(w * w for w in d.values())) for i, d in docs.items()}
    rows = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "id long, term string, weight double")
    for least in (0.08, 0.5, 0.9):
        want = {(i, j): c for i in docs for j in docs if i < j and (c := sum(w * docs[j].get(t, 0) for t, w in docs[i].items()) / (norm[i] * norm[j])) >= least}
        got = {(x.i, x.j): x.cosine for x in text.cosine_pairs(rows, least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_even_sample_of_few_and_many(spark):
    rows = spark.range(7)
    assert sites.even_sample(rows, [F.col("id")], 10).count() == 7
    assert sorted(r.id for r in sites.even_sample(rows, [F.col("id")], 3).collect()) == [0, 2, 4]
    assert sites.even_sample(rows.limit(0), [F.col("id")], 3).count() == 0


def test_overrides_of_types_win(spark):
    pages = spark.createDataFrame([("/a", "/blog/x"), ("/b", "/blog/y"), ("/c", "/zz")], "template string, path string")
    own = spark.createDataFrame([("/b", "landing")], "template string, page_type string")
    got = {r.template: (r.page_type, r.type_source) for r in sites.typed(pages, F.col("path"), own).collect()}
    assert got == {"/a": ("blog", "rule"), "/b": ("landing", "override"), "/c": ("other", "default")}


def test_scores_of_present_parts_and_tiers(spark):
    rows = [(1, False, 5.0, 1.0, 0.2, "high"), (2, False, None, 2.0, 0.4, "low"), (3, True, 9.0, 3.0, 0.6, "high"), (4, False, 7.0, 3.0, 0.6, "insufficient")]
    df = spark.createDataFrame(rows, "geo int, is_home boolean, per_capita double, cpc double, competition double, confidence string")
    got = {r.geo: (r.percentile, r.score, r.tier) for r in market.components(df, {"demand": 0.5, "cost": 0.2, "ease": 0.3}).collect()}
    assert got == {1: (0, 50, "monitor"), 2: (None, 50, "monitor"), 3: (100, 50, None), 4: (50, 25, "insufficient")}
    one = market.components(df.filter("geo = 1")).first()
    assert (one.percentile, one.score) == (100, 50)
    score = spark.createDataFrame([(s, c) for s in (None, 10, 40, 60, 90) for c in ("insufficient", "low", "high")], "s int, c string")
    assert [r[0] for r in score.select(market.tier(F.col("s"), F.col("c"))).collect()] == ["insufficient"] * 3 + ["insufficient", "deprioritize", "deprioritize", "insufficient", "monitor", "monitor", "insufficient", "monitor", "strong", "insufficient", "monitor", "prioritize"]


def test_collections(spark):
    from marlstone.operators import collections as c

    rows = spark.createDataFrame([("a", '{"k":"1","n":null}', 2, 2), ("b", '{"k":"1"}', 1, 1), ("c", '{"k":"2"}', 3, 3)], "id string, data string, created_at int, updated_at int")
    assert [r.id for r in c.scan(rows, {"k": 1, "n": None}).collect()] == ["b", "a"]
    assert c.first_match(rows, {"k": "1"}).first().id == "b" and c.first_match(rows, {"k": "9"}).count() == 0
    assert c.exists(rows, {"k": 2}) and not c.exists(rows, {"z": 2})
    left, removed = c.remove_where(rows, {"k": "1"})
    assert removed == 2 and [r.id for r in left.collect()] == ["c"]
    new = spark.createDataFrame([("a", "new", 9, 9), ("d", "d", 8, 8)], rows.schema)
    assert sorted((r.id, r.data, r.created_at) for r in c.upsert(rows, new, ["id"]).collect())[0] == ("a", "new", 2)
    s = c.settings_with(spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string"), spark.createDataFrame([("y", "3")], "key string, value string"))
    assert {tuple(r) for r in s.collect()} == {("x", "1"), ("y", "3")}


def test_blockers_lower_the_cap_together(spark):
    from marlstone.operators import checks

    rows = spark.createDataFrame([(1, 1, "c1", "fail", "error", 0), (1, 3, "c3", "fail", "x", 0), (1, 4, "c4", "pass", "x", 0), (2, 4, "c4", "na", "x", 0), (3, 9, "none", "fail", "x", 0)], "page int, id int, category string, status string, severity string, place int")
    got = {r.page: (r.composite, r.cap, r.overall, r.band) for r in checks.page_scores(rows, checks.BUCKETS, checks.WEIGHTS, checks.TIERS, checks.BLOCKERS).collect()}
    assert got[1] == (32, 35, 32, "critical") and got[2] == (None, None, None, "critical") and got[3][0] is None
    assert {r.page: r.score for r in checks.category_score(rows, {"c1": 50, "c2": 50}).collect()} == {1: 50, 2: 100, 3: 100}


def test_rules_of_units_sections_and_missing_values(spark):
    from marlstone.operators import checks

    rows = [(1, "hero.h1", "Fine (Lynn) care. Call now!", "(Lynn)"), (1, "faq", None, "(Lynn)"), (2, "faq", "Care in Salem.", None), (3, "hero", "", "X")]
    pieces = spark.createDataFrame(rows, "doc int, section string, text string, city string")
    rules = [
        {"key": "city", "type": "require", "pattern": "{city}"}, {"key": "call", "type": "forbid", "pattern": "[Cc]all", "unit": "sentence", "when": "now"},
        {"key": "hero", "type": "require", "pattern": "zzz", "sections": ["hero"]}, {"key": "if", "type": "require", "pattern": "now", "when": "Call"},
    ]
    got = {(r.doc, r.rule): r.status for r in checks.apply_rules(pieces, "doc", rules).collect()}
    assert got == {
        (1, "city"): "pass", (2, "city"): "fail", (3, "city"): "pass", (1, "call"): "fail", (2, "call"): "pass", (3, "call"): "pass",
        (1, "hero"): "fail", (2, "hero"): "pass", (3, "hero"): "pass", (1, "if"): "pass", (2, "if"): "na", (3, "if"): "na",
    }


def test_templates_keep_frequent_names(spark):
    from marlstone.operators import sites

    def templates(paths):
        pages = spark.createDataFrame([("https://a.co" + p,) for p in paths], "url string").withColumn("t", sites.F.lit("clash")).withColumn("seg", sites.F.lit(1))
        return {r.url[12:]: r.template for r in sites.template_levels(pages, "url").collect()}

    rare = [f"/blog/p{i}" for i in range(9)]
    got = templates([*rare, "/blog/news", "/blog/news", "/blog/p1/x/y", "/2023/a", "/2024/a", "/about"])
    # at /blog the value p1 comes twice, so eight rare ones are left
    assert got["/blog/p2"] == "/blog/p2" and got["/blog/news"] == "/blog/news" and got["/2023/a"] == "/2023/a"
    got = templates([*rare, "/blog/q", "/blog/news", "/blog/news", "/blog/news/1", "/blog/news/22", ""])
    assert got["/blog/p2"] == got["/blog/q"] == "/blog/{slug}" and got["/blog/news"] == "/blog/news" and got["/blog/news/1"] == got["/blog/news/22"] == "/blog/news/{n}" and got[""] == "/"
    assert set(templates(["/2023/a", "/1999/a", "/2023/b"]).values()) == {"/{date}/a", "/{date}/b"} and set(templates(["/1", "/22"]).values()) == {"/{n}"} and templates(["/1"]) == {"/1": "/1"}
    assert templates([]) == {}
