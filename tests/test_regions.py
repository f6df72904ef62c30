"""Services in places on small tables with stated results."""

from pyspark.sql import functions as F

from marlstone.operators import regions as rg


def test_primary_keywords(spark):
    rows = [("Dentist in Boston", "boston ", ["dent"], None, True), ("dentist boston", "Boston", [], "Dentist care now", True), ("dentist", "Boston", ["dent"], None, False), ("boston now", "Boston", None, "the now", False), (None, "Boston", ["x"], None, False), ("dentist", "", ["dent"], None, False), ("x", None, ["x"], None, False)]
    d = spark.createDataFrame(rows, "k string, c string, t array<string>, s string, want boolean")
    assert all(r.got == r.want for r in d.select("want", F.coalesce(rg.primary_eligible(F.col("k"), F.col("c"), F.col("t"), F.col("s")), F.lit(False)).alias("got")).collect())


def test_eligibility(spark):
    places = spark.createDataFrame([(1, True, [7, 8]), (2, None, [7]), (3, True, None)], "place int, verified boolean, offers array<int>")
    services = spark.createDataFrame([(7,), (8,), (7,)], "service int")
    pairs = spark.createDataFrame([(7, 1), (9, 1), (8, 2), (7, 3), (7, 4), (None, 1)], "service int, place int")
    got = {(r.service, r.place): (r.eligible, r.backed, r.reason) for r in rg.eligibility(pairs, services, places).collect()}
    assert got == {(7, 1): (True, True, "verified place that offers it"), (9, 1): (False, False, "service not found"), (8, 2): (False, False, "place not verified"), (7, 3): (False, True, "not offered here"), (7, 4): (False, False, "place not found"), (None, 1): (False, False, "service not found")}


def test_volumes_of_phrases(spark):
    terms = spark.createDataFrame([(1, "Braces  Near Me"), (2, "braces [city]"), (3, None), (4, "cost")], "seq int, term string")
    where = spark.createDataFrame([("Dallas–Ft. Worth, TX",), ("Reno",)], "region string")
    results = spark.createDataFrame([("braces dallas", 10, 1.5, [0.25, 0.5]), ("cost reno", 7, 2.0, [1.0]), ("cost reno", 7, 2.0, [1.0])], "phrase string, volume int, cost double, trend array<double>")
    got = {(r.region[:4], r.term): (r.phrase, r.asked, r.volume, r.cost, r.monthly) for r in rg.region_volumes(terms, where, results).collect()}
    assert got["Dall", "Braces  Near Me"] == ("braces dallas", True, 10, 1.5, [3, 5]) and got["Dall", "braces [city]"] == ("braces dallas", False, 10, 1.5, [3, 5])
    assert got["Reno", "cost"] == ("cost reno", True, 7, 2.0, []) and got["Dall", "cost"] == ("cost dallas", True, 0, 0.0, []) and got["Reno", None][0] == "reno" and len(got) == 8


def test_siblings(spark):
    rows = [(1, "a", 5), (2, "a", 1), (3, "b", 0), (4, "b", 9), (5, None, 2), (6, None, 3), (7, "c", 7)]
    places = spark.createDataFrame(rows, "place int, region string, seq int")
    got = {}
    for r in rg.sibling_places(places, 3).orderBy("place", "rank").collect():
        got.setdefault(r.place, []).append(r.sibling)
    order = lambda p, g: [x for x, _, _ in sorted((o for o in rows if o[0] != p), key=lambda o: (o[1] != g, o[2], o[0]))][:3]
    assert got == {p: order(p, g) for p, g, _ in rows}
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"r{i}", i) for i in range(300)], "place int, region string, seq int")
    last = [r.sibling for r in rg.sibling_places(many, 2).filter("place = 299").orderBy("rank").collect()]
    assert last == [1, 2] and rg.sibling_places(places.limit(1)).count() == 0 and rg.sibling_places(places.limit(0)).count() == 0


def test_results_and_domains(spark):
    rows = [("s", k, u) for k, u in enumerate(["https://www.own.com/a", "https://youtube.com/x", "https://a.youtube.com", "https://notyoutube.com/", "https://z.com/f.pdf?x", "no url", None, "https://z.com/f.pdfx", "https://q.org"])]
    d = spark.createDataFrame(rows, "seed string, place int, url string")
    assert [(r["rank"], r.url) for r in rg.counting_results(d, F.lit("http://own.com/b"), 2).orderBy("rank").collect()] == [(1, "https://notyoutube.com/"), (2, "https://z.com/f.pdfx")]
    assert rg.counting_results(d, F.lit(None).cast("string"), 9).count() == 4
    checked = spark.createDataFrame([("https://A.com", "https://a.com/1", None, None), ("https://A.com", "https://a.com/2", "https://b.com/", None), ("https://A.com", "https://a.com/3", "https://b.com/", "timeout"), ("https://c.com/", "https://c.com/1", "https://b.com", None)], "domain string, url string, final string, error string")
    assert sorted(tuple(r) for r in rg.on_domain(checked).collect()) == [("https://A.com", "https://a.com/1", "on domain"), ("https://A.com", "https://a.com/3", "error"), ("https://c.com/", "https://c.com/", "home")]
