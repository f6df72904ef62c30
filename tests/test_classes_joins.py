"""Classes and joins on small tables with stated results."""

from pyspark.sql import functions as F

from marlstone.functions import stems
from marlstone.operators import classify, joins


def test_stems_of_the_published_examples(spark):
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
    tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform
    radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
    formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
    inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
    activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll customer custom balance balanc""".split()
    wrong = [(w, s, stems.stem(w)) for w, s in zip(pairs[::2], pairs[1::2]) if stems.stem(w) != s]
    assert not wrong, wrong
    df = spark.createDataFrame([("Cats",), ("cats",), (None,), ("cats",), ("été",)], "word string")
    assert sorted(r.stem or "" for r in stems.stemmed(df, "word").collect()) == ["", "Cat", "cat", "cat", "été"] and stems.stemmed(df.limit(0), "word").count() == 0


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_keywords(spark):
    allowed = ("Greater Boston",)
    rival = classify.rivals("South Boston", allowed, ("Boston", "Nashua", "Greater Boston", "", None))
    assert rival == ["nashua"]
    assert one(spark, "braces greater boston", lambda v: classify.relevant(v, ("brace",), ["boston"], allowed))
    assert not one(spark, "braces boston", lambda v: classify.relevant(v, ("brace",), ["boston"], allowed))
    assert not one(spark, None, lambda v: classify.relevant(v, ("brace",), ["boston"], allowed))
    assert [one(spark, k, classify.intent) for k in ("how to floss", "show dentist", None)] == ["informational", "commercial", "commercial"]
    assert [one(spark, k, classify.near_me) for k in ("Dentist NEAR me", "near mean")] == [True, False]
    assert [one(spark, k, lambda v: classify.branded(v, F.lit("idfcfirst"))) for k in ("idfc bank", "idf bank", "")] == [True, False, False]


def test_support_words_are_met_by_stems(spark):
    rows = spark.createDataFrame([(1, "checking balances"), (2, "customer care"), (3, "customers"), (4, None), (5, "dental implants")], "id int, k string")
    topics = spark.createDataFrame([("implant",)], "stem string")
    got = {r.id: (r.navigational, r.shares) for r in classify.keyword_topics(rows, "id", "k", topics).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, True)}


def test_domains_and_images(spark):
    of = lambda d: one(spark, d, lambda v: classify.domain_class(v, "me.com", ("yelp.com",)))
    assert [of(d) for d in ("https://www.me.com/x", "m.yelp.com", "health.state.gov", "nhs.gov.uk", "other.com?yelp.com", None)] == ["you", "directory", "directory", "provider", "provider", "provider"]
    assert [one(spark, n, classify.image_base) for n in ("a1b2c3_roof-300x200_1.jpg.webp?itok=1", "aetna_plan-2018.PNG", "nc.team.jpeg", None)] == ["roof", "aetna_plan-2018", "team", ""]
    assert [one(spark, a, classify.alt_grade) for a in (None, " ", "IMG 12", "photo", "A roof", "A roof seen from the street")] == ["No", "No", "Yes (generic)", "Yes (generic)", "Yes (improve)", "Yes (good)"]


def test_claims(spark):
    text = "a [NEW:stat]45% of users[/NEW] b [NEW:stat]\n140% of users[/NEW] [NEW]x[/NEW] [NEW:stat]140% growth (Acme, 2031)[/NEW][NEW:stat]call 555-123-4567[/NEW][NEW:quote]\"this is a long enough quotation\" As Ann Lee at Acme[/NEW][NEW:quote]\"this is a long enough quotation\"[/NEW][NEW:cite]https://example.com/a[/NEW][NEW:cite]According to Acme Labs[/NEW][NEW:cite]x[/NEW][NEW:stat][NAME] 5%[/NEW]"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = [(r.ordinal, r.type, r.verdict) for r in joins.screened(joins.claims(docs, "id", "text"), 2026).orderBy("ordinal").collect()]
    assert got == [(0, "stat", None), (1, "stat", "refuted"), (3, "stat", "refuted"), (4, "stat", "not_a_claim"), (5, "quote", None), (6, "quote", "refuted"), (7, "cite", "refuted"), (8, "cite", None), (9, "cite", "not_a_claim"), (10, "stat", "refuted")]


def test_clusters(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)], "node long, cluster long")
    pairs = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.9), (3, 4, 0.2), (2, 3, 0.1)], "i long, j long, similarity double")
    assert [tuple(r) for r in joins.cannibals(members, pairs).collect()] == [(1, 1, 2, 1, 1, 0.8)]
    near = {r.node: (r.cluster, r.mean) for r in joins.nearest_cluster(members.select("node"), members, pairs).collect()}
    assert near == {1: (1, 0.8), 2: (1, 0.8), 3: (1, 0.5), 4: (2, 0.2), 5: (None, None)}
    dual = {r.node: r.dual for r in joins.dual_members(members, pairs).collect()}
    assert dual == {1: False, 2: False, 3: True, 4: False, 5: True}
    assert not any(r.dual for r in joins.dual_members(members.filter("cluster = 1"), pairs).collect())
    # 1 and 6 are equal, and so are 3 and 7: all pairs of nodes give what kinds give
    kinds = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (6, 1, 1), (3, 2, 3), (7, 1, 3), (4, 2, 4), (5, 3, 5)], "node long, cluster long, kind long")
    alike = pairs.unionByName(spark.createDataFrame([(1, 1, 1.0), (3, 3, 1.0), (4, 4, 1.0)], pairs.schema))
    listed = spark.createDataFrame([(1, 2, 0.8), (2, 6, 0.8), (1, 3, 0.9), (1, 7, 0.9), (3, 6, 0.9), (6, 7, 0.9), (3, 4, 0.2), (4, 7, 0.2), (2, 3, 0.1), (2, 7, 0.1), (1, 6, 1.0), (3, 7, 1.0)], pairs.schema)
    assert sorted(tuple(r) for r in joins.cannibals(kinds, alike, 0.5).collect()) == [(1, 1, 1, 2, 2, 1.0), (1, 1, 2, 2, 1, 0.8), (1, 1, 3, 2, 1, 0.9)]
    plain = kinds.drop("kind")
    rounded = lambda d: sorted((r.node, r.cluster, round(r.mean, 9)) for r in d.collect())
    assert rounded(joins.cluster_means(kinds, alike)) == rounded(joins.cluster_means(plain, listed))
    assert sorted(map(tuple, joins.dual_members(kinds, alike).collect())) == sorted(map(tuple, joins.dual_members(plain, listed).collect()))


def test_cadence_and_dependencies(spark):
    schedule = spark.createDataFrame([("a", "Report monthly", "Weekly"), ("b", "Report", "Monthly"), ("c", "Audit", None), (None, "Audit", "Weekly")], "client string, task string, frequency string")
    tasks = spark.createDataFrame([("a", "the REPORT", "Done", "2026-01-08"), ("a", "report", "Done", "2025-12-30"), ("b", "report", "Today", None), ("c", "audit", "Done", "2025-11-01")], "client string, name string, status string, due string").withColumn("due", F.to_date("due"))
    got = {(r.client, r.flag, str(r.last_done)) for r in joins.cadence(schedule, tasks, F.to_date(F.lit("2026-01-10"))).collect()}
    assert got == {("a", "On Track", "2026-01-08"), ("b", "At Risk", "None"), ("c", "Missed", "None"), (None, "Missed", "None")}
    uses = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", "y"), ("n", "{z}"), ("n", "w")], "module string, pattern string")
    base = spark.createDataFrame([("x", True), ("y", False), ("q", True), ("r", False)], "entry string, active boolean")
    assert {tuple(r) for r in joins.dependency_audit(uses, base).collect()} == {("m", "x", "OK"), ("m", "y", "WARNING"), ("n", "{z}", "TEMPLATE"), ("n", "w", "ERROR"), (None, "q", "ORPHAN")}
