"""Trees, entities and content checks of pages, against a stack parser and outcomes stated by hand."""

import html.parser
import random

import pytest
from oracle import same
from pyspark.sql import functions as F

from marlstone.operators import page_content, page_dressed, page_trees

SF01 = "/root/testdata/sf0.01"
AS_OF = "2025-06-30"
LEDE = "Acme repairs old roofs all year and keeps them dry for every owner who asks for help with tiles that the last storm has blown into the garden next door, or worse, into the street where people walk to work."
LETTERS = "acdefghijklmnopqrstuvwxz"
BODY = " ".join(f"zo{x}{y}{'.' if y == 'x' else ''}" for x in LETTERS for y in LETTERS) + " ".join(f" {x}{y}tu" for x in LETTERS for y in LETTERS)
GOOD = f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Roof repair at home</title><link rel="icon" href="/f.ico"><link rel="preload" as="image" href="/a.webp">
<link rel="preconnect" href="https://cdn.example"><link rel="preconnect" href="https://www.youtube.com"><link rel="preconnect" href="https://www.cdc.gov"><link rel="preconnect" href="https://x.edu"><link rel="preconnect" href="https://arxiv.org"><script src="https://cdn.example/jquery.js"></script>
<script type="application/ld+json">{{"@graph":[{{"@type":"Organization","@id":"#a","name":"Acme","url":"u","logo":"l","description":"d","sameAs":["https://linkedin.com/a","https://wikidata.org/a","https://youtube.com/a"]}},
{{"@type":"BlogPosting","author":{{"@type":"Person","name":"Jane Roe","jobTitle":"j","affiliation":"x","sameAs":"https://a.example"}},"datePublished":"2025-01-01","dateModified":"2025-02-01"}},{{"@type":"BreadcrumbList"}},{{"@type":"VideoObject"}},{{"@type":"Product"}},
{{"@type":"FAQPage","mainEntity":[{{"@type":"Question","acceptedAnswer":{{"@type":"Answer"}}}}]}},
{{"@type":"Dentist","telephone":"1","address":{{"streetAddress":"s","addressLocality":"l","addressRegion":"r","postalCode":"p"}},"geo":{{"latitude":1,"longitude":1}},"openingHoursSpecification":{{"dayOfWeek":"https://schema.org/Monday","opens":"9","closes":"5"}},"areaServed":"b","aggregateRating":{{"ratingValue":5,"reviewCount":3}}}}]}}</script></head>
<body><a href="#main">Skip</a><nav class="breadcrumb"><a href="/about">About</a><a href="/privacy">Privacy</a><a href="mailto:a@b.example">Mail</a></nav>
<main><article><h1>Acme roofs</h1><div class="author"><a href="/author/jane">Jane Roe</a></div><time datetime="2025-01-01">January</time><p>{LEDE}</p><h2>Why does it leak?</h2><p>{BODY}</p>
<p>Last updated in May. Reviewed by Jane Roe, PhD. Our editorial policy is public. License number 7. See llms.txt. Some 45% of adults agree. About 1 in 5 roofs leak. Now 3 million people know. Studies show 7 leaks (source: survey). According to Smith.</p>
<blockquote>A roof that is looked after twice a year lasts for as long as the house. Jane Roe, PhD</blockquote><table><tr><th>a</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>
<img src="/a.webp" alt="A roof"><a href="https://www.cdc.gov/">c</a><a href="https://x.edu/">e</a><a href="https://arxiv.org/">x</a>
<form><label for="n">Name</label><input id="n"><button>Go</button></form><iframe src="https://www.youtube.com/embed/1" title="Film"></iframe><div>{"Spoken words of the film. " * 25}</div><video><track kind="captions"></video></article></main><!-- end --></body></html>"""

#: Check, what to replace by what in the good page, its status there (the good page passes), the page's URL.
HOME, SHOP = "https://acme.example/x/y/roofs.html", "https://acme.example/services/roofs.html"
SELLS = GOOD.replace("</form>", "</form><p>Mon - Fri</p>")  # a business with hours, so a location, whose pages sell
LD = '<script type="application/ld+json">'
FLIPS = [
    ("A7", "Roof repair at home", "Roofs roofing roofed roof", "warning"), ("E13", "Acme roofs</h1>", "Leaks leaking leaked</h1>", "warning"), ("F2", BODY + "</p>", "</p>", "fail"), ("F3", BODY + "</p>", BODY[:1500] + "</p>", "warning"),
    ("F4", BODY, BODY * 4, "notice"), ("F5", "<!-- end -->", "<style>" + "x" * 400_000 + "</style>", "fail"), ("F5", "<!-- end -->", "<style>" + "x" * 100_000 + "</style>", "warning"), ("F6", LEDE, "It is short but it has words enough to count as one that opens a text of twenty.", "warning"),
    ("F6", LEDE, LEDE[:-1], "warning"), ("F7", "Acme roofs</h1>", "Zebra roofs</h1>", "pass"), ("F7", "<h1>Acme roofs</h1>", "", "notice"), ("F8", ['class="author"', "Reviewed by"], ["", "Reviewed."], "warning"), ("F9", ['class="author"><a href="/author/jane">Jane Roe', "Reviewed by"], ['class="author"><a>Team', "Reviewed."], "warning"),
    ("F10", "/author/jane", "/jane", "notice"), ("F12", "Last updated in May. Reviewed by Jane", "Jane", "notice"), ("F13", "Reviewed by Jane", "Jane", "notice"), ("F14", "house. Jane Roe, PhD</blockquote>", "house.</blockquote>", "warning"), ("F15", "Now 3 million people know.", "", "warning"),
    ("F16", "(source: survey). According to Smith.", "", "warning"), ("F17", ["https://www.cdc.gov/", "https://x.edu/", "https://arxiv.org/"], "/x", "warning"), ("F18", "<th>a</th>", "<td>a</td>", "notice"), ("F19", "</article>", '<div id="my-faq"></div></article>', "pass"), ("F19", "x", "x", "notice"),
    ("F20", "Acme repairs", "It repairs", "notice"), ("F21", "See llms", "The leading and amazing. See llms", "warning"), ("F21", "See llms", "The leading one of 2019, misleading. See llms", "pass"), ("F22", BODY, "roofing " * 100 + BODY, "warning"), ("F23", BODY, BODY * 8, "warning"), ("F24", BODY, BODY * 5, "notice"),
    ("F25", "</form>", '</form><p style="display: none">' + "hid " * 21 + "</p>", "fail"), ("F25", "</form>", '</form><p style="display: none">' + "hid " * 20 + "</p>", "pass"), ("F26", "45% of adults agree", "45% of adults agree in 2020", "warning"), ("F26", "45% of adults agree", "45% of adults agree in 2023", "pass"),
    ("G1", ' alt="A roof"', "", "fail"), ("G1", '<img src="/a.webp" alt="A roof">', '<div role="presentation"><p><img src="/a.webp"></div>', "pass"), ("G2", 'alt="A roof"', 'alt=" "', "warning"), ("G4", "A roof", "roofs roof roofing", "warning"), ("I5", "https://arxiv.org/", "/x", "notice"),
    ("J1", LD, '<script type="x">', "warning"), ("J3", '"@graph"', "@graph", "fail"), ("J4", ['"Organization"', '"Dentist"'], '"Thing"', "warning"), ("J5", '"name":"Acme"', '"name":""', "fail"), ("J6", '"url":"u",', "", "warning"), ("J7", '"logo":"l",', "", "warning"), ("J8", '"description":"d",', "", "warning"),
    ("J9", '["https://linkedin.com/a","https://wikidata.org/a","https://youtube.com/a"]', '"none"', "warning"), ("J9", '["https://linkedin.com/a","https://wikidata.org/a","https://youtube.com/a"]', '"https://a.example, https://b.example"', "pass"), ("J10", "linkedin.com", "l.example", "notice"), ("J11", "wikidata.org", "w.example", "notice"), ("J12", "youtube.com/a", "y.example", "notice"),
    ("J13", '"@id":"#a",', "", "warning"), ("J14", "BlogPosting", "Thing", "notice"), ("J15", '"author":{', '"creator":{', "fail"), ("J16", "datePublished", "x", "warning"), ("J17", "dateModified", "x", "warning"), ("J18", "FAQPage", "Thing", "notice"), ("J19", '{"@type":"Answer"}', '"yes"', "fail"), ("J20", '"Person"', '"Thing"', "notice"), ("J21", '"affiliation":"x",', "", "warning"),
    ("J22", "https://schema.org/Monday", "monday", "fail"), ("J22", '"opens":"9",', "", "fail"), ("J23", '"telephone":"1",', "", "warning"), ("J25", "BreadcrumbList", "Thing", "notice"), ("J26", "VideoObject", "Thing", "warning"), ("J28", "<form>", "<form itemscope>", "warning"), ("J29", "BlogPosting", "Article", "warning"),
    ("M15", "<!-- end -->", "<script>" + "x" * 10_001 + "</script>", "notice"), ("O6", '<link rel="preconnect" href="https://x.edu">', "", "notice"), ("O7", 'rel="preload"', 'rel="x"', "notice"), ("P8", "<th>a</th>", "<td>a</td>", "warning"), ("P9", "<th>a</th>", "<td>a</td>", "warning"), ("P9", "<tr><th>a</th></tr><tr><td>1</td><td>2</td><td>3</td></tr>", "<tr><td>1<td>2", "pass"),
    ("Q1", ' alt="A roof"', "", "fail"), ("Q2", 'for="n"', 'for="m"', "warning"), ("Q3", "<button>Go", "<button>", "warning"), ("Q3", "<button>Go", '<button><b><img alt="go" src="/b.webp"></b>', "pass"), ("Q4", ">Skip<", "><", "warning"), ("Q5", ' title="Film"', "", "warning"), ("Q6", "captions", "x", "warning"), ("Q8", "#main", "#x", "notice"), ("Q9", ' lang="en"', "", "fail"),
    ("R1", ['class="author"', "Reviewed by Jane Roe"], "", "warning"), ("R2", "/author/jane", "/jane", "warning"), ("R3", "PhD", "x", "notice"), ("R5", "Last updated", "x", "notice"), ("R6", "License number 7", "x", "notice"), ("R7", ["https://www.cdc.gov/", "https://x.edu/", "https://arxiv.org/"], "/x", "notice"), ("R8", "/about", "/x", "notice"), ("R9", "mailto:a@b.example", "/x", "warning"), ("R10", "/privacy", "/x", "notice"), ("R11", "editorial policy", "x", "notice"), ("R12", '"jobTitle":"j",', "", "na"),
    ("S1", "<form>", '<form><img src="http://x.example/a.png" alt="x">', "fail"), ("S2", "https://www.youtube", "http://www.youtube", "warning"), ("S3", "https://cdn.example/jquery.js", "https://cdn.example/own.js", "notice"), ("S4", "</form>", '</form><p style="visibility:hidden">' + "hid " * 21 + "</p>", "fail"), ("S5", "/about", "/about?ref=1", "warning"), ("S6", "<!-- end -->", "<!-- internal -->", "notice"),
    ("T1", "<!-- end -->", "<style>" + "x" * 60_000 + "</style>", "warning"), ("T2", "leak?", "leak", "notice"), ("T3", ["Jane Roe, PhD</blockquote>", "Now 3 million people know.", "(source: survey). According to Smith."], "", "notice"), ("T4", "2025-02-01", "2024-02-01", "warning"), ("T5", "VideoObject", "Thing", "warning"), ("T6", "</iframe><div>", "</iframe><hr><div>", "notice"), ("T7", "llms.txt", "x", "notice"), ("T8", BODY + "</p>", "</p>", "fail"), ("T10", "https://youtube.com/a", "y", "warning"),
    ("U1", 'rel="icon"', 'rel="x"', "notice"), ("U3", "breadcrumb", "x", "notice"), ("U4", "<!-- end -->", "<!-- todo -->", "notice"), ("U5", "</form>", "</form>" + '<a href="/x?aff=1">x</a>' * 11, "warning"), ("U6", "</form>", "</form>" + '<a href="/x">x</a>' * 101, "warning"), ("U7", '<meta charset="utf-8">', "", "warning"), ("U8", "llms.txt", "x", "notice"),
]
#: The same for a page that sells.
SELLING = [
    ("F3", BODY + "</p>", BODY[:100] + "</p>", "notice"), ("F14", "x", "x", "na"), ("I5", "x", "x", "na"), ("J15", "BlogPosting", "Thing", "na"), ("J22", ['"Dentist"', "BlogPosting", "datetime"], ['"Thing"', "Thing", "x"], "warning"), ("J23", '"telephone":"1",', "", "fail"), ("J23", '"geo"', '"g"', "warning"), ("N6", "x", "x", "pass"), ("R1", "x", "x", "na"),
    ("R12", '"jobTitle":"j",', "", "warning"), ("T2", "leak?", "leak", "warning"), ("T4", ["datetime=", "dateModified"], "x", "notice"), ("T11", '"telephone":"1",', "", "warning"), ("T11", '"address"', '"a"', "fail"), ("T12", "https://schema.org/Monday", "Monday", "fail"), ("T12", '"openingHoursSpecification"', '"o"', "warning"),
    ("T13", '"reviewCount":3', '"r":3', "notice"), ("T13", ['"aggregateRating"', "<form>"], ['"a"', '<form class="stars">'], "warning"), ("T14", '"areaServed"', '"a"', "notice"), ("F6", LEDE, " ".join(LEDE.split()[:25]) + ".", "pass"),
]


def flipped(page, old, new):
    for k, o in enumerate(old if isinstance(old, list) else [old]):
        assert o in page, o
        page = page.replace(o, new[k] if isinstance(new, list) else new)
    return page


def statuses(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("nodes", F.lit(1)).withColumn("page", F.lit("clash"))
    got = {}
    for r in page_content.outcomes(page_content.signals(pages, AS_OF)).collect():
        got.setdefault(r.page, {})[r.id] = r.status
    return got


def test_every_check_passes_and_fails_as_stated(spark):
    cases = [(HOME, GOOD, c) for c in FLIPS] + [(SHOP, SELLS, c) for c in SELLING]
    rows = [(-1, HOME, GOOD), (-2, SHOP, SELLS), (-3, "https://acme.example/roof/roofs/roofing-x.html", GOOD)] + [(k, url, flipped(page, old, new)) for k, (url, page, (_, old, new, _)) in enumerate(cases)]
    got = statuses(spark, rows)
    unpassed = {i: s for i, s in got[-1].items() if s not in ("pass", "informational")}
    assert unpassed == {"F19": "notice", "T11": "na", "T12": "na", "T13": "na", "T14": "na"}
    assert {i: s for i, s in got[-2].items() if s not in ("pass", "informational", "na")} == {"F19": "notice"}
    wrong = [(c[0], str(c[1])[:40], got[k][c[0]], c[3]) for k, (_, _, c) in enumerate(cases) if got[k][c[0]] != c[3]]
    assert wrong == []
    assert got[-3]["N6"] == "warning"
    checked = {c[0] for c in FLIPS + SELLING} | {"N6"}
    always = {i for i, _, w in page_content.RULES if set(w.values()) <= {"I", "A"}}
    assert {i for i, _, _ in page_content.RULES} - checked - always == {"F11", "R4"}
    bare = statuses(spark, [(1, None, None), (1, None, None), (2, HOME, "no tags 2024")])
    assert (bare[1]["F2"], bare[1]["F11"], bare[1]["R4"], bare[1]["J24"], bare[2]["R4"]) == ("fail", "notice", "notice", "informational", "pass")


def test_answers_of_selling_pages(spark):
    pages = spark.createDataFrame([(1, SHOP, SELLS), (2, SHOP, flipped(GOOD, ["Dentist", "BlogPosting", "datetime"], ["Thing", "Thing", "x"])), (3, HOME, GOOD)], "page_id long, url string, html string")
    got = {r.page: (r.intent, r.earned, r.most, r.answerability) for r in page_content.answerability(page_content.signals(pages, AS_OF)).collect()}
    # name, address, hours, place, proof, entity links and fluency in full
    assert got[1] == ("commercial", 10, 10, 10)
    assert got[2][0] == "commercial" and got[2][2] == 6
    assert got[3] == ("informational", 10, 10, 10)


def test_full_scores_follow_weights_and_blockers(spark):
    pages = spark.createDataFrame([(1, HOME, GOOD), (2, SHOP, SELLS), (3, HOME, None), (4, HOME, flipped(GOOD, '"@graph"', "@graph"))], "page_id long, url string, html string")
    checks = page_dressed.all_checks(pages, AS_OF).toPandas()
    assert not checks.duplicated(["page", "id"]).any() and checks.groupby("page").id.count().eq(252).all()
    points = {"pass": 100, "notice": 85, "warning": 50}
    got = {r.page: r for r in page_dressed.full_scores(pages, AS_OF).collect()}
    for page, own in checks.groupby("page"):
        total = weights = 0
        for bucket, (weight, categories) in page_dressed.BUCKETS.items():
            won = tiers = 0
            for c in own[own.category.isin(categories)].itertuples():
                if c.status in ("pass", "notice", "warning", "fail"):
                    tier = page_dressed.TIERS["commercial" if page == 2 else "informational"].get(c.id, 2)
                    won, tiers = won + tier * points.get(c.status, 0 if c.severity == "error" else 25), tiers + tier
            if tiers:
                total, weights = total + round(1000 * weight) * int(won / tiers + 0.5), weights + round(1000 * weight)
        assert got[page].composite == int(total / weights + 0.5)
    assert (got[1].cap, got[2].cap, got[4].cap) == (65, 65, 60)  # no viewport in them, then broken structured data too
    assert got[3].cap == 50 - 5 * 3  # thin, and without title, heading and viewport


def test_types_by_evidence_and_overrides(spark):
    rows = [(1, "https://a.example/", "x"), (2, "https://a.example/blogs/x", "x"), (3, "https://a.example/blog/x", '<script type="application/ld+json">{"@type":"Product"}</script>'), (4, None, None),
            (5, "https://a.example/services/x", '<p>Mon - Fri<script type="application/ld+json">{"@graph":[{"@type":["Thing","Plumber"]}]}</script>'), (6, "https://a.example/faq/", '<article><p class="byline">x</p><time datetime="2020"></time></article>'), (7, "https://a.example/locations/boston", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    given = spark.createDataFrame([(7, "landing"), (7, "landing")], "page long, page_type string")
    got = {r.page: (r.page_type, r.confidence, r.reason) for r in page_content.page_types(pages, given).collect()}
    assert got == {1: ("homepage", 0.7, "url"), 2: ("article", 0.7, "url"), 3: ("product", 0.85, "product schema"), 4: ("other", 0.5, "none"), 5: ("location", 0.9, "business and place"), 6: ("article", 0.85, "article with author and time"), 7: ("landing", 1.0, "given")}


class Stack(html.parser.HTMLParser):
    """Parents and depths of well-formed markup by a plain stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.text = [], [], ""

    def handle_starttag(self, tag, attrs):
        self.out.append([tag, self.open[-1] if self.open else -1, len(self.open), len(self.text), None, None])
        if tag in page_trees.VOID:
            self.out[-1][4:] = [len(self.out) - 1, len(self.text)]
        else:
            self.open.append(len(self.out) - 1)

    def handle_endtag(self, tag):
        self.out[self.open.pop()][4:] = [len(self.out) - 1, len(self.text)]

    def handle_data(self, data):
        self.text += data


def well_formed(g, depth=0):
    out = ""
    for _ in range(g.randint(1, 4)):
        kind = g.random()
        if kind < 0.3 or depth > 6:
            out += g.choice(["word ", "a &amp; b", "é", " ", "x<1 "])
        elif kind < 0.45:
            out += g.choice(["<br>", '<img alt="a>b" src=x>', "<input disabled>", "<!-- <p> -->"])
        else:
            tag = g.choice(["div", "section", "span", "b", "em", "ul"])
            inner = "".join(f"<li>{well_formed(g, depth + 2)}</li>" for _ in range(2)) if tag == "ul" else well_formed(g, depth + 1)
            out += f'<{tag} class="c">{inner}</{tag}>'
    return out


def test_tree_equals_a_stack_parser():
    g = random.Random(7)
    for _ in range(200):
        # inline elements may not hold blocks that their end tag would not reach beyond
        page = "<html><body>" + well_formed(g).replace("<b ", "<section ").replace("</b>", "</section>").replace("<em ", "<div ").replace("</em>", "</div>").replace("<span ", "<div ").replace("</span>", "</div>") + "</body></html>"
        plain = Stack()
        plain.feed(page)
        nodes, text, _, _ = page_trees.grown(page)
        assert text == plain.text
        assert [(n["tag"], n["parent"], n["depth"], n["start"], n["last"], n["stop"]) for n in nodes] == [tuple(r) for r in plain.out]


def test_tree_of_loose_markup():
    tags = lambda page: [(n["tag"], n["parent"]) for n in page_trees.grown(page)[0]]
    assert tags("") == [("html", -1), ("body", 0)] == tags(None or " ")
    assert tags("<p>a<p>b<b>c<div>d</b></div>e") == [("html", -1), ("body", 0), ("p", 1), ("p", 1), ("b", 3), ("div", 1)]
    assert tags("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>")[2:] == [("ul", 1), ("li", 2), ("li", 2), ("ul", 4), ("li", 5), ("li", 2)]
    assert tags("<table><tr><td>a<td>b<tr><th>c</table><a>1<a>2")[2:] == [("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("th", 6), ("a", 1), ("a", 1)]
    assert tags("<title><b>x</title><p/>")[:3] == [("html", -1), ("title", 0), ("body", 0)]
    nodes, text, linked, comments = page_trees.grown('<p A=1 a=2 b=\'x"y\' c>&lt;x&gt; <script>no</script><!-- yes --><script type="application/ld+json">{}</script>t')
    assert (text, linked, comments) == ("<x> t", ["{}"], [" yes "]) and dict(nodes[2]["a"]) == {"a": "1", "b": 'x"y', "c": ""}
    deep = "<div>" * 20_000
    assert page_trees.grown(deep)[0][-1]["depth"] == 20_001


def test_entities_of_blocks():
    e = lambda s: [(x["depth"], x["types"]) for x in page_trees.entities(s)]
    assert page_trees.entities("{x") is None and page_trees.entities("") is None and e("1") == e("null") == e("[]") == e('{"@type":[]}') == []
    assert e('[{"@graph":[{"@type":"A"},{"@type":["B","C"],"author":{"@type":"P"}}],"@type":"Z"}]') == [(0, ["A"]), (0, ["B", "C"]), (1, ["P"]), (0, ["Z"])]
    nested = '{"@type":"X"}'
    for _ in range(7):
        nested = f'{{"author":{nested},"@type":"L"}}'
    assert e(nested) == [(d, ["L"]) for d in range(6)]


@pytest.mark.parametrize("name", ["page_elements", "page_schema_entities", "page_types"])
def test_query_matches_sql_on_more_pages(spark, name):
    same(page_dressed.QUERIES[name](spark, SF01), page_dressed.ORACLE_SQL[name], SF01)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_content.signals(pages, AS_OF).count() == page_trees.tree_elements(pages).count() == page_trees.schema_entities(pages).count() == 0
