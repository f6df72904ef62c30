"""Checks of what a page says: content, structured data, accessibility, authorship, security, answers.

Pages are parsed once into trees (page_trees); every signal of a page is an expression over its own
elements, entities and text, and every check a rule over signals, as in page_checks. No row is exploded
or shuffled. Text lengths are in code points; white space is Unicode's; texts never hold
what scripts and styles hold. A page's type, and by it its intent, comes from ranked evidence (page_types).

Null pages count as empty ones, null URLs as none; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settled import settled, spread
from .page_checks import OUTCOMES, PROMOTION, case
from .page_trees import inside, text_of, trees, with_entities

# Hosts of primary sources, types of local businesses, marks of credentials, statistics and what is none, words
# that stand for no author, stop words, files of known hosts.
SOURCES = (".gov", ".edu", "pubmed", "ncbi", "arxiv", "springer", "nature.com", "sciencedirect", "who.int", "cdc.gov", "nih.gov", "bmj.com", "thelancet.com", "jamanetwork.com")
LOCAL = (
    "LocalBusiness", "Dentist", "MedicalOrganization", "Hospital", "Physician", "MedicalClinic", "Pharmacy", "Optician", "Veterinary", "Restaurant", "Bakery", "BarOrPub", "CafeOrCoffeeShop", "FastFoodRestaurant", "Hotel", "LodgingBusiness", "BedAndBreakfast",
    "Store", "AutoDealer", "AutoRepair", "BeautySalon", "HairSalon", "HealthClub", "SportsClub", "GymOrHealthClub", "LegalService", "Attorney", "AccountingService", "FinancialService", "InsuranceAgency", "RealEstateAgent", "HomeAndConstructionBusiness", "Plumber",
    "Electrician", "Locksmith", "HVACBusiness", "MovingCompany", "CleaningService", "LandscapingBusiness", "School", "Library", "Museum", "PerformingArtsTheater", "PlaceOfWorship", "GovernmentOffice", "FireStation", "PoliceStation", "TravelAgency", "TaxiService", "Florist", "PetStore",
)
MEDICAL = ("Dentist", "Physician", "MedicalOrganization", "Hospital", "MedicalClinic", "Pharmacy")
LEGAL, FINANCIAL = ("Attorney", "LegalService"), ("FinancialService", "AccountingService", "InsuranceAgency")
ARTICLES = ("Article", "BlogPosting", "NewsArticle")
DAYS = r"^https?://schema\.org/(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|PublicHolidays)$"
CREDENTIALS = r"\b(MD|DO|DDS|DMD|DVM|PhD|RN|NP|PA-C|RDH|CPA|JD|MBA|Esq|LCSW|DPT)\b"
SUBSTANTIATED = r"(?i)\b(19|20)\d{2}\b|readers.?\s*choice|voted by|ranked by|accredited by"
STATISTICS = (
    r"(?i)\d+\.?\d*\s*%\s*(of\s+\w+|reduction|increase|improvement|patients|cases|adults|children|people)", r"(?i)\d+\s+(out\s+of|in\s+every|in|per)\s+\d+", r"(?i)\d+\s+(million|billion|thousand)\s+(people|patients|adults|Americans|cases|dentists)",
    r"(?i)according\s+to\s+[A-Z][^,]+,\s*\d", r"(?i)\d+[^.]*\(\s*(CDC|ADA|WHO|NIH|NIDCR|study|research|survey|report)", r"(?i)(studies?|research|data|survey|report)\s+(show|found|indicate|suggest|reveal)[^.]*\d",
)
NO_STATISTICS = (
    r"\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}", r"\d{5}(-\d{4})?", r"\$[\d,]+(\.\d{2})?", r"\d{1,2}:\d{2}\s*(AM|PM|am|pm)", r"(?i)\d+\s*(st|nd|rd|th)\s+(floor|suite|ste)", r"(?i)copyright\s+©?\s*\d{4}", r"©\s*\d{4}", r"(?i)established\s+in\s+\d{4}", r"(?i)since\s+\d{4}", r"\(\s*\d{4}\s*\)",
)
OTHER_YEARS = r"(?i)copyright|©|all\s+rights\s+reserved|since\s+\d{4}|established|founded|\d{4}\s*[-–—]\s*\d{4}|privacy\s+policy|terms\s+of\s+(service|use)"
ATTRIBUTED = r"(?i)\((?:source|per|via)[,:\s][^)]{1,60}\)|\[\s*\d{1,3}\s*\]|\baccording\s+to\s+[A-Z]"
DATED = r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{4}|\w+ \d{1,2},? \d{4}|\d{4}-\d{2}-\d{2})\b"
NOBODY = ("team", "staff", "admin", "editor", "webmaster", "support", "marketing")
STOP = ("about", "above", "after", "again", "against", "there", "their", "these", "those", "which", "would", "could", "should")
KNOWN_SCRIPTS = r"(?i)googletagmanager|google-analytics|googlefonts|googleapis|jquery|cloudflare|jsdelivr|unpkg|bootstrapcdn|cdnjs|fontawesome"
PRIVATE = r"(?i)api[_-]?key|password|secret|token|admin|todo|email.*@"
PHONE = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
NOT_OPENING = ("banner", "promo", "cta", "alert", "offer", "notice", "badge", "tag", "pill")
STREET = r"(?i)\b\d{1,6}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){0,4}\s+(?:St(?:reet)?|Ave(?:nue)?|Rd|Road|Blvd|Boulevard|Dr(?:ive)?|Ln|Lane|Way|Ct|Court|Pl(?:ace)?|Pkwy|Parkway|Cir(?:cle)?|Ter(?:race)?|Hwy|Highway|Sq(?:uare)?)\.?\b"
ZIP = r"\b[A-Z]{2}\s+\d{5}(-\d{4})?\b"
HOURS = r"(?i)opening hours|hours of operation|office hours|business hours|store hours|mon(?:day)?\s*[-–—]\s*fri(?:day)?|\b(?:mon|tue|wed|thu|fri|sat|sun)\w*\b[^.]{0,25}\d{1,2}:\d{2}\s*(?:am|pm)"
# Page types by URL, in order of precedence, and the types of pages that sell.
URL_TYPES = (
    ("homepage", r"^https?://[^/]+/?$"), ("article", r"/(blog|news|article|post|editorial|insight|story|press)s?/"), ("article", r"/(blog|news|article|post)s?/[^/]+/?$"), ("location", r"/(location|office|branch|store|clinic|venue|outlet|practice|dental-office)s?/"),
    ("location", r"/[a-z]{2}/[a-z-]+/?$"), ("service", r"/(service|treatment|procedure|offering|solution|therapy)s?/"), ("product", r"/(product|item|shop|buy|purchase|catalog)s?/"), ("category", r"/(category|cat|collection|department)s?/"),
    ("about", r"/(about|about-us|our-story|company|who-we-are)/?$"), ("contact", r"/(contact|contact-us|get-in-touch|reach-us)/?$"), ("faq", r"/(faq|faqs|frequently-asked|help|support)/"), ("resource", r"/(resource|guide|whitepaper|ebook|case-study|report|template|checklist)s?/"),
    ("team", r"/(team|staff|people|doctors|physicians|attorneys|our-team)s?/"), ("pricing", r"/(pricing|plans|packages|rates|fees)/?$"), ("landing", r"/(lp|landing|campaign)s?/"),
)
SELLING = ("location", "service", "product", "category", "pricing", "contact", "landing", "homepage", "team", "about")

WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
NODES, TEXT = "nodes", "text"


def flat(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, WS, " "))


def words(s: Column) -> Column:
    return F.filter(F.split(s, WS), lambda w: w != "")


def attr(n: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(n["a"], F.lit(name)), F.lit(""))


def given(n: Column, name: str) -> Column:
    return F.map_contains_key(n["a"], name)


def classed(n: Column, *parts: str) -> Column:
    """Has the class attribute one of these parts?"""
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(attr(n, "class"), F.lit(p))
    return found


def every(condition) -> Column:
    return F.filter(NODES, condition)


def tagged(*tags: str) -> Column:
    return every(lambda n: n["tag"].isin(*tags))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def says(n: Column) -> Column:
    return F.coalesce(text_of(TEXT, n), F.lit(""))


def within(nodes: Column, outer: Column) -> Column:
    """Those of ``nodes`` that lie in one of ``outer``."""
    return F.filter(nodes, lambda n: F.exists(outer, lambda m: inside(n, m)))


def without(scope: Column, holes: Column) -> Column:
    """The text of a node without that of the holes, which are in document order."""
    begin = F.struct(scope["start"].alias("at"), F.lit("").alias("out"))

    def skip(acc: Column, hole: Column) -> Column:
        more = F.when(hole["start"] > acc["at"], F.substring(TEXT, acc["at"] + 1, hole["start"] - acc["at"])).otherwise("")
        return F.struct(F.greatest(acc["at"], hole["stop"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    own = F.filter(holes, lambda h: inside(h, scope))
    return F.aggregate(own, begin, skip, lambda acc: F.concat(acc["out"], F.when(scope["stop"] > acc["at"], F.substring(TEXT, acc["at"] + 1, scope["stop"] - acc["at"])).otherwise("")))


def any_of(s: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | s.rlike(p)
    return found


def contains_any(s: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(s, F.lit(p))
    return found


def stem(w: Column) -> Column:
    return F.regexp_replace(F.lower(w), "(?:ing|ed|er|s|es|ly)$", "")


def most_frequent(items: Column) -> Column:
    """How often the most frequent item occurs: the longest run of the sorted ones."""
    begin = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["prev"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), begin, step, lambda acc: acc["best"])


def statistic(sentence: Column) -> Column:
    return ~any_of(sentence, NO_STATISTICS) & any_of(sentence, STATISTICS)


def prop(v: Column, *names: str) -> Column:
    """A property as JSON, null where it is missing or null."""
    j = F.to_json(F.try_variant_get(v, "$" + "".join(f'["{n}"]' for n in names), "variant"))
    return F.when(j != "null", j)


def true(v: Column, *names: str) -> Column:
    """Is the property there, and neither empty, zero nor false?"""
    return F.coalesce(~prop(v, *names).isin('""', "0", "false"), F.lit(False))


def plain(v: Column, *names: str) -> Column:
    return F.coalesce(F.try_variant_get(v, "$" + "".join(f'["{n}"]' for n in names), "string"), F.lit(""))


def listed(v: Column, name: str) -> Column:
    """A property's values, one or a list, as variants."""
    path = f'$["{name}"]'
    whole = F.try_variant_get(v, path, "variant")
    many = F.try_variant_get(v, path, "array<variant>")
    return F.when(whole.isNull() | (prop(v, name).isNull()), F.array().cast("array<variant>")).when(many.isNotNull(), many).otherwise(F.array(whole))


def of_type(*types: str) -> Column:
    return F.filter("things", lambda e: F.arrays_overlap(e["types"], F.array(*[F.lit(t) for t in types])))


def grown(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages as trees, with the lists of elements, texts and entities that the signals share."""
    source = pages.select(F.col(id_col).alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = settled(with_entities(trees(spread(source))))
    style = lambda n: F.lower(F.regexp_replace(attr(n, "style"), r"\s", ""))
    hides = lambda n: F.contains(style(n), F.lit("display:none")) | F.contains(style(n), F.lit("visibility:hidden"))
    d = d.select(
        "*",
        F.transform("entities", lambda e: F.struct(e["types"].alias("types"), F.try_parse_json(e["json"]).alias("v"))).alias("things"),
        first(tagged("body")).alias("body"),
        every(hides).alias("hidden"),
        every(lambda n: (n["tag"] == "a") & given(n, "href")).alias("links"),
        tagged("h1", "h2", "h3", "h4", "h5", "h6").alias("heads"),
        tagged("p").alias("paras"),
        tagged("table").alias("tables"),
        tagged("img").alias("imgs"),
        tagged("iframe").alias("frames"),
        every(lambda n: (attr(n, "rel") == "author") | classed(n, "author")).alias("authors"),
        every(lambda n: classed(n, "faq") | F.contains(attr(n, "id"), F.lit("faq"))).alias("faqs"),
        every(lambda n: (n["tag"] == "link") & (attr(n, "rel") == "preconnect")).alias("preconnects"),
        F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    d = settled(d)
    h1 = F.trim(says(first(F.filter("heads", lambda n: n["tag"] == "h1"))))
    local = of_type(*LOCAL)
    scope = F.coalesce(first(tagged("main")), first(every(lambda n: attr(n, "role") == "main")), F.col("body"))
    return settled(d.select(
        "*",
        says(F.col("body")).alias("raw"),
        flat(says(F.col("body"))).alias("said"),
        flat(without(first(NODES), F.col("hidden"))).alias("seen"),
        flat(without(scope, tagged("header", "footer", "nav", "form"))).alias("content"),
        h1.alias("h1"),
        first(local)["v"].alias("lb"),
        F.coalesce(first(of_type("Organization"))["v"], first(local)["v"]).alias("org"),
        F.coalesce(first(of_type("Organization"))["types"], first(local)["types"]).alias("org_types"),
        F.filter(F.coalesce(first(local)["types"], F.array()), lambda t: t.isin(*LOCAL)).alias("lb_types"),
        F.array_distinct(F.flatten(F.transform("things", lambda e: e["types"]))).alias("types"),
        F.coalesce(F.try_variant_get(first(F.filter("things", lambda e: F.arrays_overlap(e["types"], F.array(F.lit("Organization"), *[F.lit(t) for t in LOCAL]))))["v"], "$.name", "string"), F.lit("")).alias("brand"),
    ))


def typed(d: DataFrame) -> DataFrame:
    """With addressed, open_hours, medical, and the type that the best evidence gives (page_type, confidence, reason).

    Structured data with what it speaks of outranks what the page is built of, that the URL's first fitting pattern.
    """
    d = d.select(
        "*",
        (F.exists(NODES, lambda n: classed(n, "address") | (attr(n, "itemprop") == "address")) | F.col("raw").rlike(STREET) | F.col("raw").rlike(ZIP)).alias("addressed"),
        (F.exists(NODES, lambda n: classed(n, "hours", "timings")) | F.col("raw").rlike(HOURS)).alias("open_hours"),
        (F.arrays_overlap("types", F.array(*[F.lit(t) for t in MEDICAL])) | F.substring("raw", 1, 2000).rlike("(?i)medical|dental|dentist|physician|clinic|healthcare|patient")).alias("medical"),
        F.exists("frames", lambda n: attr(n, "src").rlike(r"google\.com/maps|maps\.google")).alias("mapped"),
        F.exists("entities", lambda e: F.lower(e["json"]).contains("postaladdress")).alias("postal"),
    )
    d = settled(d)
    overlap = lambda types: F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))
    built = (F.size(tagged("article")) > 0) & F.exists(NODES, lambda n: (attr(n, "rel") == "author") | classed(n, "byline", "author")) & F.exists(NODES, lambda n: (n["tag"] == "time") & given(n, "datetime"))
    ranked = [
        ("location", 90, "business and place", F.col("lb").isNotNull() & (F.col("mapped") | F.col("addressed") | F.col("postal") | F.col("open_hours"))),
        ("article", 85, "article schema", overlap(ARTICLES)),
        ("article", 85, "article with author and time", built),
        ("product", 85, "product schema", overlap(("Product",))),
        *[(kind, 70, "url", F.col("url").rlike(pattern)) for kind, pattern in URL_TYPES],
        ("other", 50, "none", F.lit(True)),
    ]
    rows = F.array(*[F.when(F.coalesce(met, F.lit(False)), F.struct(F.lit(sure).alias("sure"), F.lit(-k).alias("order"), F.lit(kind).alias("page_type"), F.lit(why).alias("reason"))) for k, (kind, sure, why, met) in enumerate(ranked)])
    best = F.array_max(rows)
    return d.select("*", best["page_type"].alias("page_type"), (best["sure"] / 100).alias("confidence"), best["reason"].alias("reason"))


def signals(pages: DataFrame, as_of: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page with all that the rules name. Dates are judged as of the day ``as_of``."""
    d = grown(pages, id_col, url_col, html_col)
    href, src = (lambda n: attr(n, "href")), (lambda n: attr(n, "src"))
    containers = F.filter(F.array(first(tagged("main")), first(tagged("article")), first(every(lambda n: classed(n, "content"))), first(every(lambda n: classed(n, "body"))), F.col("body")), lambda n: n.isNotNull())
    chrome = every(lambda n: classed(n, *NOT_OPENING) | n["tag"].isin("header", "nav", "aside", "footer"))
    openings = F.filter("paras", lambda p: ~F.exists("chrome", lambda m: (m["k"] == p["k"]) | inside(p, m)) & (F.size(words(says(p))) >= 20))
    d = settled(d.select("*", containers.alias("containers"), chrome.alias("chrome")))
    d = settled(d.select("*", openings.alias("openings")))
    opening = first(F.flatten(F.transform("containers", lambda c: F.slice(F.filter("openings", lambda p: inside(p, c)), 1, 1))))
    team = every(lambda n: classed(n, "team", "staff", "doctor", "provider"))
    area = first(every(lambda n: n["tag"].isin("main", "article") | classed(n, "content", "post-body")))
    structural = F.trim(says(first(every(lambda n: (attr(n, "rel") == "author") | classed(n, "author", "byline") | (attr(n, "itemprop") == "author")))))
    d = d.select(
        "*",
        F.trim(says(F.coalesce(opening, first(F.col("paras"))))).alias("lede"),
        area.alias("area"),
        team.alias("team"),
        structural.alias("structural"),
        F.size(words(F.col("said"))).alias("wc"),
        F.split("said", r"(?<=[.!?])\s+").alias("sentences"),
    )
    d = settled(d)
    byline = F.regexp_extract(says(F.col("area")), r"(?i)\b(by|written by|author:)\s+([A-Z][a-z]+ [A-Z][a-z]+)", 2)
    own_team = F.concat_ws("", F.transform(F.filter("team", lambda n: inside(n, F.col("area"))), says))
    d = d.select("*", F.when((F.col("structural") != "") & ~F.lower("structural").isin(*NOBODY), F.col("structural")).when((byline != "") & ~F.contains(own_team, byline), byline).otherwise("").alias("author"))
    outward = F.filter("links", lambda n: F.startswith(href(n), F.lit("http")))
    og_host = F.coalesce(F.nullif(F.get(F.split(attr(first(every(lambda n: (n["tag"] == "meta") & (attr(n, "property") == "og:url"))), "content"), "/"), F.lit(2)), F.lit("")), F.lit("__none__"))
    quotes = every(lambda n: n["tag"].isin("blockquote", "q", "cite") | classed(n, "quote", "testimonial"))
    beside = lambda n: F.concat_ws("", F.transform(F.filter(NODES, lambda m: (m["k"] == n["last"] + 1) & (m["parent"] == n["parent"])), says))
    promotion = F.aggregate(
        F.filter("sentences", lambda s: ~s.rlike(SUBSTANTIATED)),
        F.lit(0),
        lambda acc, s: acc + sum((F.regexp_count(s, F.lit(rf"(?i)(^|[^\w-]){_escaped(w)}(?![\w-])")) for w in PROMOTION), F.lit(0)),
    )
    common = F.transform(F.filter(words(F.lower("said")), lambda w: (F.length(w) > 4) & ~w.isin(*STOP)), lambda w: stem(F.regexp_replace(w, "[^a-zA-Z]", "")))
    old_year = F.exists(F.split("said", "[.!?]+"), lambda s: ~s.rlike(OTHER_YEARS) & any_of(s, STATISTICS) & F.exists(F.regexp_extract_all(s, F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int") <= F.year(F.lit(as_of).cast("date")) - 3))
    question = lambda n: n["tag"].isin("h2", "h3") & F.endswith(F.trim(says(n)), F.lit("?"))
    faq_items = listed(first(of_type("FAQPage"))["v"], "mainEntity")
    asked = lambda i: (plain(i, "@type") == "Question") & true(i, "acceptedAnswer")
    hours = listed(F.col("lb"), "openingHoursSpecification")
    days = lambda o: F.when(true(o, "dayOfWeek"), listed(o, "dayOfWeek")).otherwise(listed(o, "canceldayOfWeek"))
    wrong_hours = lambda o: true(o, "canceldayOfWeek") | ~(true(o, "opens") & true(o, "closes")) | F.exists(days(o), lambda x: ~F.coalesce(F.try_variant_get(x, "$", "string").rlike(DAYS), F.lit(False)))
    one = lambda v: F.try_variant_get(v, "$.sameAs", "string")
    many = lambda v: F.try_variant_get(v, "$.sameAs", "array<string>")
    profiles = F.transform(of_type("Organization", "WebSite", *LOCAL), lambda e: F.coalesce(many(e["v"]), F.split(one(e["v"]), r"[,\s]+"), F.array().cast("array<string>")))
    same_as = F.array_distinct(F.filter(F.transform(F.flatten(profiles), F.trim), lambda u: u.rlike("(?i)^https?://")))
    article, person = first(of_type(*ARTICLES))["v"], first(of_type("Person"))["v"]
    rating = F.coalesce(F.filter(F.array(F.when(true(F.col("lb"), "aggregateRating"), F.col("lb"))), lambda v: v.isNotNull()), F.array().cast("array<variant>"))
    rated = F.coalesce(F.get(rating, F.lit(0)), first(F.filter("things", lambda e: true(e["v"], "aggregateRating")))["v"])
    modified = F.coalesce(F.nullif(plain(article, "dateModified"), F.lit("")), F.nullif(plain(first(F.filter("things", lambda e: true(e["v"], "dateModified")))["v"], "dateModified"), F.lit("")), F.nullif(attr(first(every(lambda n: (n["tag"] == "meta") & (attr(n, "property") == "article:modified_time"))), "content"), F.lit("")), F.nullif(attr(first(every(lambda n: (n["tag"] == "time") & given(n, "datetime"))), "datetime"), F.lit("")), F.lit(""))
    labelled = F.transform(tagged("label"), lambda n: attr(n, "for"))
    decorative = lambda n: (
        attr(n, "role").isin("presentation", "none") | F.exists("plain_boxes", lambda m: inside(n, m)) | (attr(n, "aria-hidden") == "true") | attr(n, "class").rlike(r"(?i)\b(icon|spacer|pixel|separator|decoration|divider|bg)\b") | src(n).rlike(r"(?i)icon|logo|spacer|pixel|dot\.gif|blank")
        | attr(n, "width").rlike("^0*[1-4]([^0-9]|$)") | attr(n, "height").rlike("^0*[1-4]([^0-9]|$)")
    )
    host_of = lambda u: F.regexp_extract(u, r"^https?://([^/?#:]*)", 1)
    elsewhere = F.array_distinct(F.filter(F.transform(NODES, lambda n: host_of(F.when(F.startswith(src(n), F.lit("http")), src(n)).otherwise(href(n)))), lambda h: h != ""))
    video = F.exists("frames", lambda n: src(n).rlike(r"youtube\.com|vimeo\.com"))
    d = settled(d.withColumn("plain_boxes", every(lambda n: attr(n, "role") == "presentation")))
    d = settled(typed(d).select("*", same_as.alias("same_as"), modified.alias("modified")))
    d = d.select(
        "page",
        "url",
        F.when(F.col("page_type").isin(*SELLING), "commercial").otherwise("informational").alias("intent"),
        "page_type",
        "wc",
        (F.col("medical") | F.arrays_overlap("types", F.array(*[F.lit(t) for t in (*LEGAL, *FINANCIAL)]))).alias("ymyl"),
        (100 * F.length("said") / F.greatest(F.length("html"), F.lit(1))).alias("text_share"),
        (100 * F.length("seen") / F.greatest(F.length("html"), F.lit(1))).alias("seen_share"),
        F.size(words(F.col("seen"))).alias("seen_words"),
        F.size(words(F.col("lede"))).alias("lede_words"),
        F.col("lede").rlike("[.!?]$").alias("lede_ends"),
        F.coalesce((F.get(F.split(F.lower("h1"), WS), F.lit(0)) != "") & F.contains(F.lower(F.array_join(F.slice(words(F.col("said")), 1, F.floor(F.col("wc") * 0.3).cast("int")), " ")), F.get(F.split(F.lower("h1"), WS), F.lit(0))), F.lit(False)).alias("early"),
        "author",
        F.coalesce(href(first(F.filter(within(tagged("a"), F.col("authors")), lambda n: n["tag"] == "a"))), F.lit("")).alias("author_link"),
        ((F.coalesce(F.nullif(attr(first(tagged("time")), "datetime"), F.lit("")), says(first(tagged("time")))) != "") | F.col("html").rlike(DATED) | F.contains(F.lower("html"), F.lit("datepublished"))).alias("dated"),
        F.col("html").rlike(r"(?i)last\s+updated|updated\s+on|last\s+modified|reviewed\s+on").alias("updated"),
        F.col("html").rlike(r"(?i)last\s+updated|updated\s+on|last\s+modified").alias("updated_text"),
        F.col("html").rlike(r"(?i)reviewed\s+by|medically\s+reviewed|fact.?checked\s+by|legally\s+reviewed").alias("reviewed"),
        F.size(F.filter(quotes, lambda n: (F.length(F.trim(says(n))) >= 60) & F.concat(F.trim(says(n)), F.lit(" "), beside(n)).rlike(CREDENTIALS))).alias("expert_quotes"),
        F.size(F.filter(F.split("content", "[.!?]+"), statistic)).alias("statistics"),
        F.regexp_count("said", F.lit(ATTRIBUTED)).alias("sourced"),
        F.size(F.filter(outward, lambda n: ~F.contains(href(n), og_host) & contains_any(href(n), SOURCES))).alias("primary"),
        F.size(F.filter(outward, lambda n: ((F.col("host") == "") | ~F.contains(href(n), F.col("host"))) & contains_any(href(n), SOURCES))).alias("primary_out"),
        F.size(F.filter("links", lambda n: contains_any(href(n), SOURCES))).alias("primary_all"),
        F.size(F.filter("tables", lambda t: F.exists(NODES, lambda n: (n["tag"] == "th") & inside(n, t)))).alias("headed_tables"),
        F.size(F.filter("tables", lambda t: ~F.exists(NODES, lambda n: (n["tag"] == "th") & inside(n, t)))).alias("bare_tables"),
        F.size(F.filter("tables", lambda t: ~F.exists(NODES, lambda n: (n["tag"] == "th") & inside(n, t)) & (F.size(F.filter(NODES, lambda n: (n["tag"] == "td") & inside(n, t))) > 2))).alias("layout_tables"),
        ((F.size("faqs") > 0) | F.exists("heads", lambda n: n["tag"].isin("h2", "h3") & says(n).rlike("(?i)frequently asked|faq"))).alias("faq"),
        F.size("faqs").alias("faq_boxes"),
        F.size(F.filter("heads", question)).alias("questions"),
        F.coalesce((plain(F.col("org"), "name") != "") & F.contains(F.lower("lede"), F.lower(plain(F.col("org"), "name"))), F.lit(False)).alias("brand_early"),
        promotion.alias("promotion"),
        (100 * most_frequent(common) / F.greatest(F.col("wc"), F.lit(1))).alias("density"),
        F.size(F.filter("heads", lambda n: n["tag"] == "h2")).alias("h2s"),
        F.size(F.filter("hidden", lambda n: F.size(words(says(n))) > 20)).alias("hidden_blocks"),
        old_year.alias("old_year"),
        # structured data
        F.size("linked").alias("blocks"),
        "broken",
        F.size("types").alias("n_types"),
        F.col("org").isNotNull().alias("org"),
        *[true(F.col("org"), p).alias(f"org_{p}") for p in ("name", "url", "logo", "description")],
        F.size("same_as").alias("profiles"),
        *[F.contains(F.array_join("same_as", " "), F.lit(site)).alias(f"on_{name}") for name, site in (("linkedin", "linkedin.com"), ("wikidata", "wikidata.org"), ("youtube", "youtube.com"))],
        (true(F.col("org"), "@id") | F.exists("things", lambda e: true(e["v"], "@id"))).alias("any_id"),
        true(F.col("org"), "@id").alias("org_id"),
        article.isNotNull().alias("article"),
        *[true(article, p).alias(f"article_{p}") for p in ("author", "datePublished", "dateModified")],
        (F.size(of_type("FAQPage")) > 0).alias("faq_schema"),
        F.forall(faq_items, lambda i: asked(i) & (plain(i, "acceptedAnswer", "@type") == "Answer")).alias("faq_exact"),
        ((F.size(of_type("FAQPage")) > 0) & (F.size(faq_items) > 0) & F.forall(faq_items, asked)).alias("faq_valid"),
        person.isNotNull().alias("person"),
        (true(person, "name") & true(person, "jobTitle") & true(person, "affiliation") & true(person, "sameAs")).alias("person_whole"),
        F.size(F.filter(of_type("Person"), lambda e: true(e["v"], "name") & true(e["v"], "jobTitle"))).alias("practitioners"),
        F.col("lb").isNotNull().alias("lb"),
        F.coalesce(F.get("lb_types", F.lit(0)), F.lit("")).alias("lb_type"),
        *[true(F.col("lb"), p).alias(f"lb_{p}") for p in ("address", "telephone", "geo")],
        F.coalesce(F.size(hours), F.lit(0)).alias("lb_hours"),
        F.coalesce(F.size(F.filter(hours, wrong_hours)), F.lit(0)).alias("wrong_hours"),
        (true(F.col("lb"), "address", "streetAddress") & true(F.col("lb"), "address", "addressLocality") & true(F.col("lb"), "address", "addressRegion") & true(F.col("lb"), "address", "postalCode")).alias("address_whole"),
        (true(F.col("lb"), "geo", "latitude") & true(F.col("lb"), "geo", "longitude")).alias("placed"),
        (true(F.col("lb"), "areaServed") | true(F.col("lb"), "hasOfferCatalog") | true(F.col("lb"), "makesOffer")).alias("area_served"),
        (rated.isNotNull() | (F.size(of_type("Review")) > 0)).alias("reviewed_schema"),
        (true(rated, "aggregateRating", "ratingValue") & true(rated, "aggregateRating", "reviewCount")).alias("rating_whole"),
        *[(F.size(of_type(t)) > 0).alias(f"has_{t.lower()}") for t in ("Product", "BreadcrumbList", "VideoObject")],
        (F.array_contains("types", "Article") & F.array_contains("types", "Product")).alias("conflict"),
        F.exists(NODES, lambda n: given(n, "itemscope")).alias("microdata"),
        video.alias("video"),
        # accessibility
        F.size(F.filter("imgs", lambda n: ~given(n, "alt"))).alias("no_alt_any"),
        F.size(F.filter("imgs", lambda n: ~given(n, "alt") & ~decorative(n))).alias("no_alt"),
        F.size(F.filter("imgs", lambda n: given(n, "alt") & (F.trim(attr(n, "alt")) == "") & ~decorative(n))).alias("empty_alt"),
        F.size(F.filter(tagged("input"), lambda n: ~attr(n, "type").isin("hidden", "submit", "button") & (attr(n, "aria-label") == "") & ((attr(n, "id") == "") | ~F.array_contains(labelled, attr(n, "id"))))).alias("unlabelled"),
        F.size(F.filter(tagged("button"), lambda n: (F.trim(says(n)) == "") & (attr(n, "aria-label") == "") & ~F.exists("imgs", lambda i: given(i, "alt") & inside(i, n)))).alias("mute_buttons"),
        F.size(F.filter("links", lambda n: (F.trim(says(n)) == "") & ~F.exists("imgs", lambda i: given(i, "alt") & inside(i, n)))).alias("mute_links"),
        F.size(F.filter("frames", lambda n: attr(n, "title") == "")).alias("untitled_frames"),
        F.size(F.filter(tagged("video"), lambda n: ~F.exists(NODES, lambda t: (t["tag"] == "track") & (attr(t, "kind") == "captions") & inside(t, n)))).alias("uncaptioned"),
        F.exists("links", lambda n: href(n).isin("#main", "#content", "#maincontent")).alias("skip_link"),
        attr(first(tagged("html")), "lang").alias("lang"),
        # authorship
        F.col("html").rlike(r"""(?i)rel=["']author["']|class=["'][^"']*author[^"']*["']|written\s+by|by\s+[A-Z][a-z]+\s+[A-Z][a-z]+""").alias("byline_text"),
        F.col("html").rlike(CREDENTIALS).alias("credentials"),
        F.col("html").rlike(r"\b(20\d{2})\b").alias("any_year"),
        F.col("html").rlike(r"(?i)license\s+#|license\s+number|board\s+certified").alias("licensed"),
        F.col("html").rlike("(?i)editorial policy|review policy|fact.?check").alias("policy"),
        F.exists("links", lambda n: F.contains(href(n), F.lit("/about"))).alias("about_link"),
        (F.col("html").rlike(PHONE) | F.exists("links", lambda n: href(n).rlike("^(mailto|tel):"))).alias("contact"),
        F.col("html").rlike(PHONE).alias("phone"),
        (F.exists("links", lambda n: F.contains(href(n), F.lit("privacy"))) | F.col("html").rlike("(?i)privacy policy")).alias("privacy"),
        # security
        F.exists(NODES, lambda n: (n["tag"].isin("img", "script") & F.startswith(src(n), F.lit("http://"))) | ((n["tag"] == "link") & F.startswith(href(n), F.lit("http://")))).alias("mixed"),
        F.exists("frames", lambda n: F.startswith(src(n), F.lit("http://"))).alias("plain_frames"),
        F.size(F.filter(tagged("script"), lambda n: F.startswith(src(n), F.lit("http")) & ~src(n).rlike(KNOWN_SCRIPTS))).alias("unknown_scripts"),
        F.size(F.filter("links", lambda n: href(n).rlike(r"(?i)[?&](ref|aff|affiliate|redirect)=|/go/|/out/|^data:"))).alias("obfuscated"),
        F.size(F.filter("comments", lambda c: c.rlike(PRIVATE + "|internal"))).alias("private_comments"),
        F.size(F.filter("comments", lambda c: c.rlike(PRIVATE))).alias("private_notes"),
        # answers
        F.col("modified").alias("modified"),
        F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.try_to_timestamp("modified").cast("date")), F.lit(2**30)).alias("modified_days"),
        F.exists(tagged("div", "section"), lambda n: (F.length(F.trim(says(n))) > 500) & F.exists("frames", lambda m: (m["parent"] == n["parent"]) & (m["last"] + 1 == n["k"]))).alias("transcript"),
        F.col("html").rlike(r"(?i)llms\.txt").alias("llms"),
        (F.col("lb").isNotNull() | F.col("html").rlike(PHONE) | F.col("addressed") | F.col("open_hours")).alias("local_signals"),
        F.exists(NODES, lambda n: classed(n, "review", "rating", "star") | (attr(n, "itemprop") == "review") | given(n, "data-rating")).alias("review_text"),
        # rest
        F.exists(NODES, lambda n: (n["tag"] == "link") & attr(n, "rel").isin("icon", "shortcut icon")).alias("favicon"),
        F.exists(NODES, lambda n: classed(n, "breadcrumb") | F.contains(attr(n, "id"), F.lit("breadcrumb")) | ((n["tag"] == "nav") & F.contains(attr(n, "aria-label"), F.lit("breadcrumb")))).alias("breadcrumb"),
        F.size(F.filter("links", lambda n: href(n).rlike(r"(?i)[?&](ref|aff|affiliate)=|shareasale|clickbank|cj\.com"))).alias("affiliate"),
        F.size("links").alias("n_links"),
        F.exists(NODES, lambda n: (n["tag"] == "meta") & given(n, "charset")).alias("charset"),
        most_frequent(F.filter(F.transform(F.split(F.lower(says(first(tagged("title")))), WS), stem), lambda w: F.length(w) > 3)).alias("title_repeats"),
        most_frequent(F.filter(F.transform(F.split(F.lower(F.array_join(F.transform("heads", says), " ")), WS), lambda w: stem(F.regexp_replace(w, "[^a-zA-Z]", ""))), lambda w: F.length(w) > 3)).alias("head_repeats"),
        F.size(F.filter("imgs", lambda n: most_frequent(F.filter(F.transform(F.split(F.lower(attr(n, "alt")), WS), stem), lambda w: F.length(w) > 3)) >= 3)).alias("stuffed_alts"),
        most_frequent(F.transform(F.filter(F.split(F.lower("path"), "[/-]"), lambda w: w != ""), stem)).alias("path_repeats"),
        F.size(F.array_except(elsewhere, F.transform("preconnects", lambda n: host_of(href(n))))).alias("unhinted"),
        (src(first(within(F.col("imgs"), tagged("main", "article")))) != "").alias("main_image"),
        F.exists(NODES, lambda n: (n["tag"] == "link") & (attr(n, "rel") == "preload") & (attr(n, "as") == "image")).alias("image_preload"),
        F.aggregate(F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<script\b[^>]*>.*?)</script\s*>"), 1), lambda x: ~x.rlike(r"(?is)^<script[^>]*\s(src\s*=|type\s*=\s*[\"']?application/ld)")), F.lit(0), lambda acc, x: acc + F.length(x) - F.instr(x, ">")).alias("script_chars"),
    )
    d = settled(d)
    return d.fillna(False, subset=[f.name for f in d.schema if f.dataType.simpleString() == "boolean"])


SELLS, BLUF, THIN = "intent = 'commercial'", "lede_words >= CASE WHEN intent = 'commercial' THEN 25 ELSE 40 END AND lede_ends", "CASE WHEN intent = 'commercial' THEN 150 ELSE 300 END"
IN_BAND = "BETWEEN CASE WHEN intent = 'commercial' THEN 350 ELSE 800 END AND CASE WHEN intent = 'commercial' THEN 1200 ELSE 1500 END"
QUOTE = {SELLS: "A", "author = ''": "W"}

#: As in page_checks, with A for what doesn't apply.
RULES: list[tuple[str, str, dict[str, str]]] = [
    ("A7", "Title Tag", {"title_repeats >= 3": "W"}),
    ("E13", "Headings", {"head_repeats >= 3": "W"}),
    ("F1", "Content Quality", {"true": "I"}),
    ("F2", "Content Quality", {f"wc < {THIN}": "F"}),
    ("F3", "Content Quality", {f"{SELLS} AND wc BETWEEN 150 AND 349": "N", f"NOT {SELLS} AND wc BETWEEN 300 AND 599": "W"}),
    ("F4", "Content Quality", {f"wc {IN_BAND}": "P", "wc > 3000": "N", "true": "I"}),
    ("F5", "Content Quality", {"text_share < 5": "F", "text_share < 10": "W"}),
    ("F6", "Content Quality", {f"NOT ({BLUF})": "W"}),
    ("F7", "Content Quality", {"NOT early": "N"}),
    ("F8", "Content Quality", QUOTE),
    ("F9", "Content Quality", QUOTE),
    ("F10", "Content Quality", {SELLS: "A", "NOT (author_link LIKE '%/author/%' OR author_link LIKE '%/about/%')": "N"}),
    ("F11", "Content Quality", {SELLS: "A", "NOT dated": "N"}),
    ("F12", "Content Quality", {"NOT updated": "N"}),
    ("F13", "Content Quality", {f"{SELLS} AND NOT ymyl": "A", "NOT reviewed": "N"}),
    ("F14", "Content Quality", {SELLS: "A", "expert_quotes = 0": "W"}),
    ("F15", "Content Quality", {SELLS: "A", "statistics < 4": "W"}),
    ("F16", "Content Quality", {SELLS: "A", "sourced = 0": "W"}),
    ("F17", "Content Quality", {SELLS: "A", "primary = 0": "W"}),
    ("F18", "Content Quality", {"headed_tables = 0": "N"}),
    ("F19", "Content Quality", {"NOT faq": "N"}),
    ("F20", "Content Quality", {"NOT brand_early": "N"}),
    ("F21", "Content Quality", {"promotion > 0": "W"}),
    ("F22", "Content Quality", {"density > 4": "W"}),
    ("F23", "Content Quality", {"wc > 5000 AND h2s < 5": "W"}),
    ("F24", "Content Quality", {"wc > 3000": "N"}),
    ("F25", "Content Quality", {"hidden_blocks > 0": "F"}),
    ("F26", "Content Quality", {SELLS: "A", "old_year": "W"}),
    ("F27", "Content Quality", {SELLS: "A", "true": "I"}),
    ("F28", "Content Quality", {"true": "I"}),
    ("G1", "Images", {"no_alt > 0": "F"}),
    ("G2", "Images", {"empty_alt > 0": "W"}),
    ("G4", "Images", {"stuffed_alts > 0": "W"}),
    ("I5", "External Links", {SELLS: "A", "primary_out < 3": "N"}),
    ("J1", "Schema", {"blocks = 0": "W"}),
    ("J2", "Schema", {"true": "I"}),
    ("J3", "Schema", {"broken > 0": "F"}),
    ("J4", "Schema", {"NOT org": "W"}),
    ("J5", "Schema", {"NOT org": "S", "NOT org_name": "F"}),
    *[(f"J{k}", "Schema", {"NOT org": "S", f"NOT org_{p}": "W"}) for k, p in ((6, "url"), (7, "logo"), (8, "description"))],
    ("J9", "Schema", {"NOT org": "S", "profiles = 0": "W"}),
    *[(f"J{k}", "Schema", {"NOT org": "S", f"NOT on_{p}": "N"}) for k, p in ((10, "linkedin"), (11, "wikidata"), (12, "youtube"))],
    ("J13", "Schema", {"NOT org": "S", "NOT any_id": "W"}),
    ("J14", "Schema", {"article": "P", SELLS: "A", "true": "N"}),
    ("J15", "Schema", {"article AND NOT article_author": "F", "article": "P", SELLS: "A", "true": "S"}),
    *[(f"J{k}", "Schema", {f"article AND NOT article_{p}": "W", "article": "P", SELLS: "A", "true": "S"}) for k, p in ((16, "datePublished"), (17, "dateModified"))],
    ("J18", "Schema", {"NOT faq_schema": "N"}),
    ("J19", "Schema", {"NOT faq_schema": "S", "NOT faq_exact": "F"}),
    ("J20", "Schema", {"NOT person": "N"}),
    ("J21", "Schema", {"NOT person": "S", "NOT person_whole": "W"}),
    ("J22", "Schema", {"lb AND wrong_hours > 0": "F", "lb": "P", SELLS: "W", "true": "A"}),
    ("J23", "Schema", {"NOT lb": "S", f"{SELLS} AND NOT (lb_address AND lb_telephone)": "F", "NOT (lb_address AND lb_telephone AND lb_geo AND lb_hours > 0 AND profiles > 0)": "W"}),
    ("J24", "Schema", {"NOT has_product": "I"}),
    ("J25", "Schema", {"NOT has_breadcrumblist": "N"}),
    ("J26", "Schema", {"video AND NOT has_videoobject": "W", "NOT has_videoobject": "A"}),
    ("J27", "Schema", {"true": "I"}),
    ("J28", "Schema", {"microdata": "W"}),
    ("J29", "Schema", {"conflict": "W"}),
    ("J30", "Schema", {"true": "I"}),
    ("J31", "Schema", {"true": "I"}),
    ("M15", "Technical", {"script_chars > 10000": "N"}),
    ("N6", "URL Signals", {"url = ''": "S", "path_repeats >= 3": "W"}),
    ("O6", "Page Speed", {"unhinted > 0": "N"}),
    ("O7", "Page Speed", {"main_image AND NOT image_preload": "N"}),
    ("P8", "Semantic HTML", {"bare_tables > 0": "W"}),
    ("P9", "Semantic HTML", {"layout_tables > 0": "W"}),
    ("Q1", "Accessibility", {"no_alt_any > 0": "F"}),
    *[(f"Q{k}", "Accessibility", {f"{s} > 0": "W"}) for k, s in ((2, "unlabelled"), (3, "mute_buttons"), (4, "mute_links"), (5, "untitled_frames"), (6, "uncaptioned"))],
    ("Q7", "Accessibility", {"true": "I"}),
    ("Q8", "Accessibility", {"NOT skip_link": "N"}),
    ("Q9", "Accessibility", {"lang = ''": "F"}),
    ("R1", "E-E-A-T", {SELLS: "A", "NOT byline_text": "W"}),
    ("R2", "E-E-A-T", {SELLS: "A", "NOT (author_link LIKE '%/author/%' OR author_link LIKE '%/about/%')": "W"}),
    ("R3", "E-E-A-T", {f"{SELLS} AND NOT ymyl": "A", "NOT credentials": "N"}),
    ("R4", "E-E-A-T", {SELLS: "A", "NOT any_year": "N"}),
    ("R5", "E-E-A-T", {"NOT updated_text": "N"}),
    ("R6", "E-E-A-T", {"NOT licensed": "N"}),
    ("R7", "E-E-A-T", {SELLS: "A", "primary_all = 0": "N"}),
    ("R8", "E-E-A-T", {"NOT about_link": "N"}),
    ("R9", "E-E-A-T", {"NOT contact": "W"}),
    ("R10", "E-E-A-T", {"NOT privacy": "N"}),
    ("R11", "E-E-A-T", {SELLS: "A", "NOT policy": "N"}),
    ("R12", "E-E-A-T", {"practitioners > 0": "P", f"{SELLS} AND ymyl": "W", "true": "A"}),
    ("S1", "Security", {"mixed": "F"}),
    ("S2", "Security", {"plain_frames": "W"}),
    ("S3", "Security", {"unknown_scripts > 0": "N"}),
    ("S4", "Security", {"hidden_blocks > 0": "F"}),
    ("S5", "Security", {"obfuscated > 0": "W"}),
    ("S6", "Security", {"private_comments > 0": "N"}),
    ("T1", "GEO Signals", {"seen_share < 15": "W"}),
    ("T2", "GEO Signals", {"questions + faq_boxes > 0": "P", SELLS: "W", "true": "N"}),
    ("T3", "GEO Signals", {"answerability < 4": "W", "answerability < 7": "N"}),
    ("T4", "GEO Signals", {f"modified = '' AND {SELLS}": "N", "modified = '' OR modified_days >= 365": "W"}),
    ("T5", "GEO Signals", {"video AND NOT has_videoobject": "W", "NOT has_videoobject": "A"}),
    ("T6", "GEO Signals", {"NOT video": "A", "NOT transcript": "N"}),
    ("T7", "GEO Signals", {"NOT llms": "N"}),
    ("T8", "GEO Signals", {f"seen_words {IN_BAND}": "P", f"seen_words < {THIN}": "F", "seen_words > 3000": "N", "true": "I"}),
    ("T9", "GEO Signals", {"true": "I"}),
    ("T10", "GEO Signals", {"profiles < 3": "W"}),
    ("T11", "GEO Signals", {f"NOT ({SELLS} AND local_signals)": "A", "lb_telephone AND address_whole": "P", "lb_address": "W", "true": "F"}),
    ("T12", "GEO Signals", {f"NOT ({SELLS} AND local_signals)": "A", "lb_hours > 0 AND wrong_hours = 0": "P", "lb_hours > 0": "F", "true": "W"}),
    ("T13", "GEO Signals", {f"NOT {SELLS}": "A", "rating_whole OR (reviewed_schema AND NOT local_signals)": "P", "reviewed_schema OR NOT local_signals": "N", "review_text": "W", "true": "N"}),
    ("T14", "GEO Signals", {f"NOT ({SELLS} AND local_signals)": "A", "NOT area_served": "N"}),
    ("U1", "Miscellaneous", {"NOT favicon": "N"}),
    ("U2", "Miscellaneous", {"true": "I"}),
    ("U3", "Miscellaneous", {"NOT breadcrumb": "N"}),
    ("U4", "Miscellaneous", {"private_notes > 0": "N"}),
    ("U5", "Miscellaneous", {"affiliate > 10": "W", "true": "I"}),
    ("U6", "Miscellaneous", {"n_links > 100": "W", "true": "I"}),
    ("U7", "Miscellaneous", {"NOT charset": "W"}),
    ("U8", "Miscellaneous", {"NOT llms": "N"}),
]
STATUSES = OUTCOMES | {"A": ("na", "none")}


def answerability(s: DataFrame) -> DataFrame:
    """With earned, most and answerability (0..10): of pages that sell by name, address and phone, hours and place, proof,
    entity links and fluency, of others by citations, statistics, quotations, authorship and fluency. What local
    facts would earn counts only where a page has a reason for them."""
    pt = lambda c: F.when(F.expr(c), 1).otherwise(0)
    two = lambda whole, part: F.when(F.expr(whole), 2).when(F.expr(part), 1).otherwise(0)
    here = F.when(F.col("local_signals"), two("lb_telephone AND address_whole", "lb_address") + pt("lb_hours > 0 AND wrong_hours = 0") + pt("placed")).otherwise(0)
    selling = here + two("rating_whole", "reviewed_schema") + pt("profiles >= 3") + pt("org_id AND lb AND lb_type <> 'LocalBusiness'") + pt("promotion = 0") + pt(f"({BLUF}) AND (questions >= 3 OR faq_valid)")
    telling = two("sourced > 0", "statistics > 0") + two("statistics >= 4", "statistics >= 2") + F.when(F.expr("expert_quotes > 0"), 2).otherwise(0) + F.when(F.expr("author <> ''"), 2).otherwise(0) + two("promotion = 0", "promotion < 3")
    sells = F.expr(SELLS)
    out = s.select("*", F.when(sells, selling).otherwise(telling).alias("earned"), F.when(sells & ~F.col("local_signals"), 6).otherwise(10).alias("most"))
    return out.withColumn("answerability", F.floor(10 * F.col("earned") / F.col("most") + 0.5).cast("int"))


def outcomes(signal_rows: DataFrame, *beside: str) -> DataFrame:
    """page, id, category, status, severity of every page and rule, and the columns ``beside``."""
    s = answerability(signal_rows)
    results = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), F.expr(case(w)).alias("o")) for i, c, w in RULES])
    table = F.create_map(*[x for o, (status, severity) in STATUSES.items() for x in (F.lit(o), F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity")))])
    rows = s.select("page", *beside, F.explode(results).alias("r"))
    return rows.select("page", *beside, "r.id", "r.category", table[F.col("r.o")].alias("v")).select("page", *beside, "id", "category", "v.*")


def page_types(pages: DataFrame, overrides: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, page_type, confidence, reason; ``overrides`` (page, page_type) are sure."""
    found = typed(grown(pages, id_col, url_col, html_col)).select("page", "page_type", "confidence", "reason")
    if overrides is None:
        return found
    own = overrides.select(F.col("page").alias("_page"), F.col("page_type").alias("_own")).dropDuplicates(["_page"])
    both = found.join(own, F.col("page") == F.col("_page"), "left")
    return both.select("page", F.coalesce("_own", "page_type").alias("page_type"), F.when(F.col("_own").isNull(), F.col("confidence")).otherwise(1.0).alias("confidence"), F.when(F.col("_own").isNull(), F.col("reason")).otherwise("given").alias("reason"))


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)
