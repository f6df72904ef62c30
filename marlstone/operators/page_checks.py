"""Checks of raw HTML pages, as rules over signals that one pass over the tags gives.

Comments and the insides of scripts and styles are cut first. A page's tags then
are rows, so that every signal is a count or a first value within one grouping,
and a page of any size is spread over rows. A tag ends at its first ">". Texts of
titles, headings and links are free of tags and of the five basic entities;
lengths are in code points. Relations between nested elements (a decorative
ancestor, a table's own header cells) are not seen.

Null pages count as empty ones; a page without an absolute URL skips the checks
that need it. Every row is a page of its own, also one that repeats another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settled import spread
from ..runtime import read_table
from .checks import page_scores

# Words of promotion, link texts that say nothing, file hosts.
PROMOTION = ("world-class", "leading", "#1", "top-rated", "award-winning", "innovative", "revolutionary", "state-of-the-art", "cutting-edge", "industry-leading", "unmatched", "unbeatable", "game-changing", "disruptive", "amazing", "incredible")
SAYS_NOTHING = ("click here", "here", "read more", "learn more", "more", "this", "link", "page", "this page", "continue", "view more")
FILE_HOSTS = r"cdn\.|cloudfront\.|amazonaws\.|imgix\.|cloudinary\."
DECORATION = r"icon|logo|spacer|pixel|dot\.gif|blank"
DECORATION_CLASS = r"\b(icon|spacer|pixel|separator|decoration|divider|bg)\b"
EMBEDS = r"youtube\.com|vimeo\.com|maps\.google|google\.com/maps"
PLUGINS = r"\.swf|flash|silverlight|java applet"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

# Buckets of a score with their weights and categories, checks that count threefold and once
# (others twice), and failures that bound the score.
BUCKETS = {
    "title_meta": (0.14, ("Title Tag", "Meta Description", "Open Graph")),
    "content_structure": (0.20, ("Headings", "Semantic HTML")),
    "indexability": (0.14, ("Meta Robots", "Canonical", "Hreflang")),
    "technical": (0.09, ("Technical", "URL Signals", "Page Speed")),
    "links_media": (0.07, ("Images", "Internal Links", "External Links")),
}
THREEFOLD = ("A1", "A2", "A9", "C1", "C3", "C10", "D2", "D3", "E1", "E3", "G9", "M5", "M6", "M10", "M21")
ONCE = ("A6", "A8", "B5", "C4", "C5", "C6", "D5", "D7", "G3", "G8", "G12", "H8", "K7", "K8", "K9", "K10", "K11", "K12", "L2", "L3", "L5", "M13", "M14", "M17", "M18", "M20", "N2", "N4", "N7")
BLOCKERS = {"noindex": (["C1", "C3"], 25), "meta_refresh": (["C10"], 40), "no_title": (["A1", "A2"], 60), "no_h1": (["E1", "E3"], 65), "no_viewport": (["M5", "M6"], 65), "canonical_conflict": (["D2"], 70)}

TEXTS = tuple(rf"(?is)(<{t}\b[^>]*>.*?</{t}\s*>)" for t in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "a"))
ATTRIBUTES = ("href", "src", "alt", "rel", "name", "content", "property", "http-equiv", "lang", "loading", "target", "width", "height", "hreflang", "role", "aria-hidden", "class")

#: Signals that are counts: conditions on a tag (named in tag) or an element with its text (named in x), readable by
#: Spark and DuckDB alike.
COUNTS = {
    "titles": "tag = 'title'",
    "descs": "tag = 'meta' AND a_name IN ('description', 'Description')",
    "refreshes": "tag = 'meta' AND lower(a_http_equiv) = 'refresh'",
    "canons": "head AND tag = 'link' AND a_rel = 'canonical'",
    **{f"h{k}s": f"tag = 'h{k}'" for k in range(1, 7)},
    "empty_heads": "x IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') AND inside = ''",
    "imgs": "tag = 'img'",
    "no_alt": "tag = 'img' AND NOT decorative AND NOT has_alt",
    "empty_alt": "tag = 'img' AND NOT decorative AND has_alt AND trim(a_alt) = ''",
    "long_alt": "tag = 'img' AND length(a_alt) > 125",
    "no_dims": "tag = 'img' AND a_width = '' AND a_height = ''",
    "lazy": "tag = 'img' AND a_loading = 'lazy'",
    "old_format": "tag = 'img' AND (lower(a_src) LIKE '%.jpg' OR lower(a_src) LIKE '%.jpeg' OR lower(a_src) LIKE '%.png')",
    "no_src": "tag = 'img' AND trim(a_src) = ''",
    "big_inline": "tag = 'img' AND a_src LIKE 'data:image%' AND length(a_src) > 50000",
    "hotlinked": "tag = 'img' AND a_src LIKE 'http%' AND NOT at_file_host",
    "links": "tag = 'a' AND has_href",
    "nofollow": "tag = 'a' AND internal AND contains(a_rel, 'nofollow')",
    "empty_anchor": "x = 'a' AND internal AND inside = '' AND NOT shows_image",
    "plain_anchor": "x = 'a' AND internal AND lower(inside) IN ('" + "', '".join(SAYS_NOTHING) + "')",
    "script_links": "tag = 'a' AND internal AND (a_href = '#' OR a_href LIKE 'javascript:%') AND has_onclick",
    "hash_links": "tag = 'a' AND a_href LIKE '#%'",
    "plain_http": "tag = 'a' AND outward AND a_href LIKE 'http://%'",
    "open_blank": "tag = 'a' AND a_target = '_blank' AND NOT contains(a_rel, 'noopener')",
    "hreflangs": "tag = 'link' AND a_rel = 'alternate' AND a_hreflang <> ''",
    "bad_hreflangs": "tag = 'link' AND a_rel = 'alternate' AND a_hreflang <> '' AND a_hreflang <> 'x-default' AND NOT language",
    "defaults": "tag = 'link' AND a_rel = 'alternate' AND a_hreflang = 'x-default'",
    "charsets": "tag = 'meta' AND has_charset",
    "viewports": "tag = 'meta' AND a_name = 'viewport'",
    "frames": "tag IN ('frame', 'frameset') OR (tag = 'iframe' AND NOT embed)",
    "elements": "tag <> ''",
    "body_styles": "NOT head AND tag = 'style'",
    "blocking_js": "head AND tag = 'script' AND a_src <> '' AND NOT has_async AND NOT has_defer",
    "blocking_css": "head AND tag = 'link' AND a_rel = 'stylesheet' AND NOT has_media",
    "styles": "tag = 'link' AND a_rel = 'stylesheet'",
    "scripts": "tag = 'script' AND a_src <> ''",
    "hints": "tag = 'link' AND a_rel IN ('preconnect', 'preload', 'prefetch', 'dns-prefetch')",
    "mixed": "(tag IN ('img', 'script') AND a_src LIKE 'http://%') OR (tag = 'link' AND a_href LIKE 'http://%')",
    "semantic": "tag IN ('main', 'nav', 'header', 'footer', 'article', 'section', 'aside', 'figure')",
    "boxes": "tag IN ('div', 'span')",
    **{f"n_{t}": f"tag = '{t}'" for t in ("main", "nav", "header", "footer", "article")},
}
_META = "tag = 'meta' AND {0} = '{1}'"
#: Signals that are first values: what, and of which rows.
FIRSTS = {
    "title": ("inside", "x = 'title'"),
    "h1": ("inside", "x = 'h1'"),
    "descr": ("a_content", COUNTS["descs"]),
    "robots": ("lower(a_content)", "tag = 'meta' AND a_name IN ('robots', 'Robots')"),
    "refresh": ("a_content", COUNTS["refreshes"]),
    "canon": ("a_href", COUNTS["canons"]),
    "viewport": ("a_content", COUNTS["viewports"]),
    "htmllang": ("a_lang", "tag = 'html'"),
    **{f"og_{p}": ("a_content", _META.format("a_property", f"og:{p}")) for p in ("title", "description", "image", "url", "type", "site_name")},
    **{f"tw_{p}": ("a_content", _META.format("a_name", f"twitter:{p}")) for p in ("card", "title", "description", "image")},
}
_ALTERNATE = "tag = 'link' AND a_rel = 'alternate' AND a_hreflang <> '' AND a_hreflang <> 'x-default'"
_LEAST = {**{f"first_h{k}": ("k", f"tag = 'h{k}'") for k in range(2, 7)}, "alt_lo": ("a_href", _ALTERNATE)}
_MOST = {"alt_hi": ("a_href", _ALTERNATE)}

_SEPARATED = "replace(replace(replace(title, '–', '|'), '—', '|'), '-', '|')"
_NO_CANON = "url IS NULL OR canon = ''"


def _late(a: int) -> str:
    return f"coalesce(first_h{a + 1}, 2000000000) < coalesce(first_h{a}, 2000000000)"


#: id, category, and conditions with the outcome of the first that holds: F fail, f fail as a warning,
#: W warning, N notice, I for information, S skipped; P pass where none holds.
RULES: list[tuple[str, str, dict[str, str]]] = [
    ("A1", "Title Tag", {"titles = 0": "F"}),
    ("A2", "Title Tag", {"title = ''": "F"}),
    ("A3", "Title Tag", {"titles = 0": "f", "length(title) < 30": "W"}),
    ("A4", "Title Tag", {"titles = 0": "f", "length(title) > 60": "W"}),
    ("A5", "Title Tag", {"title <> '' AND lower(title) = lower(h1)": "W"}),
    ("A6", "Title Tag", {"titles = 0": "P", f"{_SEPARATED} LIKE '%|%' AND rtrim({_SEPARATED}) NOT LIKE '%|'": "I", "titles > 0": "N"}),
    ("A8", "Title Tag", {r"translate(title, '#$%^*~`@{}[]<>\\', '') <> title": "N"}),
    ("A9", "Title Tag", {"titles > 1": "F"}),
    ("B1", "Meta Description", {"descs = 0": "W"}),
    ("B2", "Meta Description", {"trim(descr) = ''": "W"}),
    ("B3", "Meta Description", {"length(trim(descr)) < 120": "N"}),
    ("B4", "Meta Description", {"length(trim(descr)) > 160": "W"}),
    ("B5", "Meta Description", {" OR ".join(f"contains(lower(descr), '{w}')" for w in PROMOTION): "N"}),
    ("B6", "Meta Description", {"descs <> 1": "W"}),
    ("C1", "Meta Robots", {"contains(robots, 'noindex')": "F"}),
    ("C2", "Meta Robots", {"contains(robots, 'nofollow')": "W"}),
    ("C3", "Meta Robots", {"contains(robots, 'noindex') AND contains(robots, 'nofollow')": "F"}),
    *[(f"C{k}", "Meta Robots", {f"contains(robots, '{w}')": "N"}) for k, w in ((4, "noarchive"), (5, "nosnippet"), (6, "noimageindex"))],
    ("C7", "Meta Robots", {"true": "I"}),
    ("C8", "Meta Robots", {"true": "I"}),
    ("C9", "Meta Robots", {"refreshes > 0": "W"}),
    ("C10", "Meta Robots", {"refreshes > 0 AND NOT refresh_waits": "F"}),
    ("C11", "Meta Robots", {"true": "I"}),
    ("D1", "Canonical", {"canons = 0": "W"}),
    ("D2", "Canonical", {"canons > 1": "F"}),
    ("D3", "Canonical", {"canon = ''": "F"}),
    ("D4", "Canonical", {_NO_CANON: "S", "canon = url": "I"}),
    ("D5", "Canonical", {_NO_CANON: "S", "canon <> url": "N"}),
    ("D6", "Canonical", {_NO_CANON: "S", "canon LIKE 'http://%'": "W"}),
    ("D7", "Canonical", {_NO_CANON: "S", "(url LIKE '%/') <> (canon LIKE '%/')": "N"}),
    ("D8", "Canonical", {"true": "S"}),
    ("D9", "Canonical", {"true": "S"}),
    ("E1", "Headings", {"h1s = 0": "F"}),
    ("E2", "Headings", {"h1s <> 1": "W"}),
    ("E3", "Headings", {"h1 = ''": "F"}),
    ("E4", "Headings", {"h1 <> '' AND lower(title) = lower(h1)": "W"}),
    ("E5", "Headings", {"length(h1) < 20": "N"}),
    ("E6", "Headings", {"length(h1) > 70": "N"}),
    ("E7", "Headings", {"h2s = 0": "N"}),
    ("E8", "Headings", {" OR ".join(_late(k) for k in range(2, 6)): "W"}),
    ("E9", "Headings", {"empty_heads > 0": "W"}),
    *[(f"E{k}", "Headings", {"true": "I"}) for k in (10, 11, 12)],
    ("G1", "Images", {"no_alt + empty_alt > 0": "F"}),
    ("G2", "Images", {"empty_alt > 0": "W"}),
    ("G3", "Images", {"long_alt > 0": "N"}),
    ("G5", "Images", {"true": "I"}),
    ("G6", "Images", {"no_dims > 0": "W"}),
    ("G7", "Images", {"imgs <= 1 OR 10 * lazy >= 8 * (imgs - 1)": "P", "10 * lazy >= 5 * (imgs - 1)": "N", "true": "W"}),
    ("G8", "Images", {"old_format > 0": "N"}),
    ("G9", "Images", {"no_src > 0": "F"}),
    ("G10", "Images", {"big_inline > 0": "W"}),
    ("G11", "Images", {"true": "I"}),
    ("G12", "Images", {"hotlinked > 0": "N"}),
    ("G13", "Images", {"true": "S"}),
    ("H1", "Internal Links", {"true": "I"}),
    ("H2", "Internal Links", {"nofollow > 0": "W"}),
    ("H3", "Internal Links", {}),
    ("H4", "Internal Links", {"true": "S"}),
    ("H5", "Internal Links", {"empty_anchor > 0": "W"}),
    ("H6", "Internal Links", {"plain_anchor > 0": "W"}),
    ("H7", "Internal Links", {"script_links > 0": "W"}),
    ("H8", "Internal Links", {"hash_links > 5": "N"}),
    ("H9", "Internal Links", {"true": "S"}),
    ("H10", "Internal Links", {"true": "S"}),
    ("H11", "Internal Links", {"true": "I"}),
    ("I1", "External Links", {"true": "I"}),
    ("I2", "External Links", {"links > 100": "W"}),
    ("I3", "External Links", {"plain_http > 0": "W"}),
    ("I4", "External Links", {"open_blank > 0": "W"}),
    ("I6", "External Links", {"true": "S"}),
    ("I7", "External Links", {"true": "S"}),
    *[(f"K{k}", "Open Graph", {f"og_{p} = ''": "W"}) for k, p in ((1, "title"), (2, "description"), (3, "image"), (5, "url"))],
    ("K4", "Open Graph", {"true": "S"}),
    ("K6", "Open Graph", {"og_url = '' OR canon = ''": "S", "og_url <> canon": "W"}),
    *[(f"K{k}", "Open Graph", {f"{p} = ''": "N"}) for k, p in ((7, "og_type"), (8, "og_site_name"), (9, "tw_card"), (10, "tw_title"), (11, "tw_description"), (12, "tw_image"))],
    ("L1", "Hreflang", {"true": "I"}),
    ("L2", "Hreflang", {"hreflangs = 0": "S", "bad_hreflangs > 0": "N"}),
    ("L3", "Hreflang", {"hreflangs = 0": "S", "defaults = 0": "N"}),
    ("L4", "Hreflang", {"hreflangs = 0": "S", "true": "I"}),
    ("L5", "Hreflang", {"hreflangs = 0": "S", "canon <> '' AND (alt_lo <> canon OR alt_hi <> canon)": "W"}),
    ("M1", "Technical", {"NOT doctype": "W"}),
    ("M2", "Technical", {"charsets = 0": "W"}),
    ("M3", "Technical", {"htmllang = ''": "W"}),
    ("M4", "Technical", {"NOT good_lang": "W"}),
    ("M5", "Technical", {"viewports = 0": "F"}),
    ("M6", "Technical", {"NOT contains(viewport, 'width=device-width')": "F"}),
    ("M7", "Technical", {"NOT contains(viewport, 'initial-scale=1')": "W"}),
    ("M8", "Technical", {"contains(viewport, 'user-scalable=no')": "W"}),
    ("M9", "Technical", {"frames > 0": "W"}),
    ("M10", "Technical", {"plugins": "F"}),
    ("M11", "Technical", {"kilo > 100": "W"}),
    ("M12", "Technical", {"elements > 1500": "W"}),
    ("M13", "Technical", {"body_styles > 0": "N"}),
    ("M14", "Technical", {"css_chars > 5000": "N"}),
    ("M16", "Technical", {"blocking_js > 0": "W"}),
    ("M17", "Technical", {"styles > 6": "N"}),
    ("M18", "Technical", {"scripts > 10": "N"}),
    ("M19", "Technical", {"blocking_js + blocking_css > 0": "W"}),
    ("M20", "Technical", {"hints = 0": "N"}),
    ("M21", "Technical", {"mixed > 0": "F"}),
    ("M22", "Technical", {"refreshes > 0": "W"}),
    ("N1", "URL Signals", {"host = ''": "S", "length(url) > 115": "W"}),
    ("N2", "URL Signals", {"host = ''": "S", "contains(path, '_')": "N"}),
    ("N3", "URL Signals", {"host = ''": "S", "params > 2": "W"}),
    ("N4", "URL Signals", {"host = ''": "S", "dated": "N"}),
    ("N5", "URL Signals", {"host = ''": "S", "levels > 3": "W"}),
    ("N7", "URL Signals", {"host = ''": "S", "numeric_end": "N"}),
    ("O1", "Page Speed", {"blocking_js > 0": "W"}),
    ("O2", "Page Speed", {"blocking_css > 0": "W"}),
    ("O3", "Page Speed", {"imgs > 3 AND lazy = 0": "W"}),
    ("O4", "Page Speed", {"no_dims > 0": "W"}),
    ("O5", "Page Speed", {"big_inline > 0": "W"}),
    ("O8", "Page Speed", {"kilo > 100": "W"}),
    ("P1", "Semantic HTML", {"n_main = 0": "W"}),
    *[(f"P{k}", "Semantic HTML", {f"n_{t} = 0": "N"}) for k, t in ((2, "nav"), (3, "header"), (4, "footer"), (5, "article"))],
    ("P6", "Semantic HTML", {"true": "I"}),
    ("P7", "Semantic HTML", {"boxes > 0 AND 10 * semantic < boxes": "W"}),
    ("P10", "Semantic HTML", {"true": "I"}),
    ("P11", "Semantic HTML", {"true": "I"}),
]
OUTCOMES = {"P": ("pass", "none"), "N": ("notice", "notice"), "W": ("warning", "warning"), "F": ("fail", "error"), "f": ("fail", "warning"), "I": ("informational", "none"), "S": ("skipped", "none")}


def case(conditions: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {c} THEN '{o}'" for c, o in conditions.items())
    return f"CASE {whens} ELSE 'P' END" if whens else "'P'"


def attribute(name: str) -> Column:
    """Value of a tag's attribute; empty where it is absent or has none."""
    value = F.regexp_extract("attrs", rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)", 1)
    return F.when(F.col("attrs") == "", "").otherwise(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def has(name: str) -> Column:
    return (F.col("attrs") != "") & F.col("attrs").rlike(rf"(?i)\s{name}(\s|=|/|$)")


def plain(text: Column) -> Column:
    """Without tags and basic entities, white space as single blanks."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tags(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each tag (its name in ``tag``) and each title, heading and link with its text (in ``x``); one
    row with empty names for a page without any, or more."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    raw = spread(pages.select(*dict.fromkeys((id_col, url_col, html_col)))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page"), url.alias("url"), html.alias("html"), F.regexp_replace(html, "(?s)<!--.*?-->", "").alias("shown"))
    cut = F.regexp_replace("shown", r"(?is)(<style\b[^>]*>).*?</style", "$1</style")
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    page = raw.select(
        "row",
        "page",
        "url",
        F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(F.regexp_count(query, F.lit("[^&]+")), F.lit(0)).alias("params"),
        F.lower(F.ltrim(F.substring("html", 1, 1000))).startswith("<!doctype").alias("doctype"),
        F.col("html").rlike(f"(?i){PLUGINS}").alias("plugins"),
        F.floor(F.length("html") / 1024 + 0.5).alias("kilo"),
        (F.length("shown") - F.length(cut)).alias("css_chars"),
        F.regexp_replace(cut, r"(?is)(<script\b[^>]*>).*?</script", "$1</script").alias("bare"),
    )
    body = F.instr(F.lower("bare"), "<body")
    halves = F.array(
        F.struct(F.lit(True).alias("head"), F.when(body > 0, F.substring(F.col("bare"), F.lit(1), body - 1)).otherwise("").alias("part")),
        F.struct(F.lit(False).alias("head"), F.when(body > 0, F.substring(F.col("bare"), body, F.length("bare"))).otherwise(F.col("bare")).alias("part")),
    )
    keys = ["row", "page", "url", "host", "path", "params", "doctype", "plugins", "kilo", "css_chars"]
    half = page.select(*keys, F.explode(halves).alias("h")).select(*keys, "h.head", "h.part")
    found = [F.regexp_extract_all("part", F.lit(r"(<[A-Za-z][^>]*>)"), 1)] + [F.regexp_extract_all("part", F.lit(t), 1) for t in TEXTS]
    marked = lambda f, whole: F.transform(f, lambda s: F.struct(F.lit(whole).alias("whole"), s.alias("s")))
    items = F.concat(marked(found[0], False), *[marked(f, True) for f in found[1:]])
    row = half.select(*keys, "head", F.posexplode_outer(items).alias("k", "item")).select(*keys, "head", (F.col("k") + F.when(F.col("head"), 0).otherwise(10**9)).alias("k"), "item.whole", "item.s")
    name = F.coalesce(F.lower(F.regexp_extract("s", "^<([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))
    row = row.select("*", name.alias("element"), F.coalesce(F.regexp_extract("s", "^<[A-Za-z][A-Za-z0-9]*([^>]*)>", 1), F.lit("")).alias("attrs"))
    row = row.select(*keys, "head", "k", "s", "attrs", F.when(F.col("whole"), "").otherwise(F.col("element")).alias("tag"), F.when(F.col("whole"), F.col("element")).otherwise("").alias("x"), *[attribute(a).alias("a_" + a.replace("-", "_")) for a in ATTRIBUTES], *[has(a).alias(f"has_{a}") for a in ("alt", "href", "onclick", "charset", "async", "defer", "media")])
    small = lambda c: F.col(c).rlike("^0*[1-4]([^0-9]|$)")
    named = (F.col("host") != "") & F.contains("a_href", "host")
    return row.select(
        *[c for c in row.columns if c not in ("s", "attrs")],
        F.when(F.col("x") != "", plain(F.col("s"))).otherwise("").alias("inside"),
        F.col("s").rlike(r"(?i)<img[^>]*\salt\s*=").alias("shows_image"),
        (F.col("a_role").isin("presentation", "none") | (F.col("a_aria_hidden") == "true") | F.col("a_class").rlike(f"(?i){DECORATION_CLASS}") | F.col("a_src").rlike(f"(?i){DECORATION}") | small("a_width") | small("a_height")).alias("decorative"),
        F.col("a_src").rlike(FILE_HOSTS).alias("at_file_host"),
        F.col("a_src").rlike(f"(?i){EMBEDS}").alias("embed"),
        (F.col("has_href") & (F.col("a_href").startswith("/") | named)).alias("internal"),
        (F.col("a_href").startswith("http") & ~named).alias("outward"),
        F.col("a_hreflang").rlike("^[a-z]{2}(-[A-Z]{2})?$").alias("language"),
    )


def signals(pages: DataFrame) -> DataFrame:
    """One row for each page with all that the rules name."""
    keys = ["row", "page", "url", "host", "path", "params", "doctype", "plugins", "kilo", "css_chars"]
    aggregates = [F.count_if(F.expr(c)).alias(n) for n, c in COUNTS.items()]
    aggregates += [F.coalesce(F.min_by(F.when(F.expr(c), F.expr(v)), F.when(F.expr(c), F.col("k"))), F.lit("")).alias(n) for n, (v, c) in FIRSTS.items()]
    aggregates += [F.min(F.when(F.expr(c), F.col(v))).alias(n) for n, (v, c) in _LEAST.items()] + [F.max(F.when(F.expr(c), F.col(v))).alias(n) for n, (v, c) in _MOST.items()]
    s = tags(pages).groupBy(*keys).agg(*aggregates)
    return s.select(
        "*",
        F.col("refresh").rlike(r"^\s*[-+]?0*[1-9]").alias("refresh_waits"),
        F.col("htmllang").rlike("^[a-z]{2}(-[A-Z]{2})?$").alias("good_lang"),
        F.col("path").rlike("/20[0-9]{2}[/-]").alias("dated"),
        F.regexp_count("path", F.lit("[^/]+")).alias("levels"),
        F.col("path").rlike("(^|[/-])[0-9]+[/-]*$").alias("numeric_end"),
    )


def outcomes(signal_rows: DataFrame, *beside: str) -> DataFrame:
    """page, id, category, status, severity of every page and rule, and the columns ``beside``."""
    results = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), F.expr(case(w)).alias("o")) for i, c, w in RULES])
    table = F.create_map(*[x for o, (status, severity) in OUTCOMES.items() for x in (F.lit(o), F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity")))])
    rows = signal_rows.select("page", *beside, F.explode(results).alias("r"))
    return rows.select("page", *beside, "r.id", "r.category", table[F.col("r.o")].alias("v")).select("page", *beside, "id", "category", "v.*")


def page_checks(spark, sf_dir):
    """Each page's result of each check."""
    return outcomes(signals(read_table(spark, sf_dir, "pages"))).withColumnRenamed("page", "page_id")


def page_check_scores(spark, sf_dir):
    """Each page's score over the weighted buckets, bounded by its blocking failures."""
    c = outcomes(signals(read_table(spark, sf_dir, "pages")))
    category = {x: b for b, (_, xs) in BUCKETS.items() for x in xs}
    return page_scores(c, category, {b: w for b, (w, _) in BUCKETS.items()}, {i: 3 if i in THREEFOLD else 1 if i in ONCE else 2 for i, _, _ in RULES}, BLOCKERS).withColumnRenamed("page", "page_id")


QUERIES = {f.__name__: f for f in (page_checks, page_check_scores)}


def _sql() -> str:
    def texts(t: str) -> str:
        return f"list_transform(regexp_extract_all(part, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>'), lambda s: {{'whole': true, 's': s}})"

    def attr(a: str) -> str:
        return f"""regexp_replace(regexp_extract(attrs, '(?i)\\s{a}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"'']+)', 1), '^["'']|["'']$', '', 'g') AS a_{a.replace('-', '_')}"""

    lists = "list_transform(regexp_extract_all(part, '<[A-Za-z][^>]*>'), lambda s: {'whole': false, 's': s})"
    for t in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "a"):
        lists = f"list_concat({lists}, {texts(t)})"
    inside = "regexp_replace(s, '<[^>]*>', ' ', 'g')"
    for entity, char in ENTITIES:
        inside = f"replace({inside}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    keys = "rid, page, url, host, path, params, doctype, plugins, kilo, css_chars"
    first = [f"coalesce(min_by(CASE WHEN {c} THEN {v} END, CASE WHEN {c} THEN k END), '') AS {n}" for n, (v, c) in FIRSTS.items()]
    ends = [f"min(CASE WHEN {c} THEN {v} END) AS {n}" for n, (v, c) in _LEAST.items()] + [f"max(CASE WHEN {c} THEN {v} END) AS {n}" for n, (v, c) in _MOST.items()]
    aggregates = ", ".join([f"count(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in COUNTS.items()] + first + ends)
    rules = ", ".join(f"{{'id': '{i}', 'category': '{c}', 'o': {case(w)}}}" for i, c, w in RULES)
    known = " ".join(f"WHEN '{o}' THEN {{'status': '{s}', 'severity': '{v}'}}" for o, (s, v) in OUTCOMES.items())
    return f"""shown AS (SELECT row_number() OVER () AS rid, page_id AS page, url, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS shown FROM pages),
      cut AS (SELECT *, regexp_replace(shown, '(?is)(<style\\b[^>]*>).*?</style', '\\1</style', 'g') AS cut FROM shown),
      bare AS (SELECT rid, page, url, coalesce(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(len(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')), 0) AS params, starts_with(lower(ltrim(html)), '<!doctype') AS doctype, regexp_matches(html, '(?i){PLUGINS}') AS plugins,
        floor(length(html) / 1024 + 0.5) AS kilo, length(shown) - length(cut) AS css_chars, regexp_replace(cut, '(?is)(<script\\b[^>]*>).*?</script', '\\1</script', 'g') AS bare FROM cut),
      half AS (SELECT *, true AS head, CASE WHEN strpos(lower(bare), '<body') > 0 THEN substr(bare, 1, strpos(lower(bare), '<body') - 1) ELSE '' END AS part FROM bare
        UNION ALL SELECT *, false, CASE WHEN strpos(lower(bare), '<body') > 0 THEN substr(bare, strpos(lower(bare), '<body')) ELSE bare END FROM bare),
      item AS (SELECT {keys}, head, list_concat([{{'whole': false, 's': ''}}], {lists}) AS items FROM half),
      r0 AS (SELECT {keys}, head, unnest(items) AS i, generate_subscripts(items, 1) + CASE WHEN head THEN 0 ELSE 1000000000 END AS k FROM item),
      r1 AS (SELECT {keys}, head, k, i.s AS s, i.whole AS whole, lower(regexp_extract(i.s, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS element, regexp_extract(i.s, '^<[A-Za-z][A-Za-z0-9]*([^>]*)>', 1) AS attrs FROM r0),
      r2 AS (SELECT *, CASE WHEN whole THEN '' ELSE element END AS tag, CASE WHEN whole THEN element ELSE '' END AS x, {', '.join(attr(a) for a in ATTRIBUTES)},
        {', '.join(f"regexp_matches(attrs, '(?i)\\s{a}(\\s|=|/|$)') AS has_{a}" for a in ("alt", "href", "onclick", "charset", "async", "defer", "media"))} FROM r1),
      row AS (SELECT *, CASE WHEN x <> '' THEN trim(regexp_replace({inside}, '\\s+', ' ', 'g')) ELSE '' END AS inside, regexp_matches(s, '(?i)<img[^>]*\\salt\\s*=') AS shows_image,
        a_role IN ('presentation', 'none') OR a_aria_hidden = 'true' OR regexp_matches(a_class, '(?i){DECORATION_CLASS}') OR regexp_matches(a_src, '(?i){DECORATION}') OR regexp_matches(a_width, '^0*[1-4]([^0-9]|$)') OR regexp_matches(a_height, '^0*[1-4]([^0-9]|$)') AS decorative,
        regexp_matches(a_src, '{FILE_HOSTS}') AS at_file_host, regexp_matches(a_src, '(?i){EMBEDS}') AS embed, has_href AND (starts_with(a_href, '/') OR (host <> '' AND contains(a_href, host))) AS internal,
        starts_with(a_href, 'http') AND NOT (host <> '' AND contains(a_href, host)) AS outward, regexp_full_match(a_hreflang, '[a-z]{{2}}(-[A-Z]{{2}})?') AS language FROM r2),
      sig AS (SELECT {keys}, {aggregates} FROM row GROUP BY ALL),
      signals AS (SELECT *, regexp_matches(refresh, '^\\s*[-+]?0*[1-9]') AS refresh_waits, regexp_full_match(htmllang, '[a-z]{{2}}(-[A-Z]{{2}})?') AS good_lang, regexp_matches(path, '/20[0-9]{{2}}[/-]') AS dated,
        len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS levels, regexp_matches(path, '(^|[/-])[0-9]+[/-]*$') AS numeric_end FROM sig),
      o AS (SELECT page, unnest([{rules}]) AS r FROM signals),
      ch AS (SELECT page, r.id AS id, r.category AS category, CASE r.o {known} END AS v FROM o)"""


_CATEGORY = " ".join(f"WHEN category IN ({', '.join(repr(x) for x in xs)}) THEN '{b}'" for b, (_, xs) in BUCKETS.items())
_WEIGHT = " ".join(f"WHEN '{b}' THEN {round(1000 * w)}" for b, (w, _) in BUCKETS.items())
_HITS = ", ".join(f"bool_or(v.status = 'fail' AND id IN ({', '.join(repr(i) for i in ids)})) AS {g}" for g, (ids, _) in BLOCKERS.items())
_CAP = f"least({', '.join(f'CASE WHEN {g} THEN {cap} END' for g, (_, cap) in BLOCKERS.items())})"
_MANY = " + ".join(f"CAST({g} AS INT)" for g in BLOCKERS)

ORACLE_SQL = {
    "page_checks": f"WITH {_sql()} SELECT page AS page_id, id, category, v.status AS status, v.severity AS severity FROM ch",
    "page_check_scores": f"""WITH {_sql()}, p AS (SELECT page, CASE {_CATEGORY} END AS bucket, CASE v.status WHEN 'pass' THEN 100 WHEN 'notice' THEN 85 WHEN 'warning' THEN 50 WHEN 'fail' THEN CASE WHEN v.severity = 'error' THEN 0 ELSE 25 END END AS points, CASE WHEN id IN {THREEFOLD} THEN 3 WHEN id IN {ONCE} THEN 1 ELSE 2 END AS tier FROM ch),
      b AS (SELECT page, bucket, floor(sum(tier * points) / sum(tier) + 0.5) AS score, CASE bucket {_WEIGHT} END AS weight FROM p WHERE points IS NOT NULL GROUP BY ALL),
      m AS (SELECT page, CAST(floor(sum(weight * score) / sum(weight) + 0.5) AS BIGINT) AS composite FROM b GROUP BY page), h AS (SELECT page, {_HITS} FROM ch GROUP BY page),
      c AS (SELECT page, CASE WHEN {_MANY} > 0 THEN greatest(10, {_CAP} - 5 * ({_MANY} - 1)) END AS cap FROM h), t AS (SELECT page AS page_id, composite, cap, CASE WHEN cap IS NULL THEN composite ELSE least(composite, cap) END AS overall FROM c JOIN m USING (page))
      SELECT *, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' WHEN overall >= 40 THEN 'poor' ELSE 'critical' END AS band FROM t""",
}
