"""Classes of keywords, domains, pages and images by stated rules, on columns.

Rules come as tuples of words, longest first where it matters, and become one
regular expression each, so that a row is classed within its scan. Null texts
are empty ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.stems import stem, stemmed
from ..runtime import read_table
from .text import TITLE, W, _title, plain_words

# Words that tell a question, support requests, calls to act, generic image names.
ASKS = r"\b(what is|how|why|guide|vs\.?|difference|symptoms|causes)\b"
SUPPORT = ("login", "log", "signin", "sign", "logout", "password", "otp", "helpline", "toll", "free", "complaint", "complaints", "grievance", "customer", "care", "support", "nearest", "branch", "timing", "timings", "download", "app", "apk", "statement", "balance", "check")
ACTS = r"\b(buy|get started|free trial|contact us|sign up|request a demo|book a demo)\b"
GENERIC_ALT = r"^(image|photo|picture|img|untitled|placeholder|\.jpg|\.png|\.webp|(img|dsc|image|photo)\s*[0-9]*)$"
IMAGE_ENDINGS = r"(\.(jpg|jpeg|png|gif|webp|svg|avif))+$"


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _words(words) -> str:
    return "|".join(re.escape(w.lower()) for w in sorted(words, key=lambda w: (-len(w), w)))


def intent(keyword: Column) -> Column:
    return F.when(lowered(keyword).rlike(ASKS), "informational").otherwise("commercial")


def near_me(keyword: Column) -> Column:
    return lowered(keyword).rlike(r"\bnear me\b")


def without_regions(keyword: Column, allowed) -> Column:
    """In lower case with allowed regions cut out, longer names before those inside them."""
    return F.regexp_replace(lowered(keyword), rf"\b({_words(allowed)})\b", " ") if allowed else lowered(keyword)


def rivals(target: str, allowed, known) -> list[str]:
    """Known places that a page about ``target`` should not name: not itself, nor an allowed region, nor a place within its name."""
    t, free = target.lower().strip(), {a.lower().strip() for a in allowed if a}
    places = {k.lower().strip() for k in known if k} - {t, ""} - free
    return sorted(p for p in places if not re.search(rf"\b{re.escape(p)}\b", t))


def relevant(keyword: Column, terms, rival, allowed) -> Column:
    """Contains a term (any text, where there are none) and, allowed regions aside, no rival place."""
    out = lowered(keyword).rlike(_words(terms)) if terms else F.lit(True)
    return out & ~without_regions(keyword, allowed).rlike(rf"\b({_words(rival)})\b") if rival else out


def keyword_topics(rows: DataFrame, key: str, keyword: str, topics: DataFrame) -> DataFrame:
    """key, navigational, shares: whether a stem of the keyword's words is a support word, and whether one is among ``topics`` (stem).

    Support words that stemming changes ("customer") are never met. Only the vocabulary is stemmed.
    """
    words = stemmed(rows.select(key, F.explode(plain_words(F.col(keyword))).alias("word")), "word")
    met = words.join(topics.select("stem").distinct().withColumn("topic", F.lit(True)), "stem", "left")
    per = met.groupBy(key).agg(F.max(F.col("stem").isin(*SUPPORT)).alias("navigational"), F.max(F.coalesce("topic", F.lit(False))).alias("shares"))
    return rows.select(key).join(per, key, "left").fillna(False, ["navigational", "shares"])


def branded(keyword: Column, brand: Column) -> Column:
    """A word equals the brand, or of four letters and more one begins with the other."""
    long = (F.length(brand) >= 4)
    return F.exists(plain_words(keyword), lambda w: (w == brand) | (long & (F.length(w) >= 4) & (F.startswith(w, brand) | F.startswith(brand, w))))


def domain_class(domain: Column, own: str | None, directories) -> Column:
    """you, directory (listed, or an institution's), else provider, by the last two labels; so gov.uk, two labels itself, is a provider."""
    d = F.regexp_replace(F.regexp_replace(lowered(domain), r"^https?://", ""), r"^www\.|[/?#].*$", "")
    root = F.substring_index(d, ".", -2)
    out = F.when(root.isin(*directories) | root.rlike(r"(^|\.)(gov|edu|mil)$"), "directory").otherwise("provider")
    return F.when(root == own, "you").otherwise(out) if own else out


def content_type(words: Column, links: Column, text: Column) -> Column:
    share = F.when(words > 0, links / words).otherwise(0.0)
    return F.when(words < 300, "thin-content").when((share > 0.05) & (words < 800), "hub").when(lowered(text).rlike(ACTS) & (words < 600), "landing-page").otherwise("article")


def depth_tier(words: Column) -> Column:
    return F.when(words < 500, "thin").when(words < 1500, "moderate").when(words < 3000, "substantial").otherwise("comprehensive")


def image_base(name: Column) -> Column:
    """File name without query, hash in front, endings, size, language and copy number."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\?.*$", ""), "^[a-fA-F0-9]{6,}_", "")
    for pattern in (rf"(?i){IMAGE_ENDINGS}", "-[0-9]+x[0-9]+", r"(?i)^[a-z]{2}\.", "_[0-9]+$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def alt_grade(alt: Column) -> Column:
    a = F.trim(F.coalesce(alt, F.lit("")))
    return F.when(a == "", "No").when(F.lower(a).rlike(GENERIC_ALT), "Yes (generic)").when(F.length(a) < 20, "Yes (improve)").otherwise("Yes (good)")


def verticals(pages: DataFrame, site: Column, path: Column, words: dict[str, tuple[str, ...]], least: int = 3) -> DataFrame:
    """site, vertical: the one with most path words that begin with one of its words, the earlier listed at a tie; "other" below ``least``."""
    token = F.explode_outer(F.split(F.lower(path), "[/_-]+"))
    rows = pages.select(site.alias("site"), token.alias("token"))
    hits = rows.groupBy("site").agg(*[F.count_if(F.col("token").rlike(f"^({_words(ws)})")).alias(f"n{k}") for k, ws in enumerate(words.values())])
    ranked = F.array_max(F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(words)]))
    return hits.select("site", ranked.alias("r")).select("site", F.when(F.col("r.n") >= least, F.col("r.v")).otherwise("other").alias("vertical"))


def relevance_actions(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """id, action, source of (id, orphan, thin): retire, refresh or keep, unless an answer (id, action) with a known action says otherwise."""
    known = answers.filter(F.col("action").isin("retire", "refresh", "keep")).groupBy("id").agg(F.min("action").alias("answer"))
    own = F.when(F.col("thin") & F.col("orphan"), "retire").when(F.col("thin"), "refresh").otherwise("keep")
    return pages.join(known, "id", "left").select("id", F.coalesce("answer", own).alias("action"), F.when(F.col("answer").isNotNull(), "answer").otherwise("rule").alias("source"))


def gap_priorities(topics: DataFrame, own: DataFrame) -> DataFrame:
    """topic, frequency, priority of topics (topic, source) that ``own`` (topic) lacks."""
    n = topics.groupBy("topic").agg(F.countDistinct("source").alias("frequency")).join(own.select("topic").distinct(), "topic", "left_anti")
    return n.withColumn("priority", F.when(F.col("frequency") >= 6, "high").when(F.col("frequency") >= 3, "medium").otherwise("low"))


# --- queries: part names with endings are keywords

ENDINGS = ("", " near me", " cost", " login", " guide", " how to choose", " Springfield", " West Springfield")
ALLOWED, PLACES = ("west springfield",), ("Springfield", "West Springfield", "Hot")


def _keywords(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    return p.select("p_partkey", F.concat("p_name", ending).alias("keyword"), F.lower(F.substring("p_type", 1, 5)).alias("brand"))


def keyword_classes(spark, sf_dir):
    """Intent, near-me, support and brand words, and relevance of each keyword."""
    k = F.col("keyword")
    rows = _keywords(spark, sf_dir)
    topics = spark.createDataFrame([(stem(w),) for w in ("rings", "bolts", "gears")], "stem string")
    rows = rows.join(keyword_topics(rows, "p_partkey", "keyword", topics), "p_partkey")
    on_topic = F.col("shares") & ~F.col("navigational") & ~branded(k, F.col("brand"))
    return rows.select("p_partkey", on_topic.alias("on_topic"), "navigational", intent(k).alias("intent"), near_me(k).alias("near_me"), branded(k, F.col("brand")).alias("branded"), F.trim(F.regexp_replace(without_regions(k, ALLOWED), " +", " ")).alias("stripped"), relevant(k, ("ring", "bolt", "gear"), rivals("Shelbyville", ALLOWED, PLACES), ALLOWED).alias("relevant"))


def domain_classes(spark, sf_dir):
    """Pages by class of domain."""
    return read_table(spark, sf_dir, "pages").select(domain_class(urls.host(F.col("url")), "example.org", ("example.net",)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("pages"))


def content_types(spark, sf_dir):
    """Type and depth of each document."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.size(plain_words(F.col("text"))).alias("words"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("https?://")).alias("links"))
    return d.select("doc_id", content_type(F.col("words"), F.col("links"), F.col("text")).alias("type"), depth_tier(F.col("words")).alias("tier"))


def site_verticals(spark, sf_dir):
    """Each domain's vertical, by words of its pages' paths."""
    u = F.col("url")
    path = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return verticals(read_table(spark, sf_dir, "pages"), urls.host(u), path, {"french": ("fr",), "german": ("de",), "english": ("en",)})


def image_names(spark, sf_dir):
    """Cleaned file names and grades of alt texts, with parts as images."""
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "a1b2c3d4_").otherwise(""), F.when(F.col("p_size") % 5 == 0, "en.").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 3 == 0, "-300x200").otherwise(""), F.concat(F.lit("_"), key), F.lit(".jpg.webp?v=1"))
    alt = F.when(F.col("p_size") % 4 == 0, F.lit(None)).when(F.col("p_size") % 4 == 1, F.concat(F.lit("IMG "), key)).when(F.col("p_size") % 4 == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" by "), "p_brand", F.lit(" seen from above")))
    return p.select("p_partkey", image_base(name).alias("base"), alt_grade(alt).alias("grade"))


def page_relevance_actions(spark, sf_dir):
    """Parts as pages, suppliers as whoever answers."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") < 10).alias("orphan"), (F.col("p_retailprice") < 1000).alias("thin"))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, "keep").when(F.col("s_acctbal") > 0, "retire").otherwise("unknown").alias("action"))
    return relevance_actions(p, s)


def topic_gaps(spark, sf_dir):
    """Words of benchmark items that no page title has."""
    b = read_table(spark, sf_dir, "benchmark").select(F.explode(plain_words(F.col("text"))).alias("topic"), F.col("item_id").alias("source"))
    return gap_priorities(b, read_table(spark, sf_dir, "pages").select(F.explode(plain_words(_title(F.col("html")))).alias("topic")))


QUERIES = {f.__name__: f for f in (keyword_classes, domain_classes, content_types, site_verticals, image_names, page_relevance_actions, topic_gaps)}

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
ORACLE_SQL = {
    "keyword_classes": f"""WITH r AS (WITH k AS (SELECT p_partkey, lower(p_name || {list(ENDINGS)}[p_partkey % {len(ENDINGS)} + 1]) AS k, lower(p_type[1:5]) AS b FROM part), s AS (SELECT *, string_split(k, ' ') AS w, trim(regexp_replace(replace(k, 'west springfield', ' '), ' +', ' ', 'g')) AS stripped FROM k)
      SELECT p_partkey, CASE WHEN k LIKE '% guide' OR k LIKE '% how %' THEN 'informational' ELSE 'commercial' END AS intent, k LIKE '% near me' AS near_me, len(list_intersect(w, {[w for w in SUPPORT if stem(w) == w]})) > 0 AS navigational, list_has_any(w, ['ring', 'bolt', 'gear']) AS shares,
        len(list_filter(w, lambda x: x = b OR (length(x) >= 4 AND length(b) >= 4 AND (starts_with(x, b) OR starts_with(b, x))))) > 0 AS branded, stripped,
        (contains(k, 'ring') OR contains(k, 'bolt') OR contains(k, 'gear')) AND NOT list_has_any(string_split(stripped, ' '), ['springfield', 'hot']) AS relevant FROM s)
      SELECT * EXCLUDE (shares), shares AND NOT navigational AND NOT branded AS on_topic FROM r""",
    "domain_classes": f"SELECT CASE WHEN regexp_matches({_HOST}, '(^|[.])example[.]org$') THEN 'you' WHEN regexp_matches({_HOST}, '(^|[.])example[.]net$|[.](gov|edu|mil)$') THEN 'directory' ELSE 'provider' END AS class, count(*) AS pages FROM pages GROUP BY 1",
    "content_types": f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, len({W.format('text')}) AS w, len(regexp_extract_all(coalesce(text, ''), 'https?://')) AS l FROM documents)
      SELECT doc_id, CASE WHEN w < 300 THEN 'thin-content' WHEN l > 0.05 * w AND w < 800 THEN 'hub' WHEN regexp_matches(t, '{ACTS}') AND w < 600 THEN 'landing-page' ELSE 'article' END AS type, CASE WHEN w < 500 THEN 'thin' WHEN w < 1500 THEN 'moderate' WHEN w < 3000 THEN 'substantial' ELSE 'comprehensive' END AS tier FROM d""",
    "site_verticals": f"""WITH t AS (SELECT {_HOST} AS site, unnest(regexp_split_to_array(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '[/_-]+')) AS t FROM pages),
      n AS (SELECT site, count(CASE WHEN t LIKE 'fr%' THEN 1 END) AS f, count(CASE WHEN t LIKE 'de%' THEN 1 END) AS g, count(CASE WHEN t LIKE 'en%' THEN 1 END) AS e FROM t GROUP BY 1)
      SELECT site, CASE WHEN greatest(f, g, e) < 3 THEN 'other' WHEN f >= g AND f >= e THEN 'french' WHEN g >= e THEN 'german' ELSE 'english' END AS vertical FROM n""",
    "image_names": """SELECT p_partkey, replace(p_name, ' ', '-') AS base,
      CASE p_size % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes (generic)' WHEN 2 THEN CASE WHEN length(p_name) < 20 THEN 'Yes (improve)' ELSE 'Yes (good)' END ELSE 'Yes (good)' END AS grade FROM part""",
    "page_relevance_actions": """SELECT p_partkey AS id, CASE WHEN s_acctbal > 5000 THEN 'keep' WHEN s_acctbal > 0 THEN 'retire' WHEN p_retailprice < 1000 AND p_size < 10 THEN 'retire' WHEN p_retailprice < 1000 THEN 'refresh' ELSE 'keep' END AS action,
      CASE WHEN s_acctbal > 0 THEN 'answer' ELSE 'rule' END AS source FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""",
    "topic_gaps": f"""WITH b AS (SELECT DISTINCT item_id, unnest({W.format('text')}) AS topic FROM benchmark), o AS (SELECT unnest({W.format(TITLE)}) AS topic FROM pages), n AS (SELECT topic, count(*) AS frequency FROM b WHERE topic NOT IN (SELECT topic FROM o) GROUP BY 1)
      SELECT *, CASE WHEN frequency >= 6 THEN 'high' WHEN frequency >= 3 THEN 'medium' ELSE 'low' END AS priority FROM n""",
}
