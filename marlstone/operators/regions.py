"""Services in places: what may have a page, demand by region, links to siblings, and results that count.

Null names and flags count as missing; repeated rows are rows of their own unless a key is stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..runtime import materialize, read_table

# Hosts whose results don't count.
SOCIAL = ("youtube.com", "reddit.com", "quora.com", "pinterest.com", "facebook.com", "twitter.com", "x.com", "linkedin.com")
SIBLINGS = 4


def primary_eligible(keyword: Column, city: Column, terms: Column, service: Column) -> Column:
    """Does a keyword name the place, and one of the terms or, where there are none, a word of over three letters of the service?"""
    k = F.lower(F.coalesce(keyword, F.lit("")))
    place = F.lower(F.trim(F.coalesce(city, F.lit(""))))
    words = F.filter(F.split(F.lower(F.coalesce(service, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
    wanted = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, terms).otherwise(words)
    return (F.coalesce(city, F.lit("")) != "") & F.contains(k, place) & F.exists(wanted, lambda t: F.contains(k, t))


def eligibility(pairs: DataFrame, services: DataFrame, places: DataFrame) -> DataFrame:
    """service, place, eligible, backed, reason of asked pairs (service, place): the place must be known and verified, the
    service known and among the place's (places: place, verified, offers; services: service)."""
    known = services.select("service").distinct().withColumn("_s", F.lit(True))
    d = pairs.join(known, "service", "left").join(places.select("place", F.lit(True).alias("_p"), "verified", "offers"), "place", "left")
    verified = F.coalesce("verified", F.lit(False))
    offered = F.coalesce(F.array_contains("offers", F.col("service")), F.lit(False))
    reason = F.when(F.col("_p").isNull(), "place not found").when(F.col("_s").isNull(), "service not found").when(~verified, "place not verified").when(~offered, "not offered here").otherwise("verified place that offers it")
    found = F.col("_p").isNotNull() & F.col("_s").isNotNull()
    return d.select("service", "place", (found & verified & offered).alias("eligible"), (found & verified).alias("backed"), reason.alias("reason"))


def city_of(region: Column) -> Column:
    """The first city of a region's name: what stands before a comma, dash or slash."""
    return F.trim(F.regexp_extract(region, "^([^,–/]*)", 1))


def phrase_in(term: Column, city: Column) -> Column:
    """A term as people of the city ask it: [city] filled in, else "near me" taken off and the city put behind."""
    t = F.trim(F.coalesce(term, F.lit("")))
    flat = lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.when(F.contains(t, F.lit("[city]")), flat(F.replace(t, F.lit("[city]"), city))).otherwise(flat(F.concat_ws(" ", F.regexp_replace(t, r"(?i)\bnear me\b", ""), city)))


def region_volumes(terms: DataFrame, regions: DataFrame, results: DataFrame) -> DataFrame:
    """region, term, phrase, asked, volume, cost, monthly of every term (seq, term) in every region (region): what the results
    (phrase, volume, cost, trend) have for its phrase there, else zeros. Of terms that come to one phrase the first asks
    for it, all get it. A trend of two points or more, relative to its volume, gives monthly ones, half up.

    Terms are a basket, one row that every region gets; the results are joined by phrase.
    """
    basket = terms.agg(F.array_sort(F.collect_list(F.struct("seq", "term"))).alias("basket"))
    asked = regions.select("region").join(basket, F.lit(True)).select("region", F.explode("basket").alias("t")).select("region", "t.*")
    d = asked.select("region", "seq", "term", phrase_in(F.col("term"), city_of(F.col("region"))).alias("phrase"))
    first = F.row_number().over(Window.partitionBy("region", "phrase").orderBy("seq")) == 1
    r = results.dropDuplicates(["phrase"]).select("phrase", "volume", "cost", "trend")
    d = d.withColumn("asked", first).join(r, "phrase", "left")
    monthly = F.when(F.size("trend") >= 2, F.transform("trend", lambda x: half_up(x * F.col("volume"), 0).cast("long")))
    none = F.array().cast("array<bigint>")
    return d.select("region", "term", "phrase", "asked", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce(monthly, none).alias("monthly"))


def sibling_places(places: DataFrame, most: int = SIBLINGS) -> DataFrame:
    """place, rank, sibling: up to ``most`` other places of each (place, region, seq), those of its region first, each in order of seq and place.

    A place needs the first most + 1 of its region, and the first ``most`` of other regions. These are among
    the first 2 most places if a region gives at most ``most`` of them, a few rows whatever there are; no place meets all others.
    """
    own = Window.partitionBy("region").orderBy("seq", "place")
    ahead = materialize(places.select("place", "region", "seq").withColumn("o", F.row_number().over(own)).filter(F.col("o") <= most + 1))
    entry = F.struct("seq", "place", "region")
    near = ahead.groupBy("region").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    far = ahead.filter(F.col("o") <= most).orderBy("seq", "place").limit(2 * most).agg(F.array_sort(F.collect_list(entry)).alias("far"))
    d = places.select("place", "region").join(near.withColumnRenamed("region", "_r"), F.col("region").eqNullSafe(F.col("_r"))).join(far, F.lit(True))
    others = F.concat(F.filter("near", lambda x: ~x["place"].eqNullSafe(F.col("place"))), F.filter("far", lambda x: ~x["region"].eqNullSafe(F.col("region"))))
    return d.select("place", F.posexplode(F.slice(others, 1, most)).alias("k", "s")).select("place", (F.col("k") + 1).alias("rank"), F.col("s.place").alias("sibling"))


def counting_results(results: DataFrame, own: Column, most: int) -> DataFrame:
    """seed, rank, url of the first ``most`` results (seed, place, url) that are no social pages, files of PDF, or of the host
    of the URL ``own``, ranked anew from 1."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    h = host(F.col("url"))
    social = F.lit(False)
    for s in SOCIAL:
        social = social | (h == s) | F.endswith(h, F.lit("." + s))
    kept = results.filter((F.coalesce(h, F.lit("")) != "") & ~social & ~F.col("url").rlike(r"(?i)\.pdf(\?|$)") & ((host(F.coalesce(own, F.lit(""))) == "") | (h != host(F.coalesce(own, F.lit(""))))))
    order = Window.partitionBy("seed").orderBy("place", "url")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("seed", "rank", "url")


def on_domain(checked: DataFrame) -> DataFrame:
    """domain, url, kept of checked pages (domain, url, final, error): errors, and pages whose last URL is of the domain's
    host; a domain that keeps none keeps a row for its home page instead."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    stays = F.col("error").isNotNull() | (host(F.coalesce(F.nullif("final", F.lit("")), "url")) == host(F.col("domain")))
    d = checked.withColumn("kept", F.coalesce(stays, F.lit(False)))
    none = d.groupBy("domain").agg(F.max("kept").alias("any")).filter("NOT any").select("domain", F.concat(F.regexp_replace("domain", "/$", ""), F.lit("/")).alias("url"), F.lit("home").alias("why"))
    return d.filter("kept").select("domain", "url", F.when(F.col("error").isNotNull(), "error").otherwise("on domain").alias("why")).unionByName(none)


# --- queries: suppliers are places, nations regions, customers' nations services


def _places(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("place"), F.col("s_nationkey").alias("region"), (F.col("s_suppkey") * 7 % 101).alias("seq"), (F.col("s_acctbal") > 1000).alias("verified"), F.array(F.col("s_nationkey"), (F.col("s_suppkey") % 25).cast("int")).alias("offers"))


def service_eligibility(spark, sf_dir):
    """May a page be made for the nation of each customer, and the next, at one supplier?"""
    c = read_table(spark, sf_dir, "customer")
    pairs = c.select(F.explode(F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1)).alias("service"), (F.col("c_custkey") % 113).alias("place"))
    return eligibility(pairs, read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("service")), _places(spark, sf_dir)).groupBy("service", "reason").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("eligible").alias("eligible"), F.count_if("backed").alias("backed"))


def region_term_volumes(spark, sf_dir):
    """Volumes of a basket of terms, with placeholders and without, in each nation; orders' customers by nation and segment are the results."""
    n = read_table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(", X")).alias("region"), F.col("n_nationkey"))
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    terms = read_table(spark, sf_dir, "region").select(F.explode(F.array(*[F.struct(F.lit(2 * i + j).alias("seq"), F.lit(t).alias("term")) for i, s in enumerate(segments) for j, t in enumerate((f"{s.lower()} near me", f"{s.title()} [city]"))])).alias("t")).select("t.*").distinct()
    c = read_table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.groupBy(F.lower(F.concat_ws(" ", "c_mktsegment", city_of(F.col("region")))).alias("phrase")).agg(F.count(F.lit(1)).alias("volume"), F.min("c_custkey").cast("double").alias("cost"))
    r = r.filter("volume > 1").withColumn("trend", F.when(F.col("volume") % 2 == 0, F.array(F.lit(0.5), F.lit(1.0), F.lit(0.25))).otherwise(F.array(F.lit(1.0))))
    return region_volumes(terms, n.select("region"), r).withColumn("monthly", F.array_join(F.transform("monthly", lambda x: x.cast("string")), ","))


def place_siblings(spark, sf_dir):
    """Links of each supplier to a few others, of its nation first."""
    return sibling_places(_places(spark, sf_dir))


def page_results(spark, sf_dir):
    """Pages as results of seeds, by id: the first five that count, for a client with the host of the seed's first page."""
    p = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("seed"), F.col("page_id").alias("place"), F.when(F.col("page_id") % 11 == 0, "https://m.YouTube.com/x").when(F.col("page_id") % 13 == 0, F.concat("url", F.lit("/a.PDF"))).otherwise(F.col("url")).alias("url"))
    first = p.groupBy("seed").agg(F.min_by("url", "place").alias("own"))
    return counting_results(p.join(first, "seed"), F.col("own"), 5)


def pages_on_domain(spark, sf_dir):
    """Pages as checked ones of four domains, of which a third has gone elsewhere."""
    k = F.col("page_id")
    p = read_table(spark, sf_dir, "pages").select(F.concat(F.lit("https://d"), (k % 4).cast("string"), F.lit(".example/")).alias("domain"), F.concat(F.lit("https://D"), (k % 4).cast("string"), F.lit(".example/"), k.cast("string")).alias("url"), F.when((k % 4 == 3) | (k % 3 == 0), "https://gone.example/").alias("final"), F.when((k % 4 != 3) & (k % 5 == 0), "timeout").alias("error"))
    return on_domain(p)


QUERIES = {f.__name__: f for f in (service_eligibility, region_term_volumes, place_siblings, page_results, pages_on_domain)}

_PLACES = "places AS (SELECT s_suppkey AS place, s_nationkey AS region, s_suppkey * 7 % 101 AS seq, s_acctbal > 1000 AS verified, [s_nationkey, s_suppkey % 25] AS offers FROM supplier)"
_HOST = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"
ORACLE_SQL = {
    "service_eligibility": f"""WITH {_PLACES}, pairs AS (SELECT unnest([c_nationkey, c_nationkey + 1]) AS service, c_custkey % 113 AS place FROM customer),
      r AS (SELECT service, CASE WHEN p.place IS NULL THEN 'place not found' WHEN service NOT IN (SELECT n_nationkey FROM nation) THEN 'service not found' WHEN NOT verified THEN 'place not verified' WHEN NOT list_contains(offers, service) THEN 'not offered here' ELSE 'verified place that offers it' END AS reason FROM pairs LEFT JOIN places p USING (place))
      SELECT service, reason, count(*) AS pairs, count(*) FILTER (reason = 'verified place that offers it') AS eligible, count(*) FILTER (reason IN ('verified place that offers it', 'not offered here')) AS backed FROM r GROUP BY ALL""",
    "region_term_volumes": """WITH t(term, segment) AS (SELECT lower(s) || ' near me', s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) UNION ALL SELECT s[1] || lower(s[2:]) || ' [city]', s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)),
      r AS (SELECT n_name AS city, c_mktsegment AS segment, count(*) AS volume, min(c_custkey) AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 1)
      SELECT n_name || ', X' AS region, term, lower(t.segment || ' ' || n_name) AS phrase, term LIKE '% near me' AS asked, coalesce(volume, 0) AS volume, CAST(coalesce(cost, 0) AS DOUBLE) AS cost,
        CASE WHEN volume % 2 = 0 THEN CAST(floor(volume * 0.5 + 0.5) AS BIGINT) || ',' || volume || ',' || CAST(floor(volume * 0.25 + 0.5) AS BIGINT) ELSE '' END AS monthly
      FROM nation CROSS JOIN t LEFT JOIN r ON r.city = n_name AND r.segment = t.segment""",
    "place_siblings": f"""WITH {_PLACES}, r AS (SELECT a.place AS place, b.place AS sibling, row_number() OVER (PARTITION BY a.place ORDER BY CASE WHEN a.region = b.region THEN 0 ELSE 1 END, b.seq, b.place) AS rank FROM places a JOIN places b ON a.place <> b.place)
      SELECT place, CAST(rank AS INT) AS rank, sibling FROM r WHERE rank <= {SIBLINGS}""",
    "page_results": f"""WITH p AS (SELECT page_id % 7 AS seed, page_id AS place, CASE WHEN page_id % 11 = 0 THEN 'https://m.YouTube.com/x' WHEN page_id % 13 = 0 THEN url || '/a.PDF' ELSE url END AS url FROM pages),
      h AS (SELECT *, {_HOST.format('url')} AS host, first_value(url) OVER (PARTITION BY seed ORDER BY place) AS own FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place, url) AS rank FROM h WHERE host <> '' AND NOT regexp_matches(host, '(^|\\.)({'|'.join(s.replace('.', chr(92) + '.') for s in SOCIAL)})$') AND NOT regexp_matches(url, '(?i)\\.pdf(\\?|$)') AND host <> {_HOST.format('own')})
      SELECT seed, CAST(rank AS INT) AS rank, url FROM k WHERE rank <= 5""",
    "pages_on_domain": """SELECT 'https://d' || page_id % 4 || '.example/' AS domain, 'https://D' || page_id % 4 || '.example/' || page_id AS url, CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'on domain' END AS why FROM pages WHERE page_id % 4 <> 3 AND (page_id % 5 = 0 OR page_id % 3 <> 0)
      UNION ALL SELECT DISTINCT 'https://d3.example/', 'https://d3.example/', 'home' FROM pages WHERE page_id % 4 = 3""",
}
