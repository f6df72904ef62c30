"""Roll-ups, joins and orders behind reports: siblings' verdicts, cadence, gaps, plans, dates, vitals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..runtime import read_table
from .text import _title, plain_words

# Seconds (cls: shift) up to which a vital is good, and up to which it needs work.
VITALS = {"lcp": (2.5, 4.0), "cls": (0.1, 0.25), "inp": (0.2, 0.5), "fcp": (1.8, 3.0), "ttfb": (0.8, 1.8)}
# Weights of the rubric, words of conversion, types of pages by path and title.
RUBRIC = (0.35, 0.30, 0.20, 0.15)
CONVERSION = ("cost", "price", "pricing", "book", "schedule", "appointment", "quote", "free", "cheap", "affordable", "near me", "local", "best")
DATED, ARTICLE = r"/\d{4}[/-]\d{2}", r"/(blog|article|articles|news|post|posts|insights|resources|guide|guides|learn|education)/"
OPENS_AS_GUIDE = r"^(what is|how to|guide to|introduction to|understanding|the complete|everything (you|about))"
GUIDE = r"(explained|: a guide| guide$|overview|tutorial|\bfaq\b|trends|challenges|what is|how to)"


def seconds_of(metric: Column) -> Column:
    """A measured text ("850 ms", "2.1 s", "0.05") as a number, milliseconds as seconds; null if it isn't one."""
    n = F.regexp_extract(metric, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(F.lower(metric).rlike(r"[0-9]\s*ms\b"), n / 1000).otherwise(n)


def vital_status(kind: str, value: Column) -> Column:
    good, poor = VITALS[kind]
    return F.when(value.isNull(), None).when(value <= good, "good").when(value <= poor, "needs work").otherwise("poor")


def week_start(t: Column) -> Column:
    """The Monday of a time's week."""
    return F.date_trunc("week", t).cast("date")


def quarter_label(t: Column) -> Column:
    return F.concat(F.year(t).cast("string"), F.lit("-q"), F.quarter(t).cast("string"))


def months_since(t: Column, now: Column) -> Column:
    """Days over 30.44, one decimal."""
    return half_up(F.datediff(now, t) / 30.44, 1)


def page_kind_score(url: Column, title: Column, directories: list[str]) -> Column:
    """0.2 for a directory's host, 0.4 for dated and article paths, 0.3 and 0.45 for guides by title, else 1."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    path, t = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), F.lower(title)
    listed = F.lit(False)
    for d in directories:
        listed = listed | (host == d) | host.endswith("." + d)
    return F.when(listed, 0.2).when(path.rlike(DATED) | path.rlike(ARTICLE), 0.4).when(t.rlike(OPENS_AS_GUIDE), 0.3).when(t.rlike(GUIDE), 0.45).otherwise(1.0)


def rubric(position: Column, kind: Column, text: Column, seed: list[str]) -> Column:
    """Weighted sum of position (1..10), page kind, share of the seed's words in the text, and words of conversion (two are enough)."""
    t = F.lower(text)
    words = [w for w in (x.lower() for x in seed) if len(w) > 2]
    intent = sum(t.contains(w).cast("int") for w in words) / len(words) if words else F.lit(0.0)
    conversion = F.least(F.lit(1.0), sum(t.contains(w).cast("int") for w in CONVERSION) / 2)
    parts = (1 - (position - 1) / 10, kind, intent, conversion)
    return sum(w * p for w, p in zip(RUBRIC, parts))


def sibling_verdicts(claims: DataFrame, key: Column, order: str, verdict: Column) -> DataFrame:
    """``claims`` with the verdict of the first claim of each key, which alone is judged; null is "inconclusive"."""
    keyed = claims.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(*claims.columns), order).alias("_c")).select("_key", "_c.*")
    judged = first.select("_key", F.coalesce(verdict, F.lit("inconclusive")).alias("verdict"))
    return keyed.join(judged, "_key").drop("_key")


def removal_guard(judged: DataFrame, group: str, removed: Column, most: int = 8, share: float = 0.5, least: int = 4) -> DataFrame:
    """group, judged, removals, aborted: too many removals, or more than the share of at least ``least`` judged."""
    n, k = F.count(F.lit(1)), F.count_if(removed)
    return judged.groupBy(group).agg(n.alias("judged"), k.alias("removals"), ((k > most) | ((n >= least) & (k > share * n))).alias("aborted"))


def union_with_minimum(rows: DataFrame, group: str, key: Column, first: Column, order: list[Column], least: int, most: int) -> DataFrame:
    """Distinct keys of each group: those of the first source up to ``most``, then others only until ``least``."""
    keyed = rows.withColumn("_key", F.regexp_replace(F.lower(key), "[^a-z0-9]", "")).filter("_key <> ''").withColumn("_first", first)
    one = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_key").orderBy(F.desc("_first"), *order))).filter("_n = 1")
    w = Window.partitionBy(group).orderBy(F.desc("_first"), *order)
    ranked = one.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.when(F.col("_first"), F.col("rank") <= most).otherwise(F.col("rank") <= least)).drop("_n", "_first", "_key")


def redundant_sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, redundant: sentences of 4 words or more that nearly repeat the one before (Jaccard 0.72 or
    more, or the smaller held in the other to 0.85)."""
    s = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[.!?]+")).alias("k", "s")).select(id_col, "k", F.array_distinct(plain_words(F.col("s"))).alias("w"))
    before = F.lag("w").over(Window.partitionBy(id_col).orderBy("k"))
    pairs = s.withColumn("b", before).filter((F.size("w") >= 4) & (F.size("b") >= 4))
    both = F.size(F.array_intersect("w", "b"))
    hit = (both / (F.size("w") + F.size("b") - both) >= 0.72) | (both / F.least(F.size("w"), F.size("b")) >= 0.85)
    return pairs.groupBy(id_col).agg(F.count_if(hit).alias("redundant"))


def dollar_model(rows: DataFrame, volume: str, rates: dict[str, float]) -> DataFrame:
    """inquiries, patients, revenue and budget as products of the volume and rates."""
    v = F.col(volume)
    inquiries = v * rates["click"] * rates["inquiry"]
    patients = inquiries * rates["close"]
    return rows.select("*", half_up(inquiries, 1).alias("inquiries"), half_up(patients, 1).alias("patients"), half_up(patients * rates["value"], 0).cast("long").alias("revenue"), half_up(inquiries * rates["cost"], 0).cast("long").alias("budget"))


# --- queries


def vitals_by_type(spark, sf_dir):
    """Events' values as page timings in milliseconds: their status counts."""
    e = read_table(spark, sf_dir, "events").select("event_type", seconds_of(F.concat((F.floor(F.abs("value")) * 40).cast("long").cast("string"), F.lit(" ms"))).alias("s"))
    return e.groupBy("event_type", vital_status("lcp", F.col("s")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def order_calendar(spark, sf_dir):
    """Orders by the Monday of their week, with the quarter of that Monday and the months since."""
    o = read_table(spark, sf_dir, "orders").groupBy(week_start(F.col("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("orders"))
    return o.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "orders", quarter_label(F.col("week")).alias("quarter"), months_since(F.col("week"), F.to_date(F.lit("2001-08-01"))).alias("months"))


def url_rubric_top(spark, sf_dir):
    """The ten best pages of each root domain by the rubric; positions are the order of arrival."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", _title(F.col("html")).alias("title"), F.regexp_extract("url", r"([^./]+\.[^./]+)(?:[/?#]|$)", 1).alias("root"))
    position = F.col("page_id") % 10 + 1
    scored = p.withColumn("score", half_up(rubric(position, page_kind_score(F.col("url"), F.col("title"), ["example.net"]), F.col("title"), ["the", "and", "of"]), 2))
    w = Window.partitionBy("root").orderBy(F.desc("score"), "page_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("root", "page_id", "score", "rank")


def claim_verdicts(spark, sf_dir):
    """Titles as claims: the first page of each judged by its length, joined back to all."""
    p = read_table(spark, sf_dir, "pages").select("page_id", _title(F.col("html")).alias("title"))
    v = F.when(F.length("title") > 80, "refuted").when(F.length("title") > 30, "supported")
    return sibling_verdicts(p, F.lower(F.trim("title")), "page_id", v).select("page_id", "verdict")


def removal_guards(spark, sf_dir):
    """Customers by nation: lines returned as removals."""
    return removal_guard(read_table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")


def gaps_without_open_order(spark, sf_dir):
    """Customers without an open order, with their newest finished one and the days since."""
    o = read_table(spark, sf_dir, "orders")
    busy = o.filter("o_orderstatus = 'O'").select("o_custkey")
    done = o.filter("o_orderstatus = 'F'").join(busy, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return done.select("o_custkey", F.col("r.o_orderkey").alias("last_order"), F.datediff(F.to_date(F.lit("2001-08-01")), F.col("r.o_orderdate")).cast("long").alias("days"))


def missing_types(spark, sf_dir):
    """Order priorities that a customer with five or more orders never used, as wanted types that aren't present."""
    o = read_table(spark, sf_dir, "orders")
    kinds = o.select("o_orderpriority").distinct()  # a handful of types
    many = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.collect_set("o_orderpriority").alias("has")).filter("n >= 5")
    wanted = kinds.agg(F.collect_set("o_orderpriority")).first()[0] or []
    return many.select("o_custkey", F.explode(F.array_except(F.array(*map(F.lit, sorted(wanted))).cast("array<string>"), "has")).alias("missing"))


def serp_rollup(spark, sf_dir):
    """Parts as URLs: lines, suppliers as seeds, best place (99 where none is below 6) and an additive score."""
    line = read_table(spark, sf_dir, "lineitem")
    by = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(F.col("l_linenumber") < 6, F.col("l_linenumber"))), F.lit(99)).cast("long").alias("best"), F.array_join(F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("seeds"))
    score = F.least(F.lit(40), 5 * F.col("n")) + F.when(F.col("best") <= 3, 30).when(F.col("best") <= 10, 15).otherwise(0)
    return by.select("l_partkey", "n", "best", "seeds", score.cast("long").alias("score"))


def question_union(spark, sf_dir):
    """Part names by brand: those of large parts up to 8, then others until there are 5."""
    p = read_table(spark, sf_dir, "part")
    return union_with_minimum(p, "p_brand", F.col("p_name"), F.col("p_size") >= 45, [F.col("p_partkey")], 5, 8).select("p_brand", "p_partkey", "rank")


def sentence_redundancy(spark, sf_dir):
    return redundant_sentences(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def demand_dollars(spark, sf_dir):
    """Orders of each nation's customers as demand, in money."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    v = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("volume"))
    return dollar_model(v, "volume", {"click": 0.25, "inquiry": 0.5, "close": 0.5, "value": 1200, "cost": 64})


def benchmark_best_document(spark, sf_dir):
    """Of each benchmark item the document that shares most three-word runs with it, by Jaccard index."""
    from .text import shingle_jaccard_benchmark

    pairs = shingle_jaccard_benchmark(spark, sf_dir)
    return pairs.groupBy(F.col("right_id").alias("item_id")).agg(F.max("jaccard").alias("jaccard"), F.max_by("left_id", F.struct("jaccard", -F.col("left_id"))).alias("doc_id"))


def work_by_owner(spark, sf_dir):
    """Orders as tasks of customers by nation and status: tasks, mean price over those priced above 1000, share without, and a band of load."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    priced = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice").cast("decimal(18,2)"))
    by = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("tasks"), F.sum(priced).alias("total"), F.count(priced).alias("known"))
    load = F.when(F.col("tasks") > 250, "over").when(F.col("tasks") > 150, "full").otherwise("free")
    return by.select("c_nationkey", "o_orderstatus", "tasks", F.floor(F.col("total") / F.col("known")).cast("long").alias("mean"), half_up(100 * (F.col("tasks") - F.col("known")) / F.col("tasks"), 1).alias("missing_pct"), load.alias("load"))


def due_order(spark, sf_dir):
    """Orders of a customer in the order of work: by date, missing dates (of open orders) last, then by priority digit."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("due"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce("due", F.to_timestamp(F.lit("9999-12-31"))), "p", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (vitals_by_type, order_calendar, url_rubric_top, claim_verdicts, removal_guards, gaps_without_open_order, missing_types, serp_rollup, question_union, sentence_redundancy, demand_dollars, benchmark_best_document, work_by_owner, due_order)}

_T = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_CONVERSION = " + ".join(f"CAST(contains(lower(t), '{w}') AS INT)" for w in CONVERSION)

from .text import ORACLE_SQL as _TEXT_SQL  # noqa: E402

ORACLE_SQL = {
    "vitals_by_type": """WITH s AS (SELECT event_type, CAST(floor(abs(value)) * 40 AS BIGINT) / 1000 AS s FROM events) SELECT event_type, CASE WHEN s <= 2.5 THEN 'good' WHEN s <= 4 THEN 'needs work' ELSE 'poor' END AS status, count(*) AS n FROM s GROUP BY ALL""",
    "order_calendar": """SELECT strftime(w, '%Y-%m-%d') AS week, n AS orders, year(w) || '-q' || quarter(w) AS quarter, floor(date_diff('day', w, DATE '2001-08-01') / 30.44::DOUBLE * 10 + 0.5) / 10 AS months
      FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS w, count(*) AS n FROM orders GROUP BY 1)""",
    "url_rubric_top": f"""WITH p AS (SELECT page_id, url, {_T} AS t, regexp_extract(url, '([^./]+\\.[^./]+)(?:[/?#]|$)', 1) AS root, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages),
      k AS (SELECT *, CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 0.2::DOUBLE WHEN regexp_matches(path, '{DATED}') OR regexp_matches(path, '{ARTICLE}') THEN 0.4::DOUBLE WHEN regexp_matches(lower(t), '{OPENS_AS_GUIDE}') THEN 0.3::DOUBLE WHEN regexp_matches(lower(t), '{GUIDE}') THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS kind FROM p),
      s AS (SELECT root, page_id, floor((0.35::DOUBLE * (1 - page_id % 10 / 10) + 0.3::DOUBLE * kind + 0.2::DOUBLE * ((CAST(contains(lower(t), 'the') AS INT) + CAST(contains(lower(t), 'and') AS INT)) / 2) + 0.15::DOUBLE * least(1.0::DOUBLE, ({_CONVERSION}) / 2)) * 100 + 0.5) / 100 AS score FROM k)
      SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, page_id) AS rank FROM s QUALIFY rank <= 10""",
    "claim_verdicts": f"""WITH p AS (SELECT page_id, {_T} AS t FROM pages), f AS (SELECT lower(trim(t)) AS key, arg_min(t, page_id) AS t FROM p GROUP BY 1)
      SELECT page_id, CASE WHEN length(f.t) > 80 THEN 'refuted' WHEN length(f.t) > 30 THEN 'supported' ELSE 'inconclusive' END AS verdict FROM p JOIN f ON lower(trim(p.t)) = key""",
    "removal_guards": """WITH n AS (SELECT l_suppkey, count(*) AS judged, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS removals FROM lineitem GROUP BY 1) SELECT *, removals > 8 OR judged >= 4 AND removals > 0.5 * judged AS aborted FROM n""",
    "gaps_without_open_order": """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-08-01') AS days FROM orders
      WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""",
    "missing_types": """WITH m AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT DISTINCT o_orderpriority AS missing FROM orders)
      SELECT o_custkey, missing FROM m, k WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = m.o_custkey AND o_orderpriority = missing)""",
    "serp_rollup": """WITH b AS (SELECT l_partkey, count(*) AS n, coalesce(min(CASE WHEN l_linenumber < 6 THEN l_linenumber END), 99) AS best, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS seeds FROM lineitem GROUP BY 1)
      SELECT *, least(40, 5 * n) + CASE WHEN best <= 3 THEN 30 WHEN best <= 10 THEN 15 ELSE 0 END AS score FROM b""",
    "question_union": """WITH k AS (SELECT p_brand, p_partkey, p_size >= 45 AS f, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part), o AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY p_brand, key ORDER BY f DESC, p_partkey) = 1)
      SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY f DESC, p_partkey) AS rank FROM o) WHERE CASE WHEN f THEN rank <= 8 ELSE rank <= 5 END""",
    "sentence_redundancy": r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?]+')) AS s, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), 1) AS k FROM documents),
      w AS (SELECT doc_id, k, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM s), b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM w), n AS (SELECT doc_id, len(w) AS x, len(b) AS y, len(list_intersect(w, b)) AS z FROM b WHERE len(w) >= 4 AND len(b) >= 4)
      SELECT doc_id, count(CASE WHEN z / (x + y - z) >= 0.72 OR z / least(x, y) >= 0.85 THEN 1 END) AS redundant FROM n GROUP BY 1""",
    "demand_dollars": """WITH v AS (SELECT c_nationkey, count(*) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      SELECT *, floor(volume * 0.125::DOUBLE * 10 + 0.5) / 10 AS inquiries, floor(volume * 0.0625::DOUBLE * 10 + 0.5) / 10 AS patients, CAST(floor(volume * 75 + 0.5) AS BIGINT) AS revenue, CAST(floor(volume * 8 + 0.5) AS BIGINT) AS budget FROM v""",
    "benchmark_best_document": f"SELECT right_id AS item_id, max(jaccard) AS jaccard, arg_max(left_id, (jaccard, -left_id)) AS doc_id FROM ({_TEXT_SQL['shingle_jaccard_benchmark']}) GROUP BY 1",
    "work_by_owner": """SELECT c_nationkey, o_orderstatus, count(*) AS tasks, CAST(floor(CAST(sum(CASE WHEN o_totalprice > 1000 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / count(CASE WHEN o_totalprice > 1000 THEN 1 END)) AS BIGINT) AS mean,
      floor(100 * (count(*) - count(CASE WHEN o_totalprice > 1000 THEN 1 END)) / count(*) * 10 + 0.5) / 10 AS missing_pct, CASE WHEN count(*) > 250 THEN 'over' WHEN count(*) > 150 THEN 'full' ELSE 'free' END AS load FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "due_order": """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'O' THEN o_orderdate ELSE TIMESTAMP '9999-12-31' END, CAST(substring(o_orderpriority, 1, 1) AS INT), o_orderkey) AS rank FROM orders""",
}
