"""Regional demand: aggregates, indexes, components, tiers and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, median0, min_max, slope_pct
from ..runtime import read_table

EARTH_MILES, MOST_HOMES = 3958.8, 10_000
WEIGHTS = {"demand": 0.5, "cost": 0.2, "ease": 0.3}  # a default, to be replaced by a user's own


def region_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo, term, volume, cpc, competition: orders of each nation's customers by priority."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").alias("geo"), F.col("o_orderpriority").alias("term")).agg(
        F.count(F.lit(1)).alias("volume"), half_up(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("cpc"), half_up(F.avg((F.col("o_orderstatus") == "F").cast("double")), 4).cast("decimal(12,4)").alias("competition")
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo, population, is_home."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geo"), (F.col("n_regionkey") == 0).alias("is_home"))
    people = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("geo")).agg(F.count(F.lit(1)).alias("population"))
    return n.join(people, "geo", "left")


def compare(terms: DataFrame, geos: DataFrame) -> DataFrame:
    """Per region: volume, median cost, mean competition, coverage, per-capita volume and index against home."""
    total = terms.agg(F.countDistinct("term")).first()[0] or 1
    agg = terms.groupBy("geo").agg(F.sum("volume").alias("volume"), half_up(median0(F.col("cpc")), 2).alias("cpc"), (F.floor(F.avg(F.col("competition").cast("decimal(12,4)")) * 100 + F.lit(0.5).cast("decimal(3,1)")) / 100).cast("double").alias("competition"), (F.count_if(F.col("volume") > 0) / total).alias("coverage"))
    rows = geos.join(agg, "geo")
    per_capita = F.when(F.col("population") > 0, F.col("volume") * 100000 / F.col("population"))
    home = F.sum(F.when(F.col("is_home"), F.col("volume"))).over(Window.partitionBy())
    v = F.col("volume")
    confidence = F.when((v >= 500) & (F.col("coverage") >= 0.5), "high").when((v >= 100) & (F.col("coverage") >= 0.3), "medium").when(v > 0, "low").otherwise("insufficient")
    return rows.select("geo", "is_home", "volume", "cpc", "competition", "coverage", half_up(per_capita, 1).alias("per_capita"), half_up(100 * v / home, 0).cast("long").alias("home_index"), confidence.alias("confidence"))


def percentile(x: Column) -> Column:
    """Rank of a value among those that aren't null, 0..100: shares strictly below; 100 for a single one, null for null."""
    n, below = F.count(x).over(Window.partitionBy()), F.rank().over(Window.orderBy(x.asc_nulls_last())) - 1
    return F.when(x.isNull(), None).when(n <= 1, 100).otherwise(half_up(100 * below / (n - 1), 0)).cast("long")


def weighted_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """0..100: the parts' mean by weights that are renormalized over those that aren't null; null where all are."""
    there = {k: F.when(c.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, c in parts.items()}
    total = sum(there.values())
    won = sum(there[k] * F.coalesce(c, F.lit(0.0)) for k, c in parts.items())
    return F.when(total > 0, F.floor(F.round(won / total * 100, 9) + 0.5).cast("long"))


def tier(score: Column, confidence: Column) -> Column:
    """The tier of a score, which a low confidence holds down; home regions get none elsewhere."""
    medium, low = confidence.isin("medium", "high"), confidence.isin("low", "medium", "high")
    return (
        F.when(score.isNull() | ~low, "insufficient")
        .when((score >= 70) & medium, "prioritize")
        .when((score >= 55) & medium, "strong")
        .when(score < 35, "deprioritize")
        .otherwise("monitor")
    )


def components(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Normalized demand, cost and competition (the latter two inverted), percent rank, score and tier.

    All windows span the regions, a small dimension whatever the size of the facts.
    """
    w = Window.partitionBy()
    weights = weights or WEIGHTS
    parts = {"demand": min_max(F.col("per_capita"), w), "cost": 1 - min_max(F.col("cpc"), w), "ease": 1 - min_max(F.col("competition"), w)}
    out = rows.select("geo", "is_home", "confidence", *[half_up(c, 4).alias(k) for k, c in parts.items()], percentile(F.col("per_capita")).alias("percentile"))
    out = out.withColumn("score", weighted_score({k: F.col(k) for k in parts}, weights))
    return out.withColumn("tier", F.when(~F.col("is_home"), tier(F.col("score"), F.col("confidence")))).drop("confidence")


def top_and_other(rows: DataFrame, group: str, key: str, value: str, k: int) -> DataFrame:
    """The k greatest keys of each group and the rest as "other", with shares (2 dp)."""
    ranked = rows.filter(F.col(value) > 0).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), key)))
    kept = ranked.groupBy(group, F.when(F.col("_n") <= k, F.col(key)).otherwise("other").alias(key)).agg(F.sum(value).alias(value))
    return kept.withColumn("share", half_up(F.col(value) / F.sum(value).over(Window.partitionBy(group)), 2))


def term_diff(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Volumes of two terms by region, all regions of either, and their difference where both exist."""
    side = lambda term, name: rows.filter(F.col("term") == term).select("geo", F.col("volume").alias(name))
    both = side(left, "left_volume").join(side(right, "right_volume"), "geo", "full")
    return both.withColumn("delta", F.col("right_volume") - F.col("left_volume")).withColumn("order_key", F.coalesce("right_volume", "left_volume", F.lit(-1).cast("long")))


def market_compare(spark, sf_dir):
    return compare(region_terms(spark, sf_dir), regions(spark, sf_dir))


def market_components(spark, sf_dir):
    return components(market_compare(spark, sf_dir))


def term_breakdown_other(spark, sf_dir):
    return top_and_other(region_terms(spark, sf_dir), "geo", "term", "volume", 3)


def market_trend(spark, sf_dir):
    """Slope of monthly orders, in per cent of the mean month, per nation."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    monthly = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("geo"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return monthly.groupBy("geo").agg(slope_pct(F.col("n").cast("double"), F.col("m").cast("double")).alias("slope_pct"), F.min_by("n", "m").alias("first"), F.max_by("n", "m").alias("last"))


def adjacent_geos(spark, sf_dir):
    """Nations within 3500 miles of any home nation, at synthetic places, nearest first."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geo"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") * 7 % 50).cast("double").alias("lat"), (F.col("n_nationkey") * 13 % 90).cast("double").alias("lon"))
    homes = n.filter("region = 0").select(F.col("lat").alias("a"), F.col("lon").alias("o"))  # the tracked homes: a handful of rows
    rad = F.radians
    h = F.pow(F.sin((rad("lat") - rad("a")) / 2), 2) + F.cos(rad("a")) * F.cos(rad("lat")) * F.pow(F.sin((rad("lon") - rad("o")) / 2), 2)
    miles = half_up(2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), F.sqrt(h))), 0).cast("long")
    few = homes.count() <= MOST_HOMES  # else a nested loop over partitions of both sides
    near = n.filter("region <> 0").join(F.broadcast(homes) if few else homes, miles <= 3500)
    return near.groupBy("geo").agg(F.min(miles).alias("miles"))


def scenario_diff(spark, sf_dir):
    """Volumes of urgent against low-priority demand by region, with a difference where both exist."""
    return term_diff(region_terms(spark, sf_dir), "1-URGENT", "5-LOW")


def dashboard_left_joins(spark, sf_dir):
    """Orders by nation and region names, with missing names as empty text; dimensions join by their size."""
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return wide.groupBy(F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))


QUERIES = {f.__name__: f for f in (market_compare, market_components, term_breakdown_other, market_trend, adjacent_geos, scenario_diff, dashboard_left_joins)}

TERMS_SQL = """terms AS (SELECT c_nationkey AS geo, o_orderpriority AS term, count(*) AS volume, floor(CAST(avg(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 100 + 0.5) / 100 AS cpc,
      CAST(floor(avg(CAST(o_orderstatus = 'F' AS DOUBLE)) * 10000 + 0.5) / 10000 AS DECIMAL(12,4)) AS competition FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
COMPARE_SQL = f"""{TERMS_SQL}, geos AS (SELECT n_nationkey AS geo, n_regionkey = 0 AS is_home, population FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1) ON n_nationkey = c_nationkey),
      agg AS (SELECT geo, CAST(sum(volume) AS BIGINT) AS volume, floor(median(cpc) * 100 + 0.5) / 100 AS cpc, floor(CAST(round(sum(competition) / count(competition), 8) AS DECIMAL(18,8)) * 100 + 0.5) / 100 AS competition, count(CASE WHEN volume > 0 THEN 1 END) / (SELECT count(DISTINCT term) FROM terms) AS coverage FROM terms GROUP BY geo),
      cmp AS (SELECT geo, is_home, volume, cpc, competition, coverage, floor(volume * 100000 / population * 10 + 0.5) / 10 AS per_capita,
        CAST(floor(100 * volume / sum(CASE WHEN is_home THEN volume END) OVER () + 0.5) AS BIGINT) AS home_index,
        CASE WHEN volume >= 500 AND coverage >= 0.5 THEN 'high' WHEN volume >= 100 AND coverage >= 0.3 THEN 'medium' WHEN volume > 0 THEN 'low' ELSE 'insufficient' END AS confidence FROM geos JOIN agg USING (geo))"""

ORACLE_SQL = {
    "market_compare": f"WITH {COMPARE_SQL} SELECT * FROM cmp",
    "market_components": f"""WITH {COMPARE_SQL},
      n AS (SELECT geo, is_home, confidence, per_capita, CASE WHEN per_capita IS NULL THEN NULL WHEN max(per_capita) OVER () = min(per_capita) OVER () THEN 0.5::DOUBLE ELSE (per_capita - min(per_capita) OVER ()) / (max(per_capita) OVER () - min(per_capita) OVER ()) END AS d,
        1 - CASE WHEN max(cpc) OVER () = min(cpc) OVER () THEN 0.5::DOUBLE ELSE (cpc - min(cpc) OVER ()) / (max(cpc) OVER () - min(cpc) OVER ()) END AS c,
        1 - CASE WHEN max(competition) OVER () = min(competition) OVER () THEN 0.5::DOUBLE ELSE (competition - min(competition) OVER ()) / (max(competition) OVER () - min(competition) OVER ()) END AS e FROM cmp),
      s AS (SELECT geo, is_home, confidence, floor(d * 10000 + 0.5) / 10000 AS demand, floor(c * 10000 + 0.5) / 10000 AS cost, floor(e * 10000 + 0.5) / 10000 AS ease,
        CASE WHEN per_capita IS NULL THEN NULL WHEN count(per_capita) OVER () <= 1 THEN 100 ELSE CAST(floor(100 * (rank() OVER (ORDER BY per_capita NULLS LAST) - 1) / (count(per_capita) OVER () - 1) + 0.5) AS BIGINT) END AS percentile FROM n),
      w AS (SELECT *, CAST(floor(round((CASE WHEN demand IS NULL THEN 0 ELSE 0.5::DOUBLE * demand END + 0.2::DOUBLE * cost + 0.3::DOUBLE * ease) / (CASE WHEN demand IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * 100, 9) + 0.5) AS BIGINT) AS score FROM s)
      SELECT geo, is_home, demand, cost, ease, percentile, score, CASE WHEN is_home THEN NULL WHEN score IS NULL OR confidence = 'insufficient' THEN 'insufficient' WHEN score >= 70 AND confidence IN ('medium', 'high') THEN 'prioritize'
        WHEN score >= 55 AND confidence IN ('medium', 'high') THEN 'strong' WHEN score < 35 THEN 'deprioritize' ELSE 'monitor' END AS tier FROM w""",
    "term_breakdown_other": f"""WITH {TERMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY volume DESC, term) AS n FROM terms),
      k AS (SELECT geo, CASE WHEN n <= 3 THEN term ELSE 'other' END AS term, CAST(sum(volume) AS BIGINT) AS volume FROM r GROUP BY ALL)
      SELECT *, floor(volume / sum(volume) OVER (PARTITION BY geo) * 100 + 0.5) / 100 AS share FROM k""",
    "market_trend": """WITH m AS (SELECT c_nationkey AS geo, month(o_orderdate) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
      SELECT geo, floor(coalesce(regr_slope(CAST(n AS DOUBLE), CAST(m AS DOUBLE)) / avg(n) * 100, 0) * 10 + 0.5) / 10 AS slope_pct, arg_min(n, m) AS first, arg_max(n, m) AS last FROM m GROUP BY geo""",
    "adjacent_geos": """WITH n AS (SELECT n_nationkey AS geo, n_regionkey AS region, CAST(n_nationkey * 7 % 50 AS DOUBLE) AS lat, CAST(n_nationkey * 13 % 90 AS DOUBLE) AS lon FROM nation),
      d AS (SELECT x.geo, CAST(floor(2 * 3958.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(x.lat) - radians(h.lat)) / 2), 2) + cos(radians(h.lat)) * cos(radians(x.lat)) * pow(sin((radians(x.lon) - radians(h.lon)) / 2), 2)))) + 0.5) AS BIGINT) AS miles
        FROM n x, n h WHERE x.region <> 0 AND h.region = 0)
      SELECT geo, min(miles) AS miles FROM d WHERE miles <= 3500 GROUP BY geo""",
    "scenario_diff": f"""WITH {TERMS_SQL}, l AS (SELECT geo, volume AS left_volume FROM terms WHERE term = '1-URGENT'), r AS (SELECT geo, volume AS right_volume FROM terms WHERE term = '5-LOW')
      SELECT geo, left_volume, right_volume, right_volume - left_volume AS delta, coalesce(right_volume, left_volume, -1) AS order_key FROM l FULL JOIN r USING (geo)""",
    "dashboard_left_joins": """SELECT coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region, c_mktsegment AS segment, count(*) AS customers
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
