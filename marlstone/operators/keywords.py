"""Keyword rankings: buckets, gaps, pivots, dedupes and rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import read_table

PER_BAND, PIVOT_ROWS = 25, 100


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, keyword, volume, position: suppliers rank for parts by quantity sold."""
    sold = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("domain"), F.col("l_partkey").alias("keyword")).agg(F.sum("l_quantity").cast("long").alias("volume"))
    order = Window.partitionBy("domain").orderBy(F.desc("volume"), "keyword")
    return sold.withColumn("position", F.row_number().over(order).cast("long"))


def position_buckets(rows: DataFrame, by: str = "domain") -> DataFrame:
    """Counts by page of results; a position of zero or less counts as page two."""
    p = F.col("position")
    return rows.groupBy(by).agg(
        F.count_if((p >= 1) & (p <= 10)).alias("page1"),
        F.count_if((p <= 20) & ~((p >= 1) & (p <= 10))).alias("page2"),
        F.count_if((p > 20) & (p <= 50)).alias("page3to5"),
        F.count_if((p > 50) & (p <= 100)).alias("page6to10"),
        F.count(F.lit(1)).alias("total"),
    )


def gap_bands(rows: DataFrame, client: int | str, per_band: int = PER_BAND) -> DataFrame:
    """Keywords where a competitor is in the first ten: missing, striking (11..50) or
    untapped (beyond) for the client; the best competitor and the top of each band.

    One aggregation finds both sides, so the rankings are shuffled once.
    """
    mine = F.col("domain") == F.lit(client)
    rival = ~mine & (F.col("position") <= 10)
    best = rows.groupBy("keyword").agg(
        F.min(F.when(mine, F.col("position"))).alias("client_position"),
        F.min(F.when(rival, F.struct("position", "domain", "volume"))).alias("best"),
    )
    p = F.col("client_position")
    band = F.when(p.isNull(), "missing").when((p >= 11) & (p <= 50), "striking").when(p > 50, "untapped")
    flat = best.filter("best IS NOT NULL").select(band.alias("band"), "keyword", F.col("best.domain").alias("competitor"), F.col("best.position").alias("competitor_position"), F.col("best.volume").alias("volume"), "client_position")
    order = Window.partitionBy("band").orderBy(F.desc("volume"), "keyword")
    return flat.filter("band IS NOT NULL").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= per_band)


def client_of(rows: DataFrame) -> int:
    return rows.agg(F.min("domain")).first()[0]


def detail_pivot(rows: DataFrame, limit: int = PIVOT_ROWS) -> DataFrame:
    """keyword x domain positions as sorted "domain:position" text; the first domain's volume; top by volume."""
    top = rows.groupBy("keyword").agg(F.min_by("volume", "domain").alias("volume")).orderBy(F.desc("volume"), "keyword").limit(limit)
    wide = rows.join(top.select("keyword"), "keyword", "left_semi").groupBy("keyword").agg(
        F.min_by("volume", "domain").alias("volume"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("domain", "position"))), lambda x: F.concat_ws(":", x["domain"].cast("string"), x["position"].cast("string"))), ",").alias("positions"),
    )
    return wide.orderBy(F.desc("volume"), "keyword").limit(limit)


def top_share(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Top keys by volume with their share of what is kept, in whole per cent."""
    top = rows.groupBy(key).agg(F.count(F.lit(1)).alias("keywords"), F.sum("volume").alias("volume")).orderBy(F.desc("volume"), key).limit(k)
    return top.withColumn("share", F.floor(100 * F.col("volume") / F.sum("volume").over(Window.partitionBy()) + 0.5).cast("long"))


def dedupe_argmax(rows: DataFrame, key: Column, source: str) -> DataFrame:
    """Per key: the row of the highest volume (the first on ties), and how many sources have it."""
    return rows.groupBy(key.alias("key")).agg(F.max_by(source, F.struct(F.col("volume"), -F.col(source))).alias("source"), F.max("volume").alias("volume"), F.countDistinct(source).alias("sources"))


def cap_per_key(rows: DataFrame, key: str, order: list[Column], most: int = 2) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def composite_score(rows: DataFrame, alignment: Column) -> DataFrame:
    """0.8 alignment (missing: 0) + 0.2 volume over the greatest volume (1 at least), found beforehand as one row."""
    top = rows.agg(F.greatest(F.max("volume"), F.lit(1))).first()[0] or 1
    return rows.withColumn("score", F.floor((0.8 * F.coalesce(alignment, F.lit(0.0)) + 0.2 * F.coalesce("volume", F.lit(0)) / F.lit(top)) * 10000 + 0.5) / 10000)


RANKING_SQL = """ranking AS (
  SELECT domain, keyword, volume, row_number() OVER (PARTITION BY domain ORDER BY volume DESC, keyword) AS position
  FROM (SELECT l_suppkey AS domain, l_partkey AS keyword, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY ALL))"""


def kw_position_buckets(spark, sf_dir):
    return position_buckets(ranking(spark, sf_dir))


def kw_gap_bands(spark, sf_dir):
    rows = ranking(spark, sf_dir)
    return gap_bands(rows, client_of(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("domain"))))


def kw_detail_pivot(spark, sf_dir):
    return detail_pivot(ranking(spark, sf_dir))


def top_pages_share(spark, sf_dir):
    return top_share(ranking(spark, sf_dir), "domain")


def kw_dedupe_argmax(spark, sf_dir):
    return dedupe_argmax(ranking(spark, sf_dir), F.col("keyword"), "domain")


def url_cap_score(spark, sf_dir):
    return cap_per_key(ranking(spark, sf_dir), "keyword", [F.desc("volume"), F.col("domain")]).select("domain", "keyword", "volume")


def url_cap_arrival(spark, sf_dir):
    return cap_per_key(ranking(spark, sf_dir), "keyword", [F.col("domain")]).select("domain", "keyword", "volume")


def kw_composite_score(spark, sf_dir):
    best = ranking(spark, sf_dir).groupBy("keyword").agg(F.max("volume").alias("volume"), F.min("position").alias("position"))
    return composite_score(best, F.when(F.col("position") <= 50, 1.0 / F.col("position"))).orderBy(F.desc("score"), "keyword")


def url_frequency(spark, sf_dir):
    """Best position, number of queries and tier by number of sources, per keyword."""
    n = F.count(F.lit(1))
    return ranking(spark, sf_dir).groupBy("keyword").agg(F.min("position").alias("best_position"), n.alias("frequency"), F.when(n >= 3, "core").when(n == 2, "relevant").otherwise("discovery").alias("tier"))


def anti_join_tracked(spark, sf_dir):
    """Domains with a first-page keyword that the client does not have in its first ten."""
    rows = ranking(spark, sf_dir).filter("position <= 10")
    client = client_of(read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("domain")))
    mine = rows.filter(F.col("domain") == client).select("keyword")
    return rows.filter(F.col("domain") != client).join(mine, "keyword", "left_anti").groupBy("domain").agg(F.count(F.lit(1)).alias("keywords"))


QUERIES = {f.__name__: f for f in (kw_position_buckets, kw_gap_bands, kw_detail_pivot, top_pages_share, kw_dedupe_argmax, url_cap_score, url_cap_arrival, kw_composite_score, url_frequency, anti_join_tracked)}

ORACLE_SQL = {
    "kw_position_buckets": f"""WITH {RANKING_SQL} SELECT domain, count(CASE WHEN position BETWEEN 1 AND 10 THEN 1 END) AS page1,
      count(CASE WHEN position <= 20 AND NOT position BETWEEN 1 AND 10 THEN 1 END) AS page2, count(CASE WHEN position > 20 AND position <= 50 THEN 1 END) AS page3to5,
      count(CASE WHEN position > 50 AND position <= 100 THEN 1 END) AS page6to10, count(*) AS total FROM ranking GROUP BY domain""",
    "kw_gap_bands": f"""WITH {RANKING_SQL}, c AS (SELECT min(l_suppkey) AS client FROM lineitem),
      mine AS (SELECT keyword, min(position) AS client_position FROM ranking, c WHERE domain = client GROUP BY keyword),
      rival AS (SELECT keyword, domain, position, volume, row_number() OVER (PARTITION BY keyword ORDER BY position, domain) AS n
                FROM ranking, c WHERE domain <> client AND position <= 10),
      b AS (SELECT CASE WHEN client_position IS NULL THEN 'missing' WHEN client_position BETWEEN 11 AND 50 THEN 'striking' WHEN client_position > 50 THEN 'untapped' END AS band,
                   keyword, domain AS competitor, position AS competitor_position, volume, client_position FROM rival LEFT JOIN mine USING (keyword) WHERE n = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY volume DESC, keyword) AS rank FROM b WHERE band IS NOT NULL)
      SELECT * FROM r WHERE rank <= 25""",
    "kw_detail_pivot": f"""WITH {RANKING_SQL} SELECT keyword, arg_min(volume, domain) AS volume, string_agg(domain || ':' || position, ',' ORDER BY domain) AS positions
      FROM ranking GROUP BY keyword ORDER BY volume DESC, keyword LIMIT 100""",
    "top_pages_share": f"""WITH {RANKING_SQL}, t AS (SELECT domain, count(*) AS keywords, CAST(sum(volume) AS BIGINT) AS volume FROM ranking GROUP BY domain ORDER BY volume DESC, domain LIMIT 10)
      SELECT *, CAST(floor(100 * volume / sum(volume) OVER () + 0.5) AS BIGINT) AS share FROM t""",
    "kw_dedupe_argmax": f"""WITH {RANKING_SQL} SELECT keyword AS key, arg_max(domain, {{'v': volume, 'd': -domain}}) AS source, max(volume) AS volume, count(DISTINCT domain) AS sources FROM ranking GROUP BY keyword""",
    "url_cap_score": f"""WITH {RANKING_SQL} SELECT domain, keyword, volume FROM ranking QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY volume DESC, domain) <= 2""",
    "url_cap_arrival": f"""WITH {RANKING_SQL} SELECT domain, keyword, volume FROM ranking QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY domain) <= 2""",
    "kw_composite_score": f"""WITH {RANKING_SQL}, b AS (SELECT keyword, max(volume) AS volume, min(position) AS position FROM ranking GROUP BY keyword)
      SELECT *, floor((0.8::DOUBLE * coalesce(CASE WHEN position <= 50 THEN 1.0::DOUBLE / position END, 0) + 0.2::DOUBLE * volume / greatest(max(volume) OVER (), 1)) * 10000 + 0.5) / 10000 AS score
      FROM b""",
    "url_frequency": f"""WITH {RANKING_SQL} SELECT keyword, min(position) AS best_position, count(*) AS frequency,
      CASE WHEN count(*) >= 3 THEN 'core' WHEN count(*) = 2 THEN 'relevant' ELSE 'discovery' END AS tier FROM ranking GROUP BY keyword""",
    "anti_join_tracked": f"""WITH {RANKING_SQL}, c AS (SELECT min(l_suppkey) AS client FROM lineitem), t AS (SELECT * FROM ranking WHERE position <= 10)
      SELECT domain, count(*) AS keywords FROM t, c WHERE domain <> client AND keyword NOT IN (SELECT keyword FROM t, c WHERE domain = client) GROUP BY domain""",
}
