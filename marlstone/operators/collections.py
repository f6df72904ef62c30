"""Collections of JSON documents: scans, writes, expiry, fingerprints.

A collection is a table (id, data, created_at, updated_at), data being JSON
text. Writes return the collection as it is afterwards; a caller writes it with
``mode("overwrite")``, by partition where it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.running import running
from ..runtime import read_table

PURGE_AGE = "INTERVAL 180 DAYS"


def field(name: str, data: str = "data") -> Column:
    return F.get_json_object(data, f"$.{name}")


def matches(filters: dict, skip_null: bool = True) -> Column:
    """All fields equal to the values' text; null values are skipped, or match the text "null"."""
    out = F.lit(True)
    for k, v in filters.items():
        if v is None and skip_null:
            continue
        out = out & F.coalesce(field(k) == F.lit("null" if v is None else str(v)), F.lit(False))
    return out


def scan(rows: DataFrame, filters: dict, order_field: str | None = None, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """Matching rows, oldest first, or by the text of a field, ties by id."""
    by = field(order_field) if order_field else F.col("created_at")
    out = rows.filter(matches(filters)).orderBy(by.asc() if ascending else by.desc(), "id")
    return out if limit is None else out.limit(limit)


def first_match(rows: DataFrame, filters: dict) -> DataFrame:
    """The oldest matching row, by one aggregation; none for no match."""
    found = rows.filter(matches(filters)).agg(F.min(F.struct("created_at", "id", "data", "updated_at")).alias("r"))
    return found.filter("r IS NOT NULL").select("r.id", "r.data", "r.created_at", "r.updated_at")


def exists(rows: DataFrame, filters: dict) -> bool:
    return not rows.filter(matches(filters)).limit(1).isEmpty()


def merge_patch(rows: DataFrame, patches: DataFrame, key: str, now: Column) -> DataFrame:
    """Typed rows with the columns of ``patches`` that aren't null put over theirs; rows without a patch stay as they are."""
    changed = [c for c in patches.columns if c != key]
    p = patches.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changed])
    joined = rows.join(p, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    value = lambda c: F.coalesce(f"_{c}", c) if c in changed else F.when(hit, now).otherwise(F.col(c)) if c == "updated_at" else F.col(c)
    return joined.select(*[value(c).alias(c) for c in rows.columns])


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, the latest of each key, with the key's first created_at; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != "created_at"]
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.select(*rows.columns).withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.min("created_at").alias("created_at"), F.max_by(F.struct(*rest), F.struct("_new", "updated_at")).alias("_r"))
    return best.select(*keys, "created_at", "_r.*").select(*rows.columns)


def replace_for(rows: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """The rows with all of those owners' rows replaced that appear in ``new``."""
    return rows.join(new.select(owner).distinct(), owner, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def remove_where(rows: DataFrame, filters: dict) -> tuple[DataFrame, int]:
    """The rows left and the number removed; a null filter value matches the text "null"."""
    hit = matches(filters, skip_null=False)
    return rows.filter(~hit), rows.filter(hit).count()


def cache_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def purge_state(rows: DataFrame, now: Column) -> Column:
    """"expired" (pass one), "aged" (no expiry and older than PURGE_AGE, pass two) or "live"."""
    return F.when(F.col("expires_at") < now, "expired").when(F.col("expires_at").isNull() & (F.col("at") < now - F.expr(PURGE_AGE)), "aged").otherwise("live")


def settings_with(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """key, value: a user's own setting, else the default."""
    o = own.select(F.col("key"), F.col("value").alias("_own"))
    return defaults.join(o, "key", "full").select("key", F.coalesce("_own", "value").alias("value"))


def fingerprint(rows: DataFrame, group: str, key: Column, version: Column) -> DataFrame:
    """group, fingerprint: ten hex digits of the SHA-1 of the sorted key@version of its members.

    Members of one group are gathered, so groups are sets of limited size by their nature (terms of a basket).
    """
    item = F.concat_ws("@", key.cast("string"), version.cast("string"))
    return rows.groupBy(group).agg(F.substring(F.sha1(F.concat_ws(",", F.array_sort(F.collect_set(item)))), 1, 10).alias("fingerprint"))


def dedupe_pool(rows: DataFrame, text: str, volume: str) -> DataFrame:
    """keyword, volume, low, local: per trimmed lower-case keyword the highest volume; flags for a volume
    below 10 and for text that names a place by "near" or "in"."""
    key = F.lower(F.trim(text)).alias("keyword")
    best = rows.groupBy(key).agg(F.max(volume).alias("volume")).filter("keyword <> ''")
    return best.select("keyword", "volume", (F.col("volume") < 10).alias("low"), F.col("keyword").rlike(r"\b(near|in)\b").alias("local"))


def two_band_rank(rows: DataFrame, band: Column, order: list[Column], group: str) -> DataFrame:
    """``rank`` within the group: rows of the band first, then the others, each in order; a group may be of any size."""
    return running(rows, [group], [F.when(band, 0).otherwise(1), *order], {"rank": ("count", None)})


def nulls_last_rank(rows: DataFrame, group: str, by: str, ascending: bool, tie: str) -> DataFrame:
    """``rank`` by a column with nulls last in either direction; a group may be of any size."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return running(rows, [group], [o, F.col(tie)], {"rank": ("count", None)})


def partial_month_cache(rows: DataFrame, geo: str, time: str, term: str, value: str) -> DataFrame:
    """geo, month, term, value: the latest value of each term in its month (by UTC), whatever batches brought it."""
    month = F.date_format(F.to_utc_timestamp(F.col(time), F.current_timezone()), "yyyy-MM").alias("month")
    return rows.groupBy(geo, month, term).agg(F.max_by(value, F.struct(time, value)).alias("value"))


# --- queries: events are documents


def _documents(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    data = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")))
    return e.select(F.col("event_id").alias("id"), data.alias("data"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def store_scan(spark, sf_dir):
    """The 200 first documents of one type by the text of their user, greatest text first."""
    return scan(_documents(spark, sf_dir), {"type": "click", "user": None}, "user", False, 200).select("id", "data")


def store_first_match(spark, sf_dir):
    """The oldest document of each type, by one aggregation."""
    d = _documents(spark, sf_dir).filter(field("type").isNotNull())
    return d.groupBy(field("type").alias("type")).agg(F.min(F.struct("created_at", "id")).alias("r")).select("r.id", "type")


def store_upsert(spark, sf_dir):
    """Customers' first orders as a collection, upserted with their last: the first created_at, the last's status."""
    o = read_table(spark, sf_dir, "orders")
    ends = lambda pick: o.groupBy(F.col("o_custkey").alias("id")).agg(pick("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), pick("o_orderdate", F.struct("o_orderdate", "o_orderkey")).alias("updated_at"))
    rows = lambda df: df.select("id", "status", F.col("updated_at").alias("created_at"), "updated_at")
    return upsert(rows(ends(F.min_by)), rows(ends(F.max_by)), ["id"])


def store_replace_per_client(spark, sf_dir):
    """Suppliers by nation, with those of nations that have customers of a segment in debt replaced by these."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("client"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = read_table(spark, sf_dir, "customer").filter((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < -900)).select(F.col("c_nationkey").alias("client"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return replace_for(s, c, "client")


def store_merge_patch(spark, sf_dir):
    """Suppliers with their balance and name patched from customers of the same number; null values leave a field as it is."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit(0).alias("updated_at"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return merge_patch(s, c, "id", F.lit(1))


def cache_purge(spark, sf_dir):
    """Events as cache rows (those with a value over 50 expire a week later): rows of each state on 20 January 2024 half a year on, by type."""
    now = F.to_timestamp(F.lit("2024-07-18 00:00:00"))
    e = read_table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("at"), F.when(F.col("value") > 50, F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return e.groupBy("event_type", purge_state(e, now).alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def cache_keys(spark, sf_dir):
    """The key of each event's request."""
    return read_table(spark, sf_dir, "events").select("event_id", cache_key(F.col("event_type"), F.col("user_id")).alias("key"))


def basket_fingerprints(spark, sf_dir):
    """The fingerprint of each customer's orders with their status as version."""
    o = read_table(spark, sf_dir, "orders")
    return fingerprint(o, "o_custkey", F.col("o_orderkey"), F.col("o_orderstatus"))


def keyword_pool(spark, sf_dir):
    """Part names as keywords with the highest size as volume, flagged."""
    return dedupe_pool(read_table(spark, sf_dir, "part"), "p_name", "p_size")


def keyword_two_bands(spark, sf_dir):
    """Parts of a brand: names of three words first, each band by size."""
    p = read_table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.size(F.split("p_name", " ")).alias("words"))
    return two_band_rank(p, F.col("words") >= 3, [F.desc("p_size"), F.col("p_partkey")], "p_brand")


def nulls_last(spark, sf_dir):
    """Customers of a nation by balance, greatest first, debts counting as missing."""
    c = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return nulls_last_rank(c, "c_nationkey", "balance", False, "c_custkey")


def month_cache(spark, sf_dir):
    """The last order's price of each customer, month and priority."""
    return partial_month_cache(read_table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")


def typed_keyword_scan(spark, sf_dir):
    """The hundred dearest parts of a brand or with a type like a word, and with no excluded size."""
    p = read_table(spark, sf_dir, "part")
    hit = (F.col("p_brand") == "Brand#12") | F.col("p_type").ilike("%steel%")
    return p.filter(hit & (F.col("p_size") != 7)).orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey", "p_retailprice")


def client_rank(spark, sf_dir):
    """Each supplier's rank by balance within its nation, with the leader and the median."""
    s = read_table(spark, sf_dir, "supplier")
    w = Window.partitionBy("s_nationkey")
    out = s.select("s_nationkey", "s_suppkey", F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("rank"), F.first("s_suppkey").over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("leader"))
    middle = s.groupBy("s_nationkey").agg(half_up(F.median(F.col("s_acctbal")), 1).alias("median"))
    return out.join(middle, "s_nationkey")


QUERIES = {f.__name__: f for f in (store_scan, store_first_match, store_upsert, store_replace_per_client, store_merge_patch, cache_purge, cache_keys, basket_fingerprints, keyword_pool, keyword_two_bands, nulls_last, month_cache, typed_keyword_scan, client_rank)}

ORACLE_SQL = {
    "store_scan": """SELECT event_id AS id, '{"user":' || user_id || ',"type":"' || event_type || '"}' AS data FROM events WHERE event_type = 'click' ORDER BY CAST(user_id AS VARCHAR) DESC, event_id LIMIT 200""",
    "store_first_match": "SELECT arg_min(event_id, (ts, event_id)) AS id, event_type AS type FROM events GROUP BY event_type",
    "store_upsert": """SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at FROM orders GROUP BY 1""",
    "store_replace_per_client": """WITH n AS (SELECT c_nationkey AS client, c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < -900)
      SELECT s_nationkey AS client, s_suppkey AS id, s_acctbal AS balance FROM supplier WHERE s_nationkey NOT IN (SELECT client FROM n) UNION ALL SELECT * FROM n""",
    "store_merge_patch": """SELECT s_suppkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE s_name END AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE s_acctbal END AS balance, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS updated_at
      FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey""",
    "cache_purge": """SELECT event_type, CASE WHEN value > 50 THEN CASE WHEN ts + INTERVAL 7 DAYS < TIMESTAMP '2024-07-18' THEN 'expired' ELSE 'live' END WHEN ts < TIMESTAMP '2024-07-18' - INTERVAL 180 DAYS THEN 'aged' ELSE 'live' END AS state, count(*) AS rows FROM events GROUP BY ALL""",
    "cache_keys": "SELECT event_id, sha1(event_type || '|' || user_id) AS key FROM events",
    "basket_fingerprints": "SELECT o_custkey, substring(sha1(string_agg(DISTINCT o_orderkey || '@' || o_orderstatus, ',' ORDER BY o_orderkey || '@' || o_orderstatus)), 1, 10) AS fingerprint FROM orders GROUP BY 1",
    "keyword_pool": r"SELECT lower(trim(p_name)) AS keyword, max(p_size) AS volume, max(p_size) < 10 AS low, regexp_matches(lower(trim(p_name)), '\b(near|in)\b') AS local FROM part GROUP BY 1",
    "keyword_two_bands": "SELECT p_brand, p_partkey, p_size, len(string_split(p_name, ' ')) AS words, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN len(string_split(p_name, ' ')) >= 3 THEN 0 ELSE 1 END, p_size DESC, p_partkey) AS rank FROM part",
    "nulls_last": "WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer) SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY balance DESC NULLS LAST, c_custkey) AS rank FROM c",
    "month_cache": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS value FROM orders GROUP BY ALL",
    "typed_keyword_scan": "SELECT p_partkey, p_retailprice FROM part WHERE (p_brand = 'Brand#12' OR p_type ILIKE '%steel%') AND p_size <> 7 ORDER BY p_retailprice DESC, p_partkey LIMIT 100",
    "client_rank": """SELECT s_nationkey, s_suppkey, row_number() OVER w AS rank, first_value(s_suppkey) OVER w AS leader, floor(median(s_acctbal) OVER (PARTITION BY s_nationkey) * 10 + 0.5) / 10 AS median FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""",
}
