"""Store semantics: latest versions, expiry, history rings, budgets, as-of lookups, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.running import running
from ..runtime import read_table


def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The row of the greatest version of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return best.select(*keys, "_r.*")


def ring(rows: DataFrame, key: str, order: list[Column], keep: int = 12) -> DataFrame:
    """The last ``keep`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def budget_prefix(rows: DataFrame, cost: str, order: list[Column], cap: int, by: list[str]) -> DataFrame:
    """Running cost within ``by``, of groups of any size; within_budget while it stays at most ``cap``."""
    return running(rows, by, order, {"running": ("sum", F.col(cost))}).withColumn("within_budget", F.col("running") <= cap)


def asof_backward(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """For each left row the last right value of its key at or before its time: one shuffle of the union
    into ranges of key and time, and a running last value; no pair of rows is formed, and no key is one task."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True
    )
    told = running(both, [key], [F.col(time), F.col("_side")], {"asof_value": ("last", F.col("_value"))})
    return told.filter("_side = 1").drop("_side", "_value")


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def latest_version(spark, sf_dir):
    """The newest event of each user and type."""
    return latest(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


def history_ring(spark, sf_dir):
    return ring(_events(spark, sf_dir).select("user_id", "event_id"), "user_id", [F.desc("event_id")], 12)


def ttl_live(spark, sf_dir):
    """Cache rows (a week's life) that are alive on 20 January, per type; expiry at that instant is dead."""
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    e = _events(spark, sf_dir).filter(F.col("ts") <= now)
    live = F.col("ts") + F.expr("INTERVAL 7 DAYS") > now
    return e.groupBy("event_type").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("purged"))


def budget_cutoff(spark, sf_dir):
    """Events of each user in order while their running cost (whole value) stays at most 500."""
    e = _events(spark, sf_dir).select("user_id", "event_id", F.floor(F.abs("value")).cast("long").alias("cost"))
    return budget_prefix(e, "cost", [F.col("event_id")], 500, ["user_id"]).groupBy("user_id").agg(F.count_if("within_budget").alias("kept"), F.count_if(~F.col("within_budget")).alias("skipped"))


def asof_lookup(spark, sf_dir):
    """For each purchase-like event (type first by name) the last value of another type at or before it, per user."""
    e = _events(spark, sf_dir)
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = e.filter(F.col("event_type") == kinds[0]).select("user_id", "ts", "event_id")
    right = e.filter(F.col("event_type") == kinds[-1]).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return asof_backward(left, right, "user_id", "ts", "last_id").select("user_id", "event_id", F.col("asof_value").alias("last_id"))


def daily_ledger(spark, sf_dir):
    """Runs, units and distinct users of each UTC day and type."""
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("user_id").alias("users"), half_up(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 2).alias("units"))


def monitor_issues(spark, sf_dir):
    """Users' event counts by a JSON property's parity, as issue totals."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(k % 2 == 0).alias("issues"), F.count_if(k.isNull()).alias("errors"))


QUERIES = {f.__name__: f for f in (latest_version, history_ring, ttl_live, budget_cutoff, asof_lookup, daily_ledger, monitor_issues)}

ORACLE_SQL = {
    "latest_version": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "history_ring": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 12",
    "ttl_live": """SELECT event_type, count(CASE WHEN ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20' THEN 1 END) AS live, count(CASE WHEN NOT ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20' THEN 1 END) AS purged
      FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY event_type""",
    "budget_cutoff": """WITH r AS (SELECT user_id, sum(CAST(floor(abs(value)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)
      SELECT user_id, count(CASE WHEN running <= 500 THEN 1 END) AS kept, count(CASE WHEN NOT running <= 500 THEN 1 END) AS skipped FROM r GROUP BY user_id""",
    "asof_lookup": """WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), l AS (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM k)),
      r AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = (SELECT max(event_type) FROM k) GROUP BY ALL)
      SELECT l.user_id, l.event_id, r.last_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "daily_ledger": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS runs, count(DISTINCT user_id) AS users, floor(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) * 100 + 0.5) / 100 AS units FROM events GROUP BY ALL""",
    "monitor_issues": """SELECT event_type, count(*) AS total, count(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 1 END) AS issues, count(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 1 END) AS errors FROM events GROUP BY event_type""",
}
