"""Ranks, running sums and last values within groups of any size.

A window over a whole group puts the group into one task. Here rows are dealt to ranges of (group, order),
so that a large group is many ranges; each range is worked on by itself, and what the ranges before it in the group
add up to, a row for each range and group, is joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import mark, materialize, sweep


def running(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``rows`` with a column for each of ``values``: how many rows of the group have come (count), their sum (sum),
    their last value that isn't null (last), each with the row itself, in ``order``.

    Null groups are groups; rows that are equal in group and order come in any order, so ``order`` should tell all apart.
    """
    since = mark(rows.sparkSession)
    keys = [f"_g{i}" for i in range(len(by))]
    d = rows.select("*", *[F.to_json(F.struct(F.col(c).alias("v"))).alias(k) for c, k in zip(by, keys)], *[(v if v is not None else F.lit(1)).alias(f"_v{i}") for i, (_, v) in enumerate(values.values())])
    ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(d.repartitionByRange(ways, *keys, *order).withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole, carried, own = [], [], []
    for i, (name, (kind, _)) in enumerate(values.items()):
        v, c = F.col(f"_v{i}"), F.col(f"_c{i}")
        if kind == "last":
            whole.append(F.max_by(v, F.when(v.isNotNull(), F.col("_at"))).alias(f"_c{i}"))
            carried.append(F.last(c, ignorenulls=True).over(before).alias(f"_b{i}"))
            own.append(F.coalesce(F.col(f"_r{i}"), F.col(f"_b{i}")).alias(name))
        else:
            whole.append((F.count(F.lit(1)) if kind == "count" else F.sum(v)).alias(f"_c{i}"))
            carried.append(F.sum(c).over(before).alias(f"_b{i}"))
            total = F.when(F.col(f"_r{i}").isNull() & F.col(f"_b{i}").isNull(), F.lit(None)).otherwise(F.coalesce(F.col(f"_r{i}"), F.lit(0)) + F.coalesce(F.col(f"_b{i}"), F.lit(0)))
            own.append(total.alias(name))
    of = {"count": lambda v: F.count(F.lit(1)), "sum": F.sum, "last": lambda v: F.last(v, ignorenulls=True)}
    parts = [of[kind](f"_v{i}").over(here).alias(f"_r{i}") for i, (kind, _) in enumerate(values.values())]
    counted = spread.select("*", F.count(F.lit(1)).over(here).alias("_at"), *parts)
    stats = counted.groupBy("_range", *keys).agg(*whole).select("_range", *keys, *carried)
    joined = counted.join(stats, ["_range", *keys])
    return sweep(joined.select(*[F.col(f"`{c}`") for c in rows.columns], *own), since)
