"""Columns that are computed once, and rows that are spread before heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame) -> DataFrame:
    """The rows, with every column as it is here.

    The optimizer puts a column's expression in the place where it is used once, and so into the
    lambda of a higher-order function, where it is computed for every element. Nothing is put
    across this generator of one element.
    """
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("_row")).select("_row.*")


EVERY = 1000  # rows that one task has of heavy work


def spread(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, and in one for every EVERY rows, where they have fewer (files of
    many rows, however few); else as they are. So tasks become more with the input, not longer."""
    ways = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // EVERY))
    return rows.repartition(ways) if rows.rdd.getNumPartitions() < ways else rows
