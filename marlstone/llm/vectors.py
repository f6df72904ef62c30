"""Vectors as packed integers, shared by the search and the compression of vectors.

A component x becomes floor(scale * x), x as a double; beyond a 64-bit integer
the nearest one. Vectors that are null, or hold a null or non-finite component,
take no part. Shorter vectors count as filled up with zeros to the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """What one pass over the vectors finds: rows, length, largest magnitude, largest squared norm."""

    rows: int
    length: int
    magnitude: int
    norm2: float

    @property
    def dtype(self) -> str:
        """The narrowest integers that hold every component."""
        return next(t for t in ("<i1", "<i2", "<i4", "<i8") if t == "<i8" or self.magnitude <= np.iinfo(t).max)

    def unpacked(self, column: pa.Array) -> np.ndarray:
        """A matrix from an Arrow column of packed vectors."""
        return np.frombuffer(b"".join(column.to_pylist()), self.dtype).reshape(len(column), self.length)


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int, *more: str) -> DataFrame:
    """row (its place), id, vec (integers) of the vectors that take part, and ``more`` columns as m0, m1..."""
    v = F.col(vec_col).cast("array<double>")
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("vec"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(more)])
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return source.filter(F.col("vec").isNotNull() & ~odd).withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale)))))


def shape(rows: DataFrame) -> Shape:
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # the largest magnitude as a double, so that the least 64-bit integer has one
    most = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("l"), F.max(most).alias("m"), F.max(square).alias("s")).first()
    return Shape(r["n"], r["l"] or 0, int(r["m"] or 0), r["s"] or 0.0)


def packed(rows: DataFrame, of: Shape) -> DataFrame:
    """The rows with vec as bytes of little-endian integers, all of one length."""
    names = rows.columns
    at = names.index("vec")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            sizes = np.asarray(column.value_lengths())
            x = np.zeros((batch.num_rows, of.length), of.dtype)
            x[np.arange(of.length)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()) if i == at else batch.column(i) for i in range(len(names))], names)

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scan, kinds)
