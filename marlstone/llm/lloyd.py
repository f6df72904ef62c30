"""Product codes of vectors by a filtering Lloyd iteration over kd-trees.

Vectors are cut into PARTS equal consecutive parts, filled up with zeros to a
multiple of PARTS components. Every partition builds, for each chunk of up to
CHUNK vectors and each part, a kd-tree with the bounding box, the number and
the sum of every node's points, and writes them once. A round sends the codebooks (PARTS
times ENTRIES entries) down the trees: at a node the entry nearest to the box's middle
rules out every entry that no point of the box can be nearer to, or as near
with a lower index; where one entry is left the whole subtree goes to it, by
its cached number and sum. At the leaves the entries left are compared point by point. Only sums for
each entry come back. All of it is integer arithmetic, so every tie is exact.

Codebooks start as the parts of the vectors with the ENTRIES smallest ids (null
ids last, equal ids by vector); fewer vectors, fewer entries. Repeated rows are rows
of their own; null labels are one label. No rows, no result. Other columns are
not read. An error beyond a 64-bit integer counts as the largest one.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, read_table, release
from .vectors import Shape, integers, packed, shape

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CHUNK, LEAF = 8192, 16
LEVEL = ("low", "high", "number", "total")
MOST = 2**63 - 1


class Trees:
    """Balanced kd-trees over the parts of a chunk's vectors, one a part, level by level.

    The chunk is filled up to a power of two with copies of its first vector
    that count nothing. ``points`` (part, place, component) are in the order of
    the leaves; ``order`` gives each one's vector.
    """

    def __init__(self, vecs: np.ndarray):
        n, length = vecs.shape
        self.n, self.depth = n, max(0, (max(n, 1) - 1).bit_length() - (LEAF - 1).bit_length())
        width = LEAF << self.depth
        order = np.concatenate([np.arange(n), np.zeros(width - n, np.int64)])
        real = np.arange(width) < n
        self.points = np.ascontiguousarray(vecs[order].reshape(width, PARTS, length // PARTS).transpose(1, 0, 2))
        self.order, self.real = np.tile(order, (PARTS, 1)), np.tile(real, (PARTS, 1))
        self.levels: list[tuple[np.ndarray, ...]] = []
        for level in range(self.depth + 1):
            shape_ = (PARTS, 1 << level, width >> level)
            p = self.points.reshape(*shape_, -1)
            low, high = p.min(2), p.max(2)
            if level < self.depth and p.shape[-1]:
                wide = (high - low).argmax(-1)[:, :, None, None]
                by = np.take_along_axis(p, wide, 3)[..., 0].argsort(2, kind="stable")
                self.points = np.take_along_axis(p, by[..., None], 2).reshape(self.points.shape)
                self.order = np.take_along_axis(self.order.reshape(shape_), by, 2).reshape(PARTS, width)
                self.real = np.take_along_axis(self.real.reshape(shape_), by, 2).reshape(PARTS, width)
            self.levels.append((low, high))
        real = self.real.reshape(PARTS, 1 << self.depth, LEAF)
        number = real.sum(2).astype(np.int64)
        total = (self.points.reshape(*real.shape, -1) * real[..., None]).sum(2)
        for level in range(self.depth, -1, -1):
            self.levels[level] += (number, total)
            if level:
                number, total = (v.reshape(PARTS, 1 << (level - 1), 2, *v.shape[2:]).sum(2) for v in (number, total))

    def stored(self, dtype: str) -> bytes:
        """All arrays, points and boxes as ``dtype``."""
        out = io.BytesIO()
        levels = {f"{name}{k}": v.astype(dtype) if name in ("low", "high") else v for k, level in enumerate(self.levels) for name, v in zip(LEVEL, level)}
        np.savez(out, n=self.n, points=self.points.astype(dtype), order=self.order.astype(np.uint16), real=self.real, **levels)
        return out.getvalue()

    @classmethod
    def read(cls, stored: bytes, number: type) -> Trees:
        """Trees that ``stored`` gave; distances will be of this type of integers."""
        self, f = cls.__new__(cls), np.load(io.BytesIO(stored), allow_pickle=number is object)
        as_number = lambda v: v.astype(np.int64).astype(number)
        self.n, self.points, self.order, self.real = int(f["n"]), as_number(f["points"]), f["order"], f["real"]
        self.depth = (self.points.shape[1] // LEAF).bit_length() - 1
        self.levels = [(as_number(f[f"low{k}"]), as_number(f[f"high{k}"]), f[f"number{k}"], f[f"total{k}"]) for k in range(self.depth + 1)]
        return self

    def assigned(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Whole subtrees (level, part, node, entry), then leaves' points (None, part, place, entry)."""
        entries = books.shape[1]
        part, node = np.arange(PARTS), np.zeros(PARTS, np.int64)
        open_ = np.ones((PARTS, entries), bool)
        norm = (books * books).sum(2)
        index = np.arange(entries)
        for level, (low, high, number, _) in enumerate(self.levels):
            counted = number[part, node] > 0
            part, node, open_ = part[counted], node[counted], open_[counted]
            lo, hi = low[part, node], high[part, node]
            z = books[part]  # node, entry, component
            # four times the squared distance of twice the middle, without what is the same for all entries
            middle = 4 * norm[part] - 4 * ((lo + hi)[:, None, :] * z).sum(2)
            middle = np.where(open_, middle, middle.max() + 1 if middle.size else 0)
            best = middle.argmin(1)
            to_best = z - z[np.arange(len(z)), best][:, None, :]
            # least of |z - p|^2 - |best - p|^2 over the box: the corner farthest towards z
            gap = norm[part] - norm[part, best][:, None] - 2 * np.maximum(to_best * lo[:, None, :], to_best * hi[:, None, :]).sum(2)
            open_ &= (gap < 0) | ((gap == 0) & (index[None, :] <= best[:, None]))
            open_[np.arange(len(z)), best] = True
            one = open_.sum(1) == 1
            yield level, part[one], node[one], best[one]
            part, node, open_ = part[~one], node[~one], open_[~one]
            if level < self.depth:
                part, open_ = np.repeat(part, 2), np.repeat(open_, 2, axis=0)
                node = np.stack([2 * node, 2 * node + 1], 1).reshape(-1)
        for k in np.unique(part):
            here = np.flatnonzero(part == k)
            at, entry = np.nonzero(open_[here])  # leaf and entry left, by leaf
            place = node[here, None] * LEAF + np.arange(LEAF)
            distance = ((self.points[k, place[at]] - books[k, entry][:, None, :]) ** 2).sum(2)
            first = np.searchsorted(at, np.arange(len(here)))
            least = np.minimum.reduceat(distance, first, axis=0)
            lowest = np.minimum.reduceat(np.where(distance == least[at], entry[:, None], entries), first, axis=0)
            yield None, np.full(place.size, k), place.reshape(-1), lowest.reshape(-1)

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each part and entry."""
        number, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, books.dtype)
        for level, part, at, entry in self.assigned(books):
            if level is None:
                real = self.real[part, at]
                part, at, entry = part[real], at[real], entry[real]
                np.add.at(number, (part, entry), 1)
                np.add.at(total, (part, entry), self.points[part, at])
            else:
                _, _, n, t = self.levels[level]
                np.add.at(number, (part, entry), n[part, at])
                np.add.at(total, (part, entry), t[part, at])
        return number, total

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's entries and squared distance, by vector."""
        code = np.zeros((PARTS, self.points.shape[1]), np.uint8)
        for level, part, at, entry in self.assigned(books):
            if level is None:
                code[part, at] = entry
            else:
                size = self.points.shape[1] >> level
                code.reshape(PARTS, -1, size)[part, at] = entry[:, None]
        off = ((self.points - books[np.arange(PARTS)[:, None], code]) ** 2).sum(2)
        out, error = np.zeros((self.n, PARTS), np.uint8), np.zeros(self.n, self.points.dtype)
        for p in range(PARTS):
            real = self.real[p]
            out[self.order[p][real], p] = code[p][real]
            error[self.order[p][real]] += off[p][real]
        return out, error


def wide(of: Shape) -> type:
    """Integers in which distances, and their comparisons over a box, are exact."""
    return np.int64 if of.magnitude < 2**26 and of.length < 2**9 else object


def filled(of: Shape) -> Shape:
    """With a length that PARTS divides."""
    return replace(of, length=-(-of.length // PARTS) * PARTS)


def trees(rows: DataFrame, of: Shape) -> DataFrame:
    """Chunks of each partition: their ids and labels, and the kd-trees of their vectors."""
    label = rows.schema["m0"].dataType.simpleString()

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        built = Trees(of.unpacked(t.column("vec").chunk(0)).astype(np.int64).astype(wide(of)))
        lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).chunk(0)) for c in ("id", "m0")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([built.stored(of.dtype)], pa.binary())], ["id", "label", "tree"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(CHUNK - n, batch.num_rows)
                held, n, batch = [*held, batch.slice(0, take)], n + take, batch.slice(take)
                if n == CHUNK:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)

    return rows.select("id", "m0", "vec").mapInArrow(scan, f"id array<bigint>, label array<{label}>, tree binary")


def first_books(rows: DataFrame, of: Shape) -> np.ndarray:
    """The parts of the ENTRIES vectors of the smallest ids: part, entry, component."""
    least = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(ENTRIES).select("vec").collect()
    x = np.zeros((len(least), of.length), np.int64)
    for i, r in enumerate(least):
        x[i, : len(r[0])] = r[0]
    return np.ascontiguousarray(x.astype(wide(of)).reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def moved(built: DataFrame, books: np.ndarray, of: Shape) -> np.ndarray:
    """The codebooks after a round: every used entry at the floor of its points' mean.

    A task gives a sum for each entry and component, at most PARTS * ENTRIES * components rows; so many reach the driver.
    """
    number = wide(of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, number)
        for batch in batches:
            for stored in batch.column(0):
                n, t = Trees.read(stored.as_py(), number).sums(books)
                count, total = count + n, total + t
        part, entry, component = np.nonzero(np.broadcast_to(count[..., None] > 0, total.shape))
        sums = [Decimal(int(v)) for v in total[part, entry, component]]
        yield pa.RecordBatch.from_arrays([*[pa.array(v.astype(np.int32)) for v in (part, entry, component)], pa.array(count[part, entry]), pa.array(sums, pa.decimal128(38))], ["part", "entry", "component", "n", "total"])

    sums = built.select("tree").mapInArrow(scan, "part int, entry int, component int, n bigint, total decimal(38,0)")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["part"], r["entry"], r["component"]] = int(r["total"]) // r["n"]
    return out


def coded(built: DataFrame, books: np.ndarray, of: Shape) -> DataFrame:
    """id, label, code, error of every vector."""
    label = built.schema["label"].dataType.elementType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                code, error = Trees.read(batch.column("tree")[k].as_py(), wide(of)).codes(books)
                ids, labels = batch.column("id")[k].values, batch.column("label")[k].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code]), pa.array([min(int(e), MOST) for e in error], pa.int64())], ["id", "label", "code", "error"])

    return built.mapInArrow(scan, f"id bigint, label {label}, code string, error bigint")


def product_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, rounds: int = ROUNDS) -> DataFrame:
    """id, label, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    whole = integers(df, id_col, vec_col, scale, label_col)
    of = filled(shape(whole))
    label = whole.schema["m0"].dataType.simpleString()
    if not of.rows:
        return df.sparkSession.createDataFrame([], f"id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    built = materialize(trees(packed(whole, of), of))
    books = first_books(whole, of)
    for _ in range(rounds):
        books = moved(built, books, of)
    done = materialize(coded(built, books, of))
    release(built)
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = done.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    joined = done.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every embedding."""
    found = product_codes(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
