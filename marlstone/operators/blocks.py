"""Products of all pairs of sparse vectors within groups, block by block, without a list of pairs.

Vectors are rows (g, id, name, keys, w and what a judge needs more): a group, an order, what the result calls it,
64-bit keys and their weights (without w: 1 each). A group's vectors are dealt into blocks by their ids, and every two blocks
meet in one cell, a task's group of bounded size; a vector is sent once for each block. A cell
makes the products of some rows of its left block with all of its right one at a time, as a dense table, and a
judge keeps what is asked for: pairs, the best of each vector, or sums. Work grows with the products, results need not.
The cells of a turn get each vector once, so that a few turns at a time bound what is sent, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, FEW, LEAST = 8192, 12, 256  # vectors of a block at most; blocks of a group at least, unless they have fewer vectors than LEAST
ROOM = 1 << 21  # products that are made at a time
NEAR = 1 << 18  # where a few passes over them are all that is done: these stay in a core's cache


class Side:
    """A block's vectors in the order of their ids."""

    def __init__(self, table: pa.Table):
        self.table = t = table.take(np.argsort(table["id"].to_numpy(), kind="stable")).combine_chunks()
        self.ids, self.names = t["id"].to_numpy(), t["name"].combine_chunks()
        self.keys, self.starts = flat(t, "keys")
        self.w = flat(t, "w")[0] if "w" in t.column_names else np.ones(len(self.keys))
        self.rows = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))

    def of(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()


def flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's begin."""
    lists = t[name].combine_chunks()
    starts = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]], starts - starts[0]


def products(a: Side, b: Side, room: int = ROOM) -> Iterator[tuple[int, np.ndarray]]:
    """First row and products of rows of ``a`` with all of ``b``, ``room`` of them at a time, one row at least."""
    order = np.argsort(b.keys, kind="stable")
    keys, cols, wb = b.keys[order], b.rows[order], b.w[order]
    at = np.searchsorted(keys, a.keys, "left")
    n = np.searchsorted(keys, a.keys, "right") - at
    made = np.concatenate([[0], np.cumsum(n)])[a.starts]  # before each row
    wide, first = len(b.ids), 0
    while first < len(a.ids):
        last = min(len(a.ids), first + max(1, room // wide), int(np.searchsorted(made, made[first] + room // 2, "right")) - 1)
        last = max(last, first + 1)
        part = slice(a.starts[first], a.starts[last])
        count = n[part]
        pos = np.repeat(at[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cell = np.repeat((a.rows[part] - first) * wide, count) + cols[pos]
        yield first, np.bincount(cell, np.repeat(a.w[part], count) * wb[pos], (last - first) * wide).reshape(last - first, wide)
        first = last


Judge = Callable[[Side, Side, bool], dict]


def _sizes(vectors: DataFrame, most: int, few: int) -> DataFrame:
    """g, _ways: blocks of each group."""
    size = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    ways = F.greatest(F.ceil(F.col("_n") / most), F.least(F.lit(few), F.ceil(F.col("_n") / LEAST))).cast("int")
    return size.select("g", ways.alias("_ways"))


def cells(n: int, most: int = MOST, few: int = FEW) -> int:
    """Cells in which a group of n vectors meets; 1 for none."""
    ways = max(-(-n // most), min(few, -(-n // LEAST)), 1)
    return ways * (ways + 1) // 2


def turns(vectors: DataFrame, at_once: int, most: int = MOST, few: int = FEW) -> list[tuple[int, int]]:
    """Parts of the work for ``met``, each of which sends a vector ``at_once`` times at most: turn t has the cells of blocks
    a and b with a + b = t, modulo the group's blocks, so each vector is in one of its cells."""
    last = _sizes(vectors, most, few).agg(F.max("_ways")).first()[0] or 0
    return [(t, min(t + at_once, last)) for t in range(0, last, at_once)]


def met(vectors: DataFrame, judge: Judge, schema: str, most: int = MOST, few: int = FEW, only: tuple[int, int] | None = None) -> DataFrame:
    """What ``judge`` keeps of every cell's two blocks (the same one twice, if its third argument says so), as columns by name;
    ``only`` of the ``turns`` from the first number to before the second."""
    size = _sizes(vectors, most, few)
    share = F.col("_ways") if only is None else F.greatest(F.lit(0), F.least("_ways", F.lit(only[1])) - only[0])
    n_cells = size.agg(F.sum(F.ceil((F.col("_ways") + 1) * share / 2))).first()[0] or 1
    dealt = vectors.join(size, "g").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_ways")).cast("int"))
    if only is None:
        dealt = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1)))
    else:
        turn = F.filter(F.sequence(F.lit(only[0]), F.lit(only[1] - 1)), lambda t: t < F.col("_ways"))
        dealt = dealt.withColumn("_x", F.explode(F.transform(turn, lambda t: F.pmod(t - F.col("_b"), F.col("_ways")))))
    dealt = dealt.select(*vectors.columns, F.least("_b", "_x").alias("_lo"), F.greatest("_b", "_x").alias("_hi"), (F.col("_b") <= F.col("_x")).alias("_left"))
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def cell(table: pa.Table) -> pa.Table:
        same = table["_lo"][0].as_py() == table["_hi"][0].as_py()
        left = table.filter(table["_left"])
        right = left if same else table.filter(pc.invert(table["_left"]))
        if not left.num_rows or not right.num_rows:
            found = None
        else:
            a = Side(left)
            found = judge(a, a if same else Side(right), same)
        return pa.table({c: found[c] for c in names}) if found else kept.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kept = to_arrow_schema(_parse_datatype_string(schema))
    return dealt.repartition(int(min(2 * n_cells, 20000)), "g", "_lo", "_hi").groupBy("g", "_lo", "_hi").applyInArrow(cell, schema)


def pairs_from(least: float) -> Judge:
    """i < j, v of products from ``least`` on (> 0); ids are the names."""

    def judge(a: Side, b: Side, same: bool) -> dict:
        out = []
        for first, d in products(a, b):
            r, c = np.nonzero(d >= least)
            i, j, v = a.ids[first + r], b.ids[c], d[r, c]
            out.append([x[i < j] if same else x for x in (np.minimum(i, j), np.maximum(i, j), v)])
        return {c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("i", "j", "v"))}

    return judge


def best_by(value: Callable[[np.ndarray, Side, Side, slice], np.ndarray]) -> Judge:
    """x (a name), v, y (an id): of each vector of the cell the one of the highest value in the other block, the smallest id at a tie;
    ``value`` gives -inf to what doesn't count."""

    def judge(a: Side, b: Side, same: bool) -> dict:
        va, ya = np.full(len(a.ids), -np.inf), np.zeros(len(a.ids), np.int64)
        vb, yb = np.full(len(b.ids), -np.inf), np.zeros(len(b.ids), np.int64)
        for first, d in products(a, b, NEAR):
            rows = slice(first, first + len(d))
            v = value(d, a, b, rows)
            here = np.arange(len(d))
            if same:
                v[here, first + here] = -np.inf
            k = v.argmax(1)
            va[rows], ya[rows] = v[here, k], b.ids[k]
            if not same:
                k = v.argmax(0)
                m = v[k, np.arange(len(vb))]
                more = m > vb
                vb[more], yb[more] = m[more], a.ids[first + k[more]]
        sides = [(a, va, ya)] if same else [(a, va, ya), (b, vb, yb)]
        take = [(s.names.take(pa.array(np.nonzero(v > -np.inf)[0])), v[v > -np.inf], y[v > -np.inf]) for s, v, y in sides]
        return {"x": pa.chunked_array([t[0] for t in take]), "v": np.concatenate([t[1] for t in take]), "y": np.concatenate([t[2] for t in take])}

    return judge


def sums_by(value: Callable[[np.ndarray], np.ndarray], itself: float) -> Judge:
    """x (an id), c, s: sums of whole values over the vectors of each cluster; a vector's own value is ``itself``.
    Vectors have lists: clusters, and how often they are there (counts)."""

    def table(s: Side) -> tuple[np.ndarray, np.ndarray]:
        c, starts = flat(s.table, "clusters")
        known, at = np.unique(c, return_inverse=True)
        m = np.zeros((len(s.ids), len(known)))
        np.add.at(m, (np.repeat(np.arange(len(s.ids)), np.diff(starts)), at), flat(s.table, "counts")[0])
        return known, m

    def judge(a: Side, b: Side, same: bool) -> dict:
        (ca, ma), (cb, mb) = table(a), table(b)
        sa, sb = np.zeros((len(a.ids), len(cb))), np.zeros((len(b.ids), len(ca)))
        for first, d in products(a, b):
            v = value(d)
            here = np.arange(len(d))
            if same:
                v[here, first + here] = itself
            sa[first : first + len(d)] = v @ mb
            if not same:
                sb += v.T @ ma[first : first + len(d)]
        out = []
        for s, c, t in [(a, cb, sa)] if same else [(a, cb, sa), (b, ca, sb)]:
            r, k = np.nonzero(t)
            out.append((s.ids[r], c[k], np.rint(t[r, k]).astype(np.int64)))
        return {n: np.concatenate([o[k] for o in out]) for k, n in enumerate(("x", "c", "s"))}

    return judge


def unit_vectors(weights: DataFrame, id_col: str = "id") -> DataFrame:
    """g, id, name, keys, w of (id, term, weight): vectors of length 1, in one group; those without weights are left out."""
    kept = weights.filter("weight <> 0").groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("k"), F.col("weight").cast("double").alias("w"))).alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    d = kept.withColumn("_norm", norm)
    return d.select(F.lit("").alias("g"), "id", F.col("id").alias("name"), F.transform("t", lambda x: x["k"]).alias("keys"), F.transform("t", lambda x: x["w"] / F.col("_norm")).alias("w"))
