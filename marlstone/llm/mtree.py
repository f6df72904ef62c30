"""Exact top-k inner products by an M-tree over all vectors.

With M the largest norm of all vectors, a vector x gets one more coordinate
w = sqrt(M^2 - |x|^2) and a query q the coordinate 0; then the squared distance
of q and x is |q|^2 + M^2 - 2 q.x, so that the highest inner products are the
nearest neighbours in a metric space, as an M-tree needs.

The tree's root has PIVOTS routing objects, spread out over a sample of SAMPLE
rows; every row goes to its nearest one. Below it the objects of a routing object are
dealt over shards, more of them where there are more, so that a third of all
rows around one point, or equal, is no larger task. A shard is one row of a
written table: an M-tree in pages of at most PAGE objects or entries, each entry with its
routing object, covering radius and distance to the parent's routing object.

Queries first search their own shard; the k-th score there is a bound. With it
the root sends them on, in blocks, only to the shards that can hold better ones.
A shard's pages are searched best first for a block at once: a page is taken
up for those queries whose bound it may still beat, entries and objects that
the stored parent distances rule out are not compared. Scores are exact integers;
distances only rule out, with a slack over their rounding.

Repeated rows, ids and vectors are rows of their own; a query leaves out only
its own row. A null id is no query, may be found, and loses ties. A query that
has no other row has no result; no rows, no results. Other columns are not read.
A score beyond a 64-bit integer counts as the nearest one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, read_table, release
from .vectors import Shape, integers, packed, shape

PAGE, FAN, SPREAD = 64, 16, 256  # objects of a leaf, entries of an inner page, objects among which its routing objects are looked for
PIVOTS, SAMPLE = 64, 1024
PARTS, LEAST, MOST = 64, 512, 262_144  # shards aimed at where rows are few, and the least and most rows aimed at in one
BLOCK = 4096  # queries sent together
SLACK = 1e-6  # of the largest distance there can be; far over what rounding does
NONE = -(2**63)


class Metric:
    """Distances of packed vectors with their further coordinate; exact inner products."""

    def __init__(self, of: Shape):
        self.of, self.norm2 = of, of.norm2
        bound = of.magnitude**2 * max(of.length, 1)
        self.number = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object

    def ready(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64).astype(self.number) if self.number is object else x.astype(self.number)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = a @ b.T
        if self.number is object:
            s = np.array([[min(max(v, NONE + 1), 2**63 - 1) for v in row] for row in s.tolist()], np.int64).reshape(s.shape)
        return s.astype(np.int64)

    def squares(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)

    def lift(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2 - squares, 0.0))

    def objects(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances between objects."""
        x, y = x.astype(np.float64), y.astype(np.float64)
        a, b = self.squares(x), self.squares(y)
        d = a[:, None] + b[None, :] - 2 * (x @ y.T) + (self.lift(a)[:, None] - self.lift(b)[None, :]) ** 2
        return np.sqrt(np.maximum(d, 0.0))

    def from_score(self, squares: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances of queries with these squared norms to objects with these scores."""
        return np.sqrt(np.maximum(squares + self.norm2 - 2.0 * score.astype(np.float64), 0.0))


def spread_out(x: np.ndarray, most: int, metric: Metric) -> np.ndarray:
    """Places of up to ``most`` different vectors, each the farthest from those before it."""
    found, near = [0], metric.objects(x, x[:1])[:, 0]
    while len(found) < most and near.max() > SLACK * np.sqrt(max(metric.norm2, 1.0)):
        found.append(int(near.argmax()))
        near = np.minimum(near, metric.objects(x, x[found[-1:]])[:, 0])
    return np.array(found)


#: A page: its objects' range, routing object, covering radius, distance to the parent's routing object, entries' range.
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("radius", "<f8"), ("up", "<f8"), ("first", "<i4"), ("last", "<i4")])


class Tree:
    """An M-tree over the rows of a shard, which it reorders so that every page is a range."""

    def __init__(self, x: np.ndarray, metric: Metric, nodes: np.ndarray | None = None, up: np.ndarray | None = None):
        self.x, self.metric, self.nodes, self.up = x, metric, nodes, up
        self.order = np.arange(len(x))
        if nodes is None:
            self._grow()
        self.ready = metric.ready(self.x)

    def _grow(self) -> None:
        """Bulk loading: pages from the top, entries of a page side by side."""
        x, metric = self.x, self.metric
        self.up = np.zeros(len(x))
        pages, todo = [[0, len(x), 0, 0.0, 0.0, 0, 0]], [0]
        while todo:
            at = todo.pop()
            start, end, centre = pages[at][:3]
            own = self.order[start:end]
            d = metric.objects(x[own], x[centre : centre + 1])[:, 0]
            pages[at][3] = float(d.max())
            if end - start <= PAGE:
                self.up[own] = d
                continue
            routing = own[:: max(1, len(own) // SPREAD)]
            routing = routing[spread_out(x[routing], FAN, metric)]
            to = metric.objects(x[own], x[routing])
            nearest = to.argmin(1)
            if len(routing) == 1:  # all alike: any cut does
                step = -(-len(own) // FAN)
                nearest = np.arange(len(own)) // step
                routing = own[::step]
            order = np.argsort(nearest, kind="stable")
            self.order[start:end] = own[order]
            sizes = np.bincount(nearest, minlength=len(routing))
            pages[at][5] = len(pages)
            for k, r in enumerate(routing):
                if sizes[k]:
                    todo.append(len(pages))
                    pages.append([start, start + int(sizes[k]), int(r), 0.0, float(metric.objects(x[r : r + 1], x[centre : centre + 1])[0, 0]), 0, 0])
                    start += int(sizes[k])
            pages[at][6] = len(pages)
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.nodes = np.array([tuple(p) for p in pages], NODE)
        self.nodes["centre"] = place[self.nodes["centre"]]
        self.x, self.up = x[self.order], self.up[self.order]


class Best:
    """The k best rows of each query so far, and the score that a further one must reach."""

    def __init__(self, rows: np.ndarray, least: np.ndarray, k: int):
        n = len(rows)
        self.rows, self.least, self.k = rows, least.copy(), k
        self.score, self.at = np.full((n, k), NONE), np.full((n, k), -1)

    def offer(self, q: np.ndarray, at: np.ndarray, score: np.ndarray, rank: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the queries ``q`` with the shard's rows ``at``; ``rank`` puts the shard's rows in the order that decides ties."""
        score[rows[at][None, :] == self.rows[q][:, None]] = NONE
        hit = ((score >= self.least[q][:, None]) & (score > NONE)).any(1)
        if not hit.any():
            return
        q, score = q[hit], score[hit]
        scores = np.concatenate([self.score[q], score], 1)
        places = np.concatenate([self.at[q], np.broadcast_to(at, score.shape)], 1)
        top = np.lexsort((rank[places], ~scores), axis=-1)[:, : self.k]
        self.score[q], self.at[q] = np.take_along_axis(scores, top, 1), np.take_along_axis(places, top, 1)
        self.least[q] = np.maximum(self.least[q], self.score[q, self.k - 1])


def search(tree: Tree, queries: np.ndarray, best: Best, rank: np.ndarray, rows: np.ndarray) -> int:
    """Offer ``best`` every row of the tree that can be among a query's; returns how many pairs were compared."""
    metric, nodes = tree.metric, tree.nodes
    own, squares = metric.ready(queries), metric.squares(queries)
    slack = SLACK * np.sqrt(squares + metric.norm2)

    def reach(q: np.ndarray) -> np.ndarray:
        d = metric.from_score(squares[q], best.least[q])
        d[best.least[q] == NONE] = np.inf
        return d + slack[q]

    every = np.arange(len(queries))
    root = metric.from_score(squares, metric.products(own, tree.ready[nodes["centre"][:1]])[:, 0])
    heap: list[tuple[float, int, np.ndarray, np.ndarray]] = [(0.0, 0, every, root)]
    compared = len(every)
    while heap:
        _, at, q, d = heapq.heappop(heap)
        page = nodes[at]
        far = reach(q)
        open_ = d - page["radius"] <= far
        q, d, far = q[open_], d[open_], far[open_]
        if not len(q):
            continue
        leaf = page["first"] == page["last"]
        below = np.arange(page["start"], page["end"]) if leaf else np.arange(page["first"], page["last"])
        up, radius = (tree.up[below], 0.0) if leaf else (nodes["up"][below], nodes["radius"][below])
        may = np.abs(d[:, None] - up[None, :]) - radius <= far[:, None]
        some, column = may.any(1), may.any(0)
        q, may, below, far = q[some], may[some][:, column], below[column], far[some]
        if not len(q):
            continue
        compared += len(q) * len(below)
        score = metric.products(own[q], tree.ready[below if leaf else nodes["centre"][below]])
        if leaf:
            best.offer(q, below, score, rank, rows)
            continue
        to = metric.from_score(squares[q][:, None], score)
        nearest = np.maximum(to - nodes["radius"][below][None, :], 0.0)
        may &= nearest <= far[:, None]
        for j, child in enumerate(below.tolist()):
            goes = may[:, j]
            if goes.any():
                heapq.heappush(heap, (float(nearest[goes, j].min()), child, q[goes], to[goes, j]))
    return compared


def _ranks(ids: np.ndarray, none: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each row's place in the order of ids (null last), then rows; a further last place for none."""
    rank = np.empty(len(ids) + 1, np.int64)
    rank[np.lexsort((rows, ids, none))] = np.arange(len(ids))
    rank[-1] = len(ids)
    return rank


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.is_null())


def rooted(rows: DataFrame, of: Shape) -> tuple[np.ndarray, DataFrame]:
    """The root's routing objects, and the rows with their nearest one and its distance (pivot, up)."""
    metric = Metric(of)
    sample = of.unpacked(pa.array([bytes(r[0]) for r in rows.orderBy(F.xxhash64("row"), "row").select("vec").limit(SAMPLE).collect()], pa.binary()))
    pivots = sample[spread_out(sample, PIVOTS, metric)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = metric.objects(of.unpacked(batch.column("vec")), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], [*batch.schema.names, "pivot", "up"])

    return pivots, rows.mapInArrow(scan, "row bigint, id bigint, vec binary, asks boolean, pivot int, up double")


SHARD = "shard int, pivot int, rows binary, ids array<bigint>, vecs binary, nodes binary, up binary, asked binary, asked_ids array<bigint>, asked_vecs binary, least binary"


def shards(dealt: DataFrame, of: Shape, k: int) -> DataFrame:
    """A row for each shard: its tree, and its queries with their k-th score there."""
    metric = Metric(of)

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("row")
        column = lambda name: group.column(name).chunk(0)
        tree = Tree(of.unpacked(column("vec")), metric)
        group = group.take(pa.array(tree.order)).combine_chunks()
        rows = column("row").to_numpy()
        ids, none = _ids(column("id"))
        asks = np.flatnonzero(np.asarray(column("asks")))
        best = Best(rows[asks], np.full(len(asks), NONE), k)
        for a in range(0, len(asks), BLOCK):
            part = Best(rows[asks[a : a + BLOCK]], best.least[a : a + BLOCK], k)
            search(tree, tree.x[asks[a : a + BLOCK]], part, _ranks(ids, none, rows), rows)
            best.least[a : a + BLOCK] = part.least
        out = [column("shard")[0], column("pivot")[0], rows.tobytes(), column("id").to_pylist(), tree.x.tobytes(), tree.nodes.tobytes(), tree.up.tobytes(), rows[asks].tobytes(), ids[asks].tolist(), tree.x[asks].tobytes(), best.least.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 2]
        return pa.table([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], t) for v, t in zip(out, kinds)], [c.split()[0] for c in SHARD.split(", ")])

    return dealt.groupBy("shard").applyInArrow(build, SHARD)


def blocks(trees: DataFrame, of: Shape, pivots: np.ndarray, radius: dict[int, float]) -> DataFrame:
    """Blocks of queries for each routing object of the root whose ball they must look into."""
    metric = Metric(of)

    def sent(rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        squares = metric.squares(vecs)
        far = metric.from_score(squares, least)
        far[least == NONE] = np.inf
        far += SLACK * np.sqrt(squares + metric.norm2)
        d = metric.from_score(squares[:, None], metric.products(metric.ready(vecs), metric.ready(pivots)))
        out: list[list] = [[], [], [], [], []]
        for p, r in radius.items():
            goes = d[:, p] - r <= far
            if goes.any():
                for column, v in zip(out, (p, rows[goes].tobytes(), ids[goes].tobytes(), vecs[goes].tobytes(), least[goes].tobytes())):
                    column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["to", "q_rows", "q_ids", "q_vecs", "q_least"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for rows, ids, vecs, least in zip(*(c.to_pylist() for c in batch.columns)):
                if rows:
                    held.append((np.frombuffer(rows, np.int64), np.array(ids, np.int64), np.frombuffer(vecs, of.dtype).reshape(len(ids), of.length), np.frombuffer(least, np.int64)))
                while held and sum(len(h[0]) for h in held) >= BLOCK:
                    whole = [np.concatenate(c) for c in zip(*held)]
                    yield sent(*(c[:BLOCK] for c in whole))
                    held = [tuple(c[BLOCK:] for c in whole)]
        if held and sum(len(h[0]) for h in held):
            yield sent(*(np.concatenate(c) for c in zip(*held)))

    return trees.mapInArrow(scan, "to int, q_rows binary, q_ids binary, q_vecs binary, q_least binary")


def found(pairs: DataFrame, of: Shape, k: int) -> DataFrame:
    """Of every block and shard, the shard's rows that reach a query's bound, at most k for each."""
    metric = Metric(of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, rows = r["shard"], np.frombuffer(r["rows"], np.int64)
                    names = pa.array(r["ids"], pa.int64())
                    ranks = _ranks(*_ids(names), rows)
                    x = np.frombuffer(r["vecs"], of.dtype).reshape(len(rows), of.length)
                    tree = Tree(x, metric, np.frombuffer(r["nodes"], NODE), np.frombuffer(r["up"], np.float64))
                q_rows = np.frombuffer(r["q_rows"], np.int64)
                best = Best(q_rows, np.frombuffer(r["q_least"], np.int64), k)
                search(tree, np.frombuffer(r["q_vecs"], of.dtype).reshape(len(q_rows), of.length), best, ranks, rows)
                q, j = np.nonzero((best.score > NONE) & (best.score >= best.least[:, None]))
                at = best.at[q, j]
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[q]), pa.array(np.frombuffer(r["q_ids"], np.int64)[q]), pa.array(rows[at]), names.take(pa.array(at)), pa.array(best.score[q, j])], ["q_row", "query_id", "row", "vec_id", "score"])

    return pairs.mapInArrow(scan, "q_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, asks: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with a true ``asks`` (over id), the k other rows of the highest inner product."""
    spark = df.sparkSession
    whole = integers(df, id_col, vec_col, scale)
    of = shape(whole)
    if not of.rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialize(packed(whole.withColumn("asks", F.coalesce(asks, F.lit(False))), of))
    pivots, near = rooted(rows, of)
    size = min(MOST, max(LEAST, of.rows // PARTS))
    stat = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("radius"), F.sum(F.col("asks").cast("long")).alias("q")).orderBy("pivot").collect()  # a row for each of PIVOTS at most
    first, ways, at = [0] * len(pivots), [1] * len(pivots), 0
    for r in stat:
        first[r["pivot"]], ways[r["pivot"]] = at, -(-r["n"] // size)
        at += ways[r["pivot"]]
    of_pivot = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(c) + 1)
    dealt = near.withColumn("shard", (of_pivot(first, "pivot") + F.pmod(F.xxhash64("row"), of_pivot(ways, "pivot"))).cast("int")).drop("up")
    trees = materialize(shards(dealt, of, k))
    release(rows)
    asked = sum(r["q"] for r in stat)
    few = trees.select("asked", "asked_ids", "asked_vecs", "least").coalesce(max(1, -(-asked // BLOCK)))
    sent = blocks(few, of, pivots, {r["pivot"]: r["radius"] for r in stat})
    last = of_pivot(first, "to") + of_pivot(ways, "to") - 1
    sent = sent.withColumn("shard", F.explode(F.sequence(of_pivot(first, "to"), last))).drop("to")
    pairs = sent.join(trees.select("shard", "rows", "ids", "vecs", "nodes", "up"), "shard")  # a shard is one row, blocks stream by it
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found(pairs, of, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every fiftieth vector with all others."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)
