"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: A-Z lower-cased, words are runs of characters other than space
and U+0009..U+000D, shingles of SHINGLE words with repeats (fewer words: the
whole sequence; none: fingerprint zero), each hashed by XXH64 with SEED over
its UTF-8 bytes. A bit is set if it is set in over half the hashes.
Fingerprints that differ in at most DISTANCE bits are linked; components are
the transitive closure.

Search: the 64 bits are grouped into parts so that correlated bits meet in
one part. If part i is given a threshold t(i) >= -1 with sum of t(i) =
DISTANCE - parts + 1, two linked fingerprints differ by at most t(i) bits in
some part i. Dynamic programming spreads the thresholds to the least estimated
number of candidates and probes, for each number of parts; the estimates come
from all fingerprints' bit counts and part values. A part's key is
probed with all keys that differ in at most t(i) bits; of two such keys only
the smaller probes the larger. Candidates are verified on the whole
fingerprint. Within a key's group no pairs are listed: a spanning forest of
its links is enough for components, and is what a group emits. A group of more
than HOT fingerprints is dealt again by the pigeonhole on the bits that its key
leaves open (DISTANCE + 1 exact parts, two linked fingerprints agree on one), up to ROUNDS times, so that what is
unlike parts. A group that still is larger, as of a dense ball of fingerprints, is cut into blocks of some HOT, and
every two blocks meet in a group of their own: no group has more than some 2 HOT, whatever its key had, and
its work, quadratic at worst, is spread over as many tasks as there are pairs of blocks.

Null and empty texts have fingerprint zero, linked like any other. Null ids
get a component like others (the smallest id that is not null in it). Repeated
rows give repeated result rows; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import mark, materialize, read_table, release, sweep

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
FEW = 8  # up to so many members, a group is compared pair by pair
PARTS = (2, 3, 4, 5)
PROBE_COST = 100.0  # of a probe, in verifications: written, shuffled and sorted it takes some 6 us, an XOR with its popcount 0.06
MOST_PROBES = 200  # of one fingerprint
HOT, ROUNDS = 4096, 3  # members from which a group is dealt again; how often, before it is cut into blocks


def hashes(text: str, k: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and those blanks only
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]


def fingerprints_of(texts: list[str], k: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    start, pending, count = 0, [], 0

    def close(stop: int) -> None:
        nonlocal start, pending, count
        sizes = np.array([len(h) for h in pending])
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.array([x for h in pending for x in h], np.uint64)
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
            major = (2 * ones > sizes[full][:, None]).astype(np.uint8)
            out[start + full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
        start, pending, count = stop, [], 0

    for i, t in enumerate(texts):
        pending.append(hashes(t, k))
        count += len(pending[-1])
        if count > 200_000:
            close(i + 1)
    close(len(texts))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """id and fp (the 64 bits as a long) of every row."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fp = fingerprints_of([t or "" for t in batch.column(1).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(scan, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set: 64 x 64 sums made where the rows are."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in rows:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            for a in range(0, len(b), 1 << 20):  # exact in single precision
                total += b[a : a + (1 << 20)].T @ b[a : a + (1 << 20)]
            n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.astype(np.int64).ravel().tolist(), n], pa.int64())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(scan, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:  # 4097 rows, whatever the input
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each grows from a free bit by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        order = sorted(free)
        seed = max(order, key=lambda i: (corr[i, order].max(initial=0), -i))
        part = [seed]
        free.remove(seed)
        while len(part) < width:
            nxt = max(sorted(free), key=lambda j: (corr[part, j].sum(), -j))
            part.append(nxt)
            free.remove(nxt)
        out.append(sorted(part))
    return out


def spread_thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t(i) >= -1 of given sum with the least sum of costs; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t, x in enumerate(c, start=-1):
                if spent + t not in nxt or cost + x < nxt[spent + t][0]:
                    nxt[spent + t] = (cost + x, [*ts, t])
        best = nxt
    return best.get(total, (float("inf"), []))


def plan(fps: DataFrame, distance: int = DISTANCE) -> tuple[list[list[int]], list[int]]:
    """Bit parts and thresholds with the least estimated work."""
    n, together = bit_counts(fps)
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    layouts = [group_bits(n, together, m) for m in PARTS if m <= distance + 1]
    flat = [part for layout in layouts for part in layout]
    # Pairs that share a part's value, counted over all fingerprints, all parts in one pass.
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), _key(part).alias("key")) for k, part in enumerate(flat)])).alias("v")
    sizes = fps.select(values).groupBy("v.part", "v.key").count()
    same = {r["part"]: float(r["pairs"]) for r in sizes.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    choices = []
    k = 0
    for layout in layouts:
        costs = []
        for part in layout:
            spread = np.array([1.0])
            for d in differ[part]:
                spread = np.convolve(spread, [1 - d, d])
            pairs = n * (n - 1) / 2
            exact, expected = same.get(k, 0.0), pairs * spread[0]
            c = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(part), q) for q in range(1, t + 1)) / 2
                c.append(exact + max(exact / expected if expected else 1.0, 1.0) ** 0.5 * pairs * spread[1 : t + 1].sum() + PROBE_COST * n * (1 + probes) if probes <= MOST_PROBES else float("inf"))
            costs.append(c)
            k += 1
        choices.append((*spread_thresholds(costs, distance - len(layout) + 1), layout))
    cost, thresholds, layout = min(choices, key=lambda x: x[0])
    return layout, thresholds


def _key(part: list[int]):
    """The part's bits, packed from bit 0."""
    out = None
    for to, bit in enumerate(part):
        piece = F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1).cast("long")), to)
        out = piece if out is None else out.bitwiseOR(piece)
    return out


def signatures(fps: DataFrame, layout: list[list[int]], thresholds: list[int]) -> DataFrame:
    """key, used, fp: each fingerprint under its own keys and those larger ones it probes.

    A key is a hash of part and bits (two that collide share a group, and are
    told apart there); used are the part's bits.
    """
    shifts = [np.array(part, np.uint64) for part in layout]
    masks = [np.array([sum(1 << b for b in c) for q in range(1, t + 1) for c in combinations(range(len(part)), q)], np.int64) for part, t in zip(layout, thresholds)]

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(whole), 20_000):
                fp = np.ascontiguousarray(whole[a : a + 20_000])
                for k, (bits, mask) in enumerate(zip(shifts, masks)):
                    if thresholds[k] < 0:
                        continue
                    key = np.zeros(len(fp), np.int64)
                    for to, bit in enumerate(bits):
                        key |= ((fp.view(np.uint64) >> bit) & np.uint64(1)).astype(np.int64) << to
                    keys, owners = [key], [fp]
                    if len(mask):
                        probe = key[:, None] ^ mask[None, :]
                        row, col = np.nonzero(probe > key[:, None])
                        keys.append(probe[row, col])
                        owners.append(fp[row])
                    key, fp_out = np.concatenate(keys), np.concatenate(owners)
                    used = np.bitwise_or.reduce(np.left_shift(np.uint64(1), bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(key, k)), pa.array(np.full(len(key), used)), pa.array(fp_out)], ["key", "used", "fp"])

    return fps.select("fp").mapInArrow(scan, "key bigint, used bigint, fp bigint")


def _mixed(key: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A 64-bit mix of keys and salts."""
    x = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt, np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def dealt_again(rows: DataFrame, distance: int) -> DataFrame:
    """key, used, fp of hot groups' rows under distance + 1 exact parts of the bits not used so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for mask in np.unique(used):  # as many as parts, and paths through them
                here = used == mask
                bits = [b for b in range(BITS) if not int(mask) >> b & 1]
                for k in range(distance + 1):
                    part = np.array(sum(1 << b for b in bits[k :: distance + 1]), np.uint64).view(np.int64)
                    owners = fp[here]
                    sub = _mixed(_mixed(key[here], k + 1), owners & part)
                    yield pa.RecordBatch.from_arrays([pa.array(sub), pa.array(np.full(len(sub), mask | part)), pa.array(owners)], ["key", "used", "fp"])

    return rows.mapInArrow(scan, "key bigint, used bigint, fp bigint")


def in_blocks(rows: DataFrame, large: DataFrame, hot: int) -> DataFrame:
    """The rows of large groups (key, n), each under every pair of its block with another."""
    d = rows.join(large, "key").withColumn("ways", F.ceil(F.col("n") / hot).cast("int"))
    d = d.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).filter("own <> other")
    return d.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "used", "fp")


def cooled(rows: DataFrame, distance: int, hot: int | None = None) -> DataFrame:
    """The rows, with those of hot groups dealt again, and in blocks at last."""
    done, hot = None, hot or HOT
    for k in range(ROUNDS + 1):
        rows = materialize(rows)
        large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
        if large.isEmpty():
            break
        cold = rows.join(large, "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        rows = dealt_again(rows.join(large, "key", "left_semi"), distance) if k < ROUNDS else in_blocks(rows, large, hot)
    return rows if done is None else done.unionByName(rows)


def links(fps: DataFrame, layout: list[list[int]], thresholds: list[int], distance: int, hot: int | None = None) -> DataFrame:
    """Links a < b that connect each component of the fingerprints."""
    ways = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cooled(signatures(fps, layout, thresholds), distance, hot).select("key", "fp")
    return linked(rows.repartition(ways, "key").sortWithinPartitions("key"), distance)


class Forest:
    """Union-find over fingerprints, the smaller one on top."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def forest_of_group(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one group, without listing its pairs."""
    left = np.unique(fp)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance  # of signed numbers it would count the absolute value's
            reached, left = left[near], left[~near]
            yield from ((int(x), y) for y in reached.tolist())
            front += list(reached)


def linked(sorted_rows: DataFrame, distance: int) -> DataFrame:
    """Links a < b among rows sorted by key within partitions; each task emits a star per component it sees."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[np.ndarray] = []  # the group that may go on in the next batch

        def work(key: np.ndarray, fp: np.ndarray) -> None:
            new = np.flatnonzero(np.diff(key) != 0) + 1
            group = np.zeros(len(fp), np.int64)
            group[new] = 1
            group = np.cumsum(group)
            size = np.bincount(group)
            few = (size > 1) & (size <= FEW)
            rows_few = np.flatnonzero(few[group])
            g, f = group[rows_few], fp[rows_few]
            for step in range(1, FEW):
                hit = np.flatnonzero((g[step:] == g[:-step]) & (np.bitwise_count((f[step:] ^ f[:-step]).view(np.uint64)) <= distance) & (f[step:] != f[:-step]))
                for a, b in zip(f[hit].tolist(), f[hit + step].tolist()):
                    forest.join(a, b)
            start = np.concatenate([[0], np.cumsum(size)])
            for big in np.flatnonzero(size > FEW):
                for a, b in forest_of_group(fp[start[big] : start[big + 1]], distance):
                    forest.join(a, b)

        for batch in rows:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(fp):
                continue
            if held:
                key, fp = (np.concatenate([h, x]) for h, x in zip(held, (key, fp)))
            tail = len(fp) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if tail:
                work(key[:tail], fp[:tail])
            held = [key[tail:].copy(), fp[tail:].copy()]
        if held:
            work(*held)
        pairs = [(x, forest.top(x)) for x in forest.up]
        pairs = [(top, x) for x, top in pairs if x != top]
        for a in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[a : a + 100_000]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return sorted_rows.mapInArrow(scan, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of the edges (a, b).

    Alternating large and small stars: each round is two aggregations and two
    joins on the edges, which shrink to stars in a logarithmic number of rounds.
    """
    pairs = materialize(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    while True:
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u < v").distinct()
        large = materialize(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        hooked = large.join(least, "v")
        small = hooked.select(F.col("m").alias("u"), "v").unionByName(hooked.select(F.col("m").alias("u"), F.col("u").alias("v"))).filter("u < v").distinct()
        small = materialize(small)
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        settled = pairs.agg(mark).first() == small.agg(mark).first()
        release(pairs)
        release(large)
        pairs = small
        if settled:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def grouped(own: DataFrame, distance: int) -> DataFrame:
    """fp and root of each fingerprint in ``own`` that is linked to another."""
    since = mark(own.sparkSession)
    fps = materialize(own.select("fp").distinct())
    layout, thresholds = plan(fps, distance)
    found = components(links(fps, layout, thresholds, distance))
    return sweep(found.select(F.col("node").alias("fp"), "root"), since)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """id, fp, component_id of every row."""
    own = materialize(fingerprints(docs, id_col, text_col, k))
    first = own.groupBy("fp").agg(F.min("id").alias("first"))
    named = materialize(first.join(grouped(own, distance), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return own.join(by_fp, own["fp"] == by_fp["_fp"]).select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: the least by (id, hash of the row), null ids last.

    Rows that repeat an id with texts of different components are all kept, one
    of each; of rows equal in all columns one stays. Texts are shuffled once,
    as the kept rows are a part of all that no broadcast could be promised for.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    c, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    plain = [f.name for f in docs.toDF(*names).schema if "map<" not in f.dataType.simpleString()]
    d = docs.toDF(*names).withColumn("_row", F.xxhash64(*plain)).withColumn("_again", F.xxhash64(F.lit(1), *plain))
    own = materialize(fingerprints(d.withColumn("_own", F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("id"), F.col("_row").alias("row"), F.col("_again").alias("again"))), "_own", t, k))
    best = own.groupBy("fp").agg(F.min("id").alias("first")).join(grouped(own, distance), "fp", "left")
    kept = materialize(best.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"), F.col("first.again").alias("_again")))
    release(own)
    rows = d.join(kept, ["_row", "_again"], "left_semi")  # 128 bits of the whole row, its id included
    return rows.dropDuplicates(["_row", "_again"]).select(*names).toDF(*docs.columns)


def op9_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
