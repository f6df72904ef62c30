"""Substring dedup by sliding spans of sentences.

A text is cut into sentences after . ! ? before white space and at line
ends. Prose without stops has no sentences to slide over: what runs on for more
than LONG words is cut after those words whose hash is divisible by EVERY, and
where LONG words in a row have none, after the last of the least hash among
them, so that a passage has the same pieces wherever it is put. Spans are the
shortest runs of SEVERAL pieces, or of SENTENCES with at least WORDS words, that start
at each piece, and those that end at each (none, if the text ends or starts
before), so that a repeated passage is covered to its last piece; any longer
run is made of these, so every run of SEVERAL sentences counts, however short they are. Spans are equal if the 128-bit hashes of their words are
(of 10^14 spans, two that differ meet with a chance below 10^-10); the span
that comes first by (id, text's hash, place) stays, and the pieces covered by
any other are removed.

Null texts stay null, empty ones empty, and a text whose pieces all go becomes
empty; every row stays. Rows that repeat both id and text count as one
document. Rows with null ids come first in the order. An empty table gives an
empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, read_table, release

SEVERAL, SENTENCES, WORDS, LONG, EVERY = 4, 2, 20, 40, 10
BITS = 40
START = (1 << BITS) - 1
BREAK = re.compile(r"(?<=[.!?])[ \t\r]+|\n")
WORD = re.compile(r"\S+")

Piece = tuple[int, int, int, str]  # start, end, words, words joined by a space


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


def content_cuts(words: list[str]) -> list[int]:
    """Numbers of words after which a long sentence is cut; each hangs on fewer than LONG words on either side."""
    hashes = [_hash(w) for w in words[:-1]]
    marks = [k for k, h in enumerate(hashes, 1) if h % EVERY == 0]
    if all(b - a <= LONG for a, b in zip([0, *marks], [*marks, len(words)])):
        return marks
    out = set(marks)
    for lo, hi in zip([0, *marks], [*marks, len(words)]):
        inner = hashes[lo : hi - 1]  # none of these qualifies
        for a in range(len(inner) - LONG + 1):
            least = min(range(a, a + LONG), key=lambda k: (inner[k], -k))
            out.add(lo + least + 1)
    return sorted(out)


def pieces(text: str) -> list[Piece]:
    """Sentences, and parts of long ones, that have words."""
    out: list[Piece] = []
    at = 0
    stops = [(m.start(), m.end()) for m in BREAK.finditer(text)]
    for stop, after in [*stops, (len(text), len(text))]:
        words = text[at:stop].split()
        if words:
            if len(words) <= LONG:
                out.append((at, stop, len(words), " ".join(words)))
            else:
                marks = [m.span() for m in WORD.finditer(text, at, stop)]
                cuts = content_cuts(words)
                for lo, hi in zip([0, *cuts], [*cuts, len(words)]):
                    out.append((marks[lo][0], marks[hi - 1][1], hi - lo, " ".join(words[lo:hi])))
        at = after
    return out


def enough(pieces_: int, words: int) -> bool:
    """Do so many pieces and words make a span? What holds one that does, does too."""
    return pieces_ >= SEVERAL or (pieces_ >= SENTENCES and words >= WORDS)


def span_end(parts: list[Piece], i: int) -> int:
    """End (exclusive) of the span from piece i; 0 if there is none."""
    words = 0
    for j in range(i, len(parts)):
        words += parts[j][2]
        if enough(j - i + 1, words):
            return j + 1
    return 0


def runs(parts: list[Piece]) -> list[tuple[int, int]]:
    """Start and end (exclusive) of all spans, by start and then end.

    The shortest run that ends at e starts at i where the shortest from i ends
    at or before e, and the shortest from i + 1 after it.
    """
    n = len(parts)
    sums = [0, *accumulate(p[2] for p in parts)]
    out, end = [], 0
    for i in range(n):
        end = max(end, i + SENTENCES)
        while end <= n and not enough(end - i, sums[end] - sums[i]):
            end += 1
        if out:
            last, first = out[-1]
            out += [(last, e) for e in range(first + 1, min(end, n + 1))]
        if end > n:
            return out
        out.append((i, end))
    return out


def spans(parts: list[Piece]) -> tuple[list[int], bytes]:
    """Place of each span, and the 16-byte hashes of their words, one after another.

    A place is the piece at which the span starts, and above START's bits how
    many pieces longer it is than the shortest from there.
    """
    encoded = [p[3].encode("utf-8", "surrogatepass") for p in parts]
    words = b" ".join(encoded)
    starts = [0, *accumulate(len(e) + 1 for e in encoded)]
    places, digests, at, least = [], bytearray(), -1, 0
    for i, end in runs(parts):
        if i != at:
            at, least = i, end
        places.append(i | (end - least) << BITS)
        digests += xxhash.xxh3_128_digest(words[starts[i] : starts[end] - 1])
    return places, bytes(digests)


def _span_rows(docs: DataFrame) -> DataFrame:
    """hash, check (the 128 bits), id, key, place of every span of (id, key, text)."""

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            owner, place, digest = [], [], bytearray()

            def out() -> pa.RecordBatch:
                take = pa.array(owner, pa.int64())
                halves = np.frombuffer(bytes(digest), np.int64).reshape(-1, 2)
                columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(take), batch.column(1).take(take), pa.array(place, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["hash", "check", "id", "key", "place"])

            for r, text in enumerate(batch.column(2).to_pylist()):
                places, digests = spans(pieces(text or ""))
                owner += [r] * len(places)
                place += places
                digest += digests
                if len(owner) > 200_000:
                    yield out()
                    owner, place, digest = [], [], bytearray()
            yield out()

    return docs.mapInArrow(scan, f"hash bigint, check bigint, id {docs.schema['id'].dataType.simpleString()}, key bigint, place bigint")


def repeated_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, places: where non-first repeated spans start, for each document that has any.

    Texts are read once; the spans' table has their hashes and places only.
    Hashes alone are counted first, combined before the shuffle; only spans of
    repeated hashes go further. The first spans are a table of their own, as
    adaptive execution splits a hot hash only where both sides of a join are
    shuffled for it; no group of equal spans is gathered.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(_span_rows(source))
    same = ["hash", "check"]
    twice = materialize(rows.groupBy(*same).count().filter("count > 1").select(*same))
    shared = materialize(rows.join(twice, same, "left_semi"))
    release(rows)
    release(twice)
    order = F.struct("id", "key", F.col("place").bitwiseAND(F.lit(START)).alias("start"))  # equal spans of a document start apart
    first = materialize(shared.groupBy(*same).agg(F.min(order).alias("first")))
    later = shared.join(first, same).filter(~order.eqNullSafe(F.col("first")))
    places = materialize(later.groupBy("id", "key").agg(F.collect_set("place").alias("places")))
    release(shared)
    release(first)
    return places


def cut_out(text: str, places: list[int]) -> tuple[str, list[tuple[int, int]], int]:
    """Text without the pieces of the spans at these places, the removed ranges, and the number of pieces removed."""
    parts = pieces(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for place in places:
        i = place & START
        gone[i] += 1
        gone[span_end(parts, i) + (place >> BITS)] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    ranges: list[tuple[int, int]] = []
    for i in np.flatnonzero(covered).tolist():
        start = parts[i][0]
        stop = parts[i + 1][0] if i + 1 < len(parts) else len(text)
        if ranges and ranges[-1][1] == start:
            ranges[-1] = (ranges[-1][0], stop)
        else:
            ranges.append((start, stop))
    kept, at = [], 0
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return "".join(kept) + text[at:], ranges, int(covered.sum())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """Rows of ``docs`` with shortened texts; with report also n_removed and removed ("start:end,...")."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    d = docs.toDF(*names)
    places = repeated_places(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "places")
    own = F.col(names[docs.columns.index(id_col)])
    joined = d.join(places, (F.xxhash64(own, F.col(names[at])) == F.col("_key")) & own.eqNullSafe(F.col("_id")), "left").select(*names, "places")
    extra = ["n_removed", "removed"] if report else []

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, starts = batch.column(at), batch.column(len(names))
            done = [(t, [], 0) if not p else cut_out(t, p) for t, p in zip(texts.to_pylist(), starts.to_pylist())]
            columns = [pa.array([x[0] for x in done], pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            if report:
                columns += [pa.array([x[2] for x in done], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in x[1]) for x in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names + extra)

    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema)) + ", n_removed bigint, removed string" * report
    return joined.mapInArrow(scan, types).toDF(*docs.columns, *extra)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without sentences that an earlier span repeats."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, report=True)
