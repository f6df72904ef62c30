"""Order-preserving packing of tokenized documents into sequences.

The documents of a partition form one stream of tokens, each document ending
with an end token. Windows of at most ``size`` tokens are cut from the stream
by dynamic programming over its document and sentence boundaries, minimising
padding plus penalties: a cut at the end of a document is free, one at the end
of a sentence costs SENTENCE, and one inside a sentence FORCED (such places,
every STEP tokens, are offered only in sentences too long for a window). With
f the least cost up to a boundary at stream position p, and windows padded to
``size``,

    f[j] = penalty[j] + size - p[j] + min over p[j] - size <= p[i] < p[j] of (f[i] + p[i])

whose minimum slides and is kept in a monotone queue, so that the work is
linear in the boundaries. A window whose length is a power of two is not
padded; those of LEAST_POWER tokens or more are further transitions.

The stream is worked off in blocks of about BLOCK tokens; the last window of a
block is not cut yet but opens the next block. So memory is bounded by a block
and one document, and only the last window of a partition may be padded much.

Null and empty texts are documents of the end token alone. Repeated rows are
packed as often as they come; an empty table gives an empty result; other
columns of the input are not read. Sequence ids hold the partition's number in
their upper bits; the same files give the same sequences after any retry.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..functions.parts import text_parts
from ..runtime import read_table

SIZE, END_ID = 4096, 2
SENTENCE, FORCED, WINDOW_COST, STEP, BLOCK, LEAST_POWER = 16, 512, 1, 512, 1 << 19, 256
REMEMBER, POOL, LEARN = 400_000, 3_000_000, 20_000  # pre-tokens whose ids a worker keeps; ids in all; words learnt at a time
GROUP = 1_500_000  # characters of texts encoded at once

# Texts of these characters only are split here; the tokenizer's own splitting takes all others.
PLAIN = re.compile(r"[\n\t\r\x20-\x7e\xa1-\xa7\xb0\xb1\xb6\xb7\xbb\xbf-įı-ňŊ-ž]*")
# A pre-token with the line end after it; punctuation also with the white space after it.
LETTERS = r"a-z\xc0-\xd6\xd8-\xf6\xf8-ž"
WORD = re.compile(rf"(?:[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9])(?:[ \t\r]*+\n)?|[^\s0-9{LETTERS}]+(?:[ \t\r]*+\n|[ \t\r])?")
INSIDE, AT_SENTENCE, AT_DOCUMENT = 0, 1, 2


def grown(x: np.ndarray, least: int) -> np.ndarray:
    """``x``, or a copy of twice its length or more that holds at least so many."""
    if least <= len(x):
        return x
    out = np.zeros(max(least, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


class Tokens:
    """Ids of whole texts with the places where sentences end.

    The ids of a text are those of its pre-tokens. These repeat, and their ids
    are remembered (of about REMEMBER at most, some 200 bytes each); what is new in a batch is encoded at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"\n": 0}
        self.start, self.length, self.ends = (np.zeros(1024, t) for t in (np.uint32, np.uint32, np.uint8))
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool[0], self.filled = END_ID, 1
        self.length[0], self.ends[0] = 1, AT_DOCUMENT

    def _word_ids(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word: each, alone, is one pre-token of the tokenizer.

        Its byte alphabet writes ASCII as it is, so such words go to the merges at once.
        """
        others = [w for w in words if not w.isascii()]
        other_ids = iter([])
        if others:
            ids = self.tokenizer.encode(" ".join(others), add_special_tokens=False).ids
            cuts = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(cuts) == len(others):
                other_ids = (ids[lo:hi] for lo, hi in zip([0, *cuts], cuts))
            else:
                other_ids = (self.tokenizer.encode(w, add_special_tokens=False).ids for w in others)
        for word in words:
            yield [t.id for t in self.merges(word)] if word.isascii() else next(other_ids)

    def _learn(self, marked: list[str]) -> None:
        """Remember new pre-tokens, and the bare words among them; those of one bare word share its place in the pool."""
        bare = [w.rstrip(" \t\r\n") for w in marked]
        number = self.number
        new = [w for w in dict.fromkeys(bare) if w not in number]
        n, most = len(number), len(number) + len(new) + len(marked)
        self.start, self.length, self.ends = (grown(x, most) for x in (self.start, self.length, self.ends))
        for a in range(0, len(new), LEARN):
            part = new[a : a + LEARN]
            ids, sizes = array("I"), []
            for got in self._word_ids(part):
                ids.extend(got)
                sizes.append(len(got))
            m = n + len(part)
            number.update(zip(part, range(n, m)))
            self.length[n:m] = sizes
            self.start[n:m] = self.filled + np.cumsum(sizes) - sizes
            self.pool = grown(self.pool, self.filled + len(ids))
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
            n = m
        for key, w in zip(marked, bare):
            if key != w:
                k = number[w]
                number[key] = n
                self.start[n], self.length[n] = self.start[k], self.length[k]
                self.ends[n] = AT_SENTENCE if key[-1] == "\n" or w[-1] in ".!?" else INSIDE
                n += 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end token; boundary positions
        (in this row of ids) and their kinds."""
        if len(self.number) > REMEMBER or self.filled > POOL:
            self._forget()
        ids_parts, at_parts, kind_parts, base = [], [], [], 0
        run: list[str] = []

        def flush() -> None:
            nonlocal base, run
            if not run:
                return
            number = self.number
            k = np.fromiter(map(number.get, run, repeat(-1)), np.int64, len(run))
            new = np.flatnonzero(k < 0)
            if len(new):
                words = [run[i] for i in new.tolist()]
                self._learn(list(dict.fromkeys(words)))
                k[new] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            n = self.length[k].astype(np.int64)
            hi = np.cumsum(n)
            ids_parts.append(self.pool[np.repeat(self.start[k] - (hi - n), n) + np.arange(hi[-1])])
            kinds = self.ends[k].astype(np.int64)
            before_end = np.flatnonzero(k == 0) - 1
            kinds[before_end[before_end >= 0]] = np.where(k[before_end[before_end >= 0]] == 0, AT_DOCUMENT, INSIDE)
            keep = np.flatnonzero((kinds > 0) & (n > 0))
            at_parts.append(hi[keep] + base)
            kind_parts.append(kinds[keep])
            base += int(hi[-1])
            run = []

        for text in texts:
            if PLAIN.fullmatch(text) and "<|" not in text:
                run += WORD.findall(text.lower())
                run.append("\n")
            else:
                flush()
                e = self.tokenizer.encode(text, add_special_tokens=False)
                ids_parts.append(np.array([*e.ids, END_ID], np.uint32))
                cut = [i + 1 for i, (_, b) in enumerate(e.offsets[:-1]) if text[b - 1 : b] in (".", "!", "?") and b]
                at_parts.append(np.array([*cut, len(e.ids) + 1], np.int64) + base)
                kind_parts.append(np.array([AT_SENTENCE] * len(cut) + [AT_DOCUMENT]))
                base += len(e.ids) + 1
        flush()
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids_parts, np.uint32), (at_parts, np.int64), (kind_parts, np.int64)))


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut_windows(at: np.ndarray, kind: np.ndarray, size: int = SIZE) -> list[int]:
    """Window ends among the increasing boundary positions ``at``; the last of them is one.

    Sentences longer than a window must have been given inner places already.
    """
    powers = [p for p in (1 << k for k in range(size.bit_length())) if LEAST_POWER <= p < size]
    exact: dict[int, list[int]] = {}
    whole = np.concatenate([[0], at])
    for p in powers:
        i = np.searchsorted(whole, at - p)
        hit = np.flatnonzero((at >= p) & (whole[np.minimum(i, len(whole) - 1)] == at - p))
        for j in hit.tolist():
            exact.setdefault(j + 1, []).append(int(i[j]))
    pos = whole.tolist()
    penalty = [0, *np.array([FORCED, SENTENCE, 0])[kind].tolist()]
    penalty[-1] = 0
    cost, came = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + p, index), both increasing
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best = value + size - p
        for e in exact.get(j, ()):
            if cost[e] < best:
                best, i = cost[e], e
        best += penalty[j] + WINDOW_COST
        cost[j], came[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(pos) - 1
    while j:
        ends.append(pos[j])
        j = came[j]
    return ends[::-1]


def with_inner_places(at: np.ndarray, kind: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Add places every STEP tokens inside gaps that no window can hold."""
    gaps = np.diff(at, prepend=0)
    wide = np.flatnonzero(gaps > size)
    if not len(wide):
        return at, kind
    step = min(STEP, max(1, size // 2))
    extra = np.concatenate([np.arange(at[i] - gaps[i] + step, at[i], step) for i in wide])
    merged = np.concatenate([at, extra])
    order = np.argsort(merged, kind="stable")
    return merged[order], np.concatenate([kind, np.zeros(len(extra), kind.dtype)])[order]


class Stream:
    """Packs one partition's documents, block by block."""

    def __init__(self, first_sequence: int, size: int = SIZE):
        self.sequence, self.size = first_sequence, size
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.kind = np.zeros(0, np.int64)
        self.docs: list[tuple[object, int, int]] = []  # id, start in self.ids (may be negative), tokens
        self.rows: list[tuple] = []

    def add(self, doc_ids: list, ids: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
        base = len(self.ids)
        ends = at[kind == AT_DOCUMENT]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.docs += zip(doc_ids, (starts + base).tolist(), (ends - starts).tolist())
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, at + base])
        self.kind = np.concatenate([self.kind, kind])
        if len(self.ids) >= BLOCK:
            self.cut(last=False)

    def cut(self, last: bool) -> None:
        """Emit the windows so far; all but the last one unless the stream ends."""
        if not len(self.at):
            return
        ends = cut_windows(*with_inner_places(self.at, self.kind, self.size), self.size)
        if not last:
            ends.pop()
        lo, d = 0, 0
        for hi in ends:
            while d < len(self.docs) and self.docs[d][1] < hi:
                doc, start, n = self.docs[d]
                a, b = max(start, lo), min(start + n, hi)
                if a < b:
                    self.rows.append((doc, a - start, b - a, zlib.crc32(self.ids[a:b].tobytes()), n, self.sequence, a - lo))
                if start + n > hi:
                    break
                d += 1
            self.sequence += 1
            lo = hi
        keep = self.at > lo
        self.ids, self.at, self.kind = self.ids[lo:], self.at[keep] - lo, self.kind[keep]
        self.docs = [(doc, start - lo, n) for doc, start, n in self.docs[d:] if start + n > lo]

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_tokenizer()
    types = (pa.int64(),) * 6
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(TaskContext.get().partitionId() << 33, size)
        encoder = tokens(path)
        kind = pa.int64()

        def out() -> Iterator[pa.RecordBatch]:
            if got := stream.take():
                columns = list(zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names)

        for batch in text_parts(rows, 1, GROUP):
            kind = batch.schema.field(0).type
            stream.add(batch.column(0).to_pylist(), *encoder.encode([t or "" for t in batch.column(1).to_pylist()]))
            yield from out()
        stream.cut(last=True)
        yield from out()

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(work, f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def op3_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
