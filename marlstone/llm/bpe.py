"""Byte-level BPE by backtracking over longest matches.

The vocabulary's tokens, as Latin-1 strings, form an Aho-Corasick automaton.
A piece is encoded from the left: take the longest token that matches here; if
it can't stand after the token before it, or if the place where it ends is
known to lead nowhere, take the next shorter token that is its prefix, and
with none left give the last token back. A sequence in which every two
neighbours can stand together is the very sequence that merging by rank gives,
so the answer is exact, and each place is given up at most once, which makes
the work linear in the piece.

Whether two tokens can stand together is found by undoing merges along their
seam, latest first, and is remembered for each pair.

Null texts are encoded as empty ones (no ids). Any text round-trips. Repeated
rows give repeated result rows, an empty table an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..runtime import read_table

# White space as the pattern's \s means it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
REMEMBER, LONG_PIECE = 400_000, 200  # entries of each generation of a memo; characters beyond which a piece is not kept


class Memo:
    """A dictionary of bounded size: when the young generation is full, it becomes the old one."""

    def __init__(self, most: int = REMEMBER):
        self.young: dict = {}
        self.old: dict = {}
        self.most = most

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        body = pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")
        self.piece = regex.compile(body)
        self.length_of = {r: len(b) for b, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.token_at: dict[str, int] = {}
        self.reach = max(map(len, ranks))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self._halves(token, rank)
                if halves is None:
                    continue  # merging never arrives at it; only a whole piece can be this token
                self.parts[rank] = halves
            self.token_at[token.decode("latin-1")] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                prefix = ranks.get(token[:n])
                if prefix is not None and (n == 1 or prefix in self.parts):
                    self.shorter[rank] = prefix
                    break
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right, as neighbours, are left unmerged."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * REMEMBER:
                self.pairs.clear()
            known = self.pairs[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        before = 1 << 60  # merges of at least this rank come after both sides are whole
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if merged is not None and merged < before:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]  # of equal ranks, the seam's pair is the more left one

    def longest(self, text: str, at: int) -> int:
        """The longest token that begins at this place."""
        head = text[at : at + self.reach]
        n = self.automaton.longest_prefix(head)  # as far as the trie goes
        token = self.token_at.get(head[:n])
        while token is None:
            n -= 1
            token = self.token_at.get(head[:n])
        return token

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        shorter, size = self.shorter, self.length_of
        dead = bytearray(len(text) + 1)
        ids: list[int] = []
        at, token = 0, self.longest(text, 0)
        while at < len(text):
            last = ids[-1] if ids else None
            while True:
                end = at + size[token]
                if not dead[end] and (last is None or self.compatible(last, token)):
                    ids.append(token)
                    at = end
                    if at < len(text):
                        token = self.longest(text, at)
                    break
                token = shorter.get(token)
                if token is None:
                    dead[at] = 1
                    token = ids.pop()
                    at -= size[token]
                    break
        return ids

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the bytes they decode to."""
        out = []
        memo, young = self.pieces, self.pieces.young
        for piece in self.piece.findall(text):
            known = young.get(piece)
            if known is None:
                known = memo.get(piece)
                if known is None:
                    ids = array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                    known = ids.tobytes(), self.decode(ids)
                    if len(piece) <= LONG_PIECE:
                        memo.put(piece, known)
                young = memo.young
            out.append(known)
        return b"".join([x[0] for x in out]), b"".join([x[1] for x in out])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def default_vocabulary() -> tuple[str, str]:
    """File of ranks and split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as f:  # the vocabulary is installed on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def _mapped(df: DataFrame, id_col: str, col: str, kind: str, types: str, work) -> DataFrame:
    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            step = 500
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                columns = work(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *(t.split()[0] for t in types.split(", "))])

    source = df.select(df[id_col].alias("id"), df[col].cast(kind).alias("value"))
    return source.mapInArrow(scan, f"id {df.schema[id_col].dataType.simpleString()}, {types}")


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """id and ids (array of int) of every row."""
    path, pattern = vocabulary or default_vocabulary()

    def work(texts):
        c = codec(path, pattern)
        return [pa.array([array("I", c.encode(t or "")[0]) for t in texts], pa.list_(pa.int32()))]

    return _mapped(df, id_col, text_col, "string", "ids array<int>", work)


def decode_column(df: DataFrame, id_col: str, ids_col: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """id and bytes of every row of ids; null ids give no bytes."""
    path, pattern = vocabulary or default_vocabulary()

    def work(rows):
        c = codec(path, pattern)
        return [pa.array([c.decode(ids or ()) for ids in rows], pa.binary())]

    return _mapped(df, id_col, ids_col, "array<int>", "bytes binary", work)


def encode_digests(df: DataFrame, id_col: str, text_col: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Number and SHA-256 of the ids, and SHA-256 of what they decode to."""
    path, pattern = vocabulary or default_vocabulary()

    def work(texts):
        c = codec(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        done = [(len(i) // 4, sha(i), sha(d)) for i, d in (c.encode(t or "") for t in texts)]
        return [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _mapped(df, id_col, text_col, "string", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)


def op6_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document: digests of ids and of decoded bytes."""
    done = encode_digests(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return done.withColumnRenamed("id", "doc_id")
