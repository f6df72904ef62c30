"""Fill-in-the-middle rewriting of texts, cut at token boundaries by rank and select.

A token is a run of characters other than space and U+0009..U+000D with the
blanks before it; blanks at the end of a text are one more. All of them are single
bytes in UTF-8, so the texts of an Arrow batch are scanned as the bytes they are
stored in: one packed bitvector marks the last byte of every token, another the
first byte of every character. A directory holds the popcounts before every
block of WORDS words. Ranks at a text's two ends give its number of tokens and
characters, selects on two ranks the bytes of its two cuts.

Null and empty texts are plain and have no tokens; a null id counts as no digits.
Repeated rows give repeated rows, an empty table an empty result; other columns
are not read. Equal ids and texts are cut alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table

# Markers of prefix, suffix and middle, blanks, seed, and per cent of texts cut, and of these with the suffix first.
P, S, M = b"<P>", b"<S>", b"<M>"
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SEED, CUT, SUFFIX_FIRST = "42", 50, 80
WORDS = 8


class Bits:
    """A packed bitvector with the popcounts before every block of WORDS 64-bit words."""

    def __init__(self, flags: np.ndarray):
        block = 64 * WORDS
        padded = np.zeros((len(flags) // block + 1) * block, bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view("<u8").reshape(-1, WORDS)
        self.within = np.cumsum(np.bitwise_count(self.words), axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.within[:, -1])])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before these places."""
        block, word, bit = at // (64 * WORDS), at // 64 % WORDS, (at % 64).astype(np.uint64)
        words = self.words[block, word]
        below = words & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + self.within[block, word] - np.bitwise_count(words) + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the ones with these ranks, counted from 0."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        word = (self.within[block] <= left[:, None]).sum(1)
        left = left - np.where(word > 0, self.within[block, word - 1], 0)
        bits = np.unpackbits(self.words[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(1)
        return (block * WORDS + word) * 64 + bit


def token_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A flag at the last byte of every token of the texts in ``data``, each from a start to an end."""
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    is_blank = blank[data]
    flags = np.zeros(len(data), bool)
    flags[:-1] = ~is_blank[:-1] & is_blank[1:]
    last = ends[ends > starts] - 1
    flags[last] = True  # and a text's last blanks are a token
    return flags


def draws(ids: list) -> np.ndarray:
    """Four 32-bit numbers of each id."""
    digest = b"".join(hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digest, ">u4").reshape(-1, 4).astype(np.int64)


def rewritten(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text in its form, cut at bytes a and b."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return S + suffix + P + prefix + M + middle if form == "spm" else P + prefix + S + suffix + M + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that ``rewritten`` made this of. A cut text holds no marker, and none can arise at a seam, as "<" is only a marker's first byte."""
    if form == "plain":
        return output
    second = P if form == "spm" else S
    first, rest = output[3:].split(second, 1)
    other, middle = rest.split(M, 1)
    return other + middle + first if form == "spm" else first + middle + other


def cuts(ids: list, column: pa.StringArray) -> tuple[np.ndarray, ...]:
    """For each text its bytes' start, n, whether it is cut, whether its suffix comes first, cuts a and b in bytes, characters of prefix and middle."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base = offsets[0] if len(offsets) else 0
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[base : offsets[-1]]
    starts, ends = offsets[:-1] - base, offsets[1:] - base
    tokens, characters = Bits(token_ends(data, starts, ends)), Bits((data & 0xC0) != 0x80)
    before = tokens.rank(starts)
    n = tokens.rank(ends) - before
    h = draws(ids)
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    places = []
    for u in units.T:
        at = starts.copy()
        some = u > 0
        at[some] = tokens.select((before + u - 1)[some]) + 1
        places.append(at)
    a, b = places
    first = characters.rank(starts)
    prefix = characters.rank(a) - first
    middle = characters.rank(b) - first - prefix
    return starts, n, h[:, 2] % 100 < CUT, h[:, 3] % 100 < SUFFIX_FIRST, a - starts, b - starts, prefix, middle


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row, and output where asked for."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if outputs else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.string())
            _, n, cut, suffix_first, a, b, prefix, middle = cuts(ids, column)
            forms, digests, backs, texts = [], [], [], []
            for k, s in enumerate(column):
                text = s.as_buffer().to_pybytes() if s.is_valid else b""
                plain = not cut[k] or not text or P in text or S in text or M in text
                form = "plain" if plain else "spm" if suffix_first[k] else "psm"
                output = rewritten(text, form, a[k], b[k])
                forms.append(form)
                digests.append(hashlib.sha256(output).hexdigest())
                backs.append(hashlib.sha256(restored(output, form)).hexdigest())
                if outputs:
                    texts.append(output)
            whole = np.array([f == "plain" for f in forms], bool)
            columns = [batch.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=whole), pa.array(middle, mask=whole), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.binary()).view(pa.string())] if outputs else []), names)

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    return source.mapInArrow(scan, kinds + (", output string" if outputs else ""))


def op13_infill_rank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, form, cuts and digests of every document."""
    return infill(read_table(spark, sf_dir, "documents"), outputs=False).withColumnRenamed("id", "doc_id")
