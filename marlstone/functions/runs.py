"""Sets of word runs as 64-bit hashes, made for many texts at a time from their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

AT_ONCE = 1 << 21  # bytes of texts, or one text

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, one to one."""
    z = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_VALUE = mixed(np.arange(256)) | np.uint64(1)


def _word_hashes(b: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the bytes ``b``, and where each begins; no word goes across one of ``firsts``."""
    word = _WORD[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[firsts] = word[firsts]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), at
    begin = np.flatnonzero(start[at])
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    odd = mixed(np.arange(1, place.max() + 2) << 20) | np.uint64(1)
    return mixed(np.add.reduceat(_VALUE[b[at]] * odd[place], begin)), at[begin]


def run_sets(texts: pa.Array, seeds: np.ndarray, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their distinct runs of ``k`` words of a-z and 0-9 (hashes, ascending in each text), where each text's begin, and a hash
    of each set, part by part. Texts are in lower case and not null; texts of different seeds have no hashes in common."""
    texts = texts.cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + AT_ONCE, "right")) - 1)
        bounds = starts[first : last + 1] - starts[first]
        firsts = bounds[:-1]
        words, at = _word_hashes(data[starts[first] : starts[last]], firsts[firsts < bounds[-1]])
        row = np.repeat(np.arange(last - first), np.diff(np.searchsorted(at, bounds)))
        i = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :])
        row, seed = row[i], seeds[first:last].view(np.uint64)
        x = mixed(seed[row])
        for d in range(k):
            x = mixed(x + words[i + d])
        x = x.view(np.int64)
        ends = np.searchsorted(row, np.arange(last - first + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            x[a:b].sort()
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
        x, row = x[new], row[new]
        ends = np.searchsorted(row, np.arange(last - first + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x))])
        sums = mixed(total[ends[1:]] - total[ends[:-1]]) + np.diff(ends).astype(np.uint64)
        yield slice(first, last), x, ends, mixed(mixed(seed) ^ mixed(sums)).view(np.int64)
        first = last
