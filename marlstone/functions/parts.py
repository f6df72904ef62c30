"""Batches of rows in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PART = 1 << 17  # characters of texts, and hits, that are Python objects at one time


def parts(batch: pa.RecordBatch, sizes: list[int], most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of up to ``most`` by its rows' sizes; a larger row is a part of its own."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def text_parts(batches: Iterator[pa.RecordBatch], at: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to ``most`` characters of their column ``at``, or of one text, so that only so many become Python's."""
    for batch in batches:
        yield from parts(batch, pc.utf8_length(batch.column(at)).fill_null(0).to_pylist(), most)
