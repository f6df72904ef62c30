"""Personal data: patterns, and a character-level BiLSTM-CRF that adds spans.

Every whole text is scanned. Null and empty texts give no spans. Offsets are
code points, ends exclusive. Repeated rows give repeated result rows; an empty
table gives an empty result; other columns of the input are not read.

The tagger (``lstm_crf``) is trained in one task from seeded labelled spans
(``pii_samples``; SAMPLE_WINDOWS windows of SAMPLE_LENGTH characters, whatever
the size of the corpus), once for a session; its weights are a table of one row
and go to the tasks as about 10 kB. It adds the runs of its best path over each
whole document whose gain over "outside" reaches LEAST_GAIN and that have what
any such thing must have: as many digits as its kind, in a card with their check
sum, or, in an address, both an at and a dot. Base spans always stay; what overlaps one is dropped.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.parts import text_parts
from ..runtime import materialize, read_table
from . import lstm_crf
from .pii_samples import KINDS, labelled_windows

SAMPLE_WINDOWS, SAMPLE_LENGTH = 8000, 112
LEAST_GAIN = 6.0  # of log odds
CHARS = 1_000_000  # of texts that are tagged at once

# Patterns of the contract, written so that each scan is linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")  # a run of digits is tried once, from its start
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Least and most digits of a span that the tagger adds.
DIGITS_OF = {1: (4, 12), 2: (13, 19), 3: (9, 15)}
AT = re.compile(r"@|\bat\b", re.IGNORECASE)
DOT = re.compile(r"\.|\bdot\b", re.IGNORECASE)
TRIM = " \n\t.,;:!?|*#%$&\"'"

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at != -1:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield lo, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if m[2] and all(map(_octet, m.groups())):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGIT.findall(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@lru_cache(maxsize=4)
def trained_model(seed: int = 7) -> lstm_crf.Model:
    """The tagger, fitted on the seeded labelled windows."""
    x, y = labelled_windows(SAMPLE_WINDOWS, SAMPLE_LENGTH, seed)
    return lstm_crf.train(x, y, len(KINDS) + 1, seed=seed)


def session_model(spark: SparkSession, seed: int = 7) -> lstm_crf.Model:
    """The tagger, fitted in a task when the session first needs it, and read from the shared folder."""
    sc = spark.sparkContext
    known = getattr(sc, "_marlstone_taggers", None)
    if known is None:
        known = sc._marlstone_taggers = {}
    if seed not in known:

        def fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for s in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained_model(s).arrays())], pa.binary())], ["weights"])

        row = materialize(spark.range(seed, seed + 1, 1, 1).mapInArrow(fit, "weights binary")).first()
        known[seed] = lstm_crf.Model(*pickle.loads(row["weights"]))
    return known[seed]


def _plausible(kind: int, piece: str) -> bool:
    if kind == 0:
        return AT.search(piece) is not None and DOT.search(piece) is not None
    low, high = DIGITS_OF[kind]
    digits = DIGIT.findall(piece)
    return low <= len(digits) <= high and (kind != 2 or _luhn("".join(digits)))


def added_spans(text: str, labels: np.ndarray, scores: np.ndarray, model: lstm_crf.Model, base: list[Span]) -> list[Span]:
    """The tagger's spans that gain enough and touch no base span."""
    edges = [0, *(i + 1 for i in (labels[1:] != labels[:-1]).nonzero()[0].tolist()), len(labels)]
    free = [(a, b) for a, _, b in base]
    out = []
    for a, b in zip(edges, edges[1:]):
        kind = int(labels[a]) - 1
        if kind < 0 or lstm_crf.gain(model, scores, kind, a, b) < LEAST_GAIN:
            continue
        while a < b and text[a] in TRIM:
            a += 1
        while b > a and text[b - 1] in TRIM:
            b -= 1
        if b > a and _plausible(kind, text[a:b]) and not any(a < y and x < b for x, y in free):
            out.append((a, kind, b))
    return out


def joined(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def find(texts: list[str], model: lstm_crf.Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of every text."""
    found = []
    for text, (labels, scores) in zip(texts, lstm_crf.label_texts(model, texts)):
        base = base_spans(text)
        more = added_spans(text, labels, scores, model, base) if labels.any() else []
        found.append((base, sorted(base + more) if more else base))
    return found


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Spans per row: id, and base and all spans as arrays of (start, kind, end)."""
    model = session_model(docs.sparkSession, seed)

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(rows, 1, CHARS):
            found = find([t or "" for t in batch.column(1).to_pylist()], model)
            as_rows = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_rows(x) for x, _ in found], SPANS), pa.array([as_rows(y) for _, y in found], SPANS)],
                ["id", "base", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    struct = "array<struct<start:bigint,kind:string,end:bigint>>"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(scan, f"id {kind}, base {struct}, spans {struct}")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def redact(docs: DataFrame, text_col: str = "text", seed: int = 7) -> DataFrame:
    """The same rows and columns, with each span replaced by its kind in brackets.

    Null texts stay null. Where spans of different kinds overlap, one bracket
    with the first span's kind covers them all. A string ``n_chars`` or other
    column keeps its value.
    """
    model = session_model(docs.sparkSession, seed)
    at = docs.columns.index(text_col)

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(rows, at, CHARS):
            part = batch.column(at).to_pylist()
            clean = [t if t is None else replace(t, spans) for t, (_, spans) in zip(part, find([t or "" for t in part], model))]
            columns = [pa.array(clean, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*names)
    return numbered.mapInArrow(scan, numbered.schema).toDF(*docs.columns)


def replace(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def op1_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the spans of every document: one row each, with base counts."""
    from pyspark.sql import functions as F

    found = detect(read_table(spark, sf_dir, "documents"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def digest(text: str | None, model: lstm_crf.Model) -> tuple[str, str]:
    """base_sha256 and spans of one text, for tests."""
    base, spans = find([text or ""], model)[0]
    return hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)
