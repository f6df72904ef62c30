"""Secrets: patterns, and a randomness test battery that adds spans.

Every whole text is scanned. Null and empty texts give no spans. Offsets are
code points, ends exclusive. Repeated rows give repeated result rows; an empty
table gives an empty result; other columns of the input are not read.

Candidates are the maximal runs of A-Za-z0-9+/_- (with = at the end) of MIN_LENGTH characters or
more that no base span touches. For each, the narrowest encoding that holds
all its characters is inferred (decimal digits are nobody's encoding: numbers are no secrets), and
three tests ask whether it is a random string of that encoding: chi-squared
for uniform use of the alphabet, in cells that language uses unevenly; a runs
test about the alphabet's middle; and the serial correlation of neighbours. The
greatest of the three scores is held against those of TRIALS seeded random
strings of the same encoding and length, so p-values of random strings are
even at every length (beyond EXACT characters, of the least length of their class, a quarter octave; beyond
BUDGET characters in all there are fewer such strings, and decoys, FEWEST at least). Letters of one case are an
encoding of their own, a capital before small ones aside.

Acceptance controls the share of false discoveries apart for each encoding and
length class. How often a string that is not random reaches a p-value is known
from DECOYS seeded names of its encoding and length (invented words, run together and in camel,
snake, kebab and path case, codes and counters), not from the candidates. If
all candidates of a class were such names, those at or above a cut would number
about the class's size times the decoys' share; the least cut is taken where
that is at most ALPHA of the candidates it accepts. Long names hardly ever
reach a middling p-value, short ones often do, so the cut falls with length; a
lone random string is accepted where fewer than ALPHA of its class's decoys
come as far. The candidates' counts are a table of at most encodings x length
classes x BINS rows, whatever the corpus.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, read_table

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH, ALPHA, BINS = 16, 0.05, 50
TRIALS, DECOYS, EXACT = 2000, 20_000, 1024
BUDGET, FEWEST, CHUNK = 50_000_000, 400, 1_000_000

ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")  # whole runs
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+={{0,2}}")
# Alphabets.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("ALNUM36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("alnum62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
)
# The letters that most of a text is made of, and parts of invented words.
COMMON = "aeinorst"
ONSETS, VOWELS, CODAS = "b c d f g h l m n p r s t v w st tr ch pr th".split(), "a e i o u ea io ou".split(), ["", "", "", "n", "r", "s", "t", "l", "nd", "st"]
INDEX = [(name, {c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in sorted(ALPHABETS, key=lambda x: len(x[1]))]  # narrowest first


def _cell(c: str) -> int:
    """Digits below and from 5, common and rare letters of either case, signs."""
    if c.isdigit():
        return int(c >= "5")
    return 6 if not c.isalpha() else 2 + 2 * c.isupper() + (c.lower() not in COMMON)


def _cells(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each character, and the share of the alphabet in each cell."""
    found = sorted({_cell(c) for c in alphabet})
    cells = np.array([found.index(_cell(c)) for c in alphabet])
    return cells, np.bincount(cells) / len(alphabet)


CELLS = {name: _cells(a) for name, a in ALPHABETS}
SIZES = {name: len(a) for name, a in ALPHABETS}

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three patterns, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def encoding_of(token: str) -> tuple[str, list[int]] | None:
    """Name and character values of the narrowest encoding; None for digits alone. A capital before small letters alone counts as small."""
    body = token.rstrip("=")
    if body.isdigit():
        return None
    if body.isalpha() and body[1:].islower():
        body = body.lower()
    chars = set(body)
    for name, index, alphabet in INDEX:
        if chars <= alphabet:
            return name, [index[c] for c in body]
    return None


def scores(values: np.ndarray, encoding: str) -> np.ndarray:
    """The greatest of the three tests' normal scores, for rows of character values."""
    n, size = values.shape[1], SIZES[encoding]
    cells, share = CELLS[encoding]
    seen = cells[values]
    counts = np.stack([(seen == c).sum(axis=1) for c in range(len(share))], axis=1)
    chi = ((counts - n * share) ** 2 / (n * share)).sum(axis=1)
    k = len(share) - 1
    top = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))  # Wilson-Hilferty
    high = 2 * values >= size
    a = high.sum(axis=1)
    mean = 1 + 2 * a * (n - a) / n
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-2)
    runs = np.abs(1 + (high[:, 1:] != high[:, :-1]).sum(axis=1) - mean) / np.sqrt(var)
    runs = np.where((a == 0) | (a == n), n, runs)
    x = values - values.mean(axis=1, keepdims=True)
    var = np.maximum((x * x).sum(axis=1), 1e-9)
    serial = np.abs((x[:, 1:] * x[:, :-1]).sum(axis=1) / var + 1 / n) * math.sqrt(n)
    return np.maximum(np.maximum(top, runs), serial)


def affordable(most: int, n: int) -> int:
    """How many strings of length n are made where ``most`` are wanted."""
    return max(min(most, FEWEST), min(most, BUDGET // max(n, 1)))


@lru_cache(1 << 12)
def random_scores(encoding: str, n: int) -> np.ndarray:
    """Sorted scores of TRIALS random strings, or as many as are affordable."""
    rng = np.random.default_rng([list(SIZES).index(encoding), n])
    trials, step = affordable(TRIALS, n), max(1, CHUNK // n)
    parts = [scores(rng.integers(0, SIZES[encoding], (min(step, trials - a), n)), encoding) for a in range(0, trials, step)]
    return np.sort(np.concatenate(parts))


def p_values(values: np.ndarray, encoding: str) -> np.ndarray:
    """Share of random strings of that length (or its class) whose score is as high or higher."""
    n = values.shape[1]
    null = random_scores(encoding, n if n <= EXACT else shortest(length_class(n)))
    return (1 + len(null) - np.searchsorted(null, scores(values, encoding))) / (len(null) + 1)


@lru_cache(1)
def _names() -> dict[str, str]:
    """Seeded streams of names for each encoding; any stretch of one is a decoy."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.choice((1, 1, 2, 2, 3))))
    digits = lambda most: str(rng.randrange(10 ** rng.randrange(1, most + 1)))
    some = lambda most, share: digits(most) if rng.random() < share else ""
    counter = lambda letters: f"{rng.randrange(1990, 2040)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}" + rng.choice(letters) * rng.randrange(1, 4) + "0" * rng.randrange(5)
    camel = lambda: (w := word()) and rng.choice((w, w.capitalize(), w.capitalize(), w.capitalize(), w.upper())) + some(2, 0.1)
    makers = {
        "hex": lambda: counter("abcdef"),
        "lower": word,
        "UPPER": lambda: word().upper(),
        "HEX": lambda: counter("ABCDEF"),
        "base32": lambda: word().upper() + "".join(c for c in some(2, 0.3) if c in "234567"),
        "alnum36": lambda: word() + some(4, 0.3),
        "ALNUM36": lambda: word().upper() + some(4, 0.3),
        "alnum62": camel,
        "base64": lambda: rng.choice((camel(), word())) + rng.choice("///+"),
        "base64url": lambda: rng.choice((word(), word(), word().upper(), camel(), digits(4))) + rng.choice("-_"),
    }
    return {name: "".join(make() for _ in range(30_000)) for name, make in makers.items()}


@lru_cache(1 << 12)
def decoy_shares(encoding: str, n: int) -> np.ndarray:
    """For each bin of p-values: the share of decoys of length n in it or above (one more is counted for safety)."""
    alphabet = ALPHABETS[list(SIZES).index(encoding)][1]
    code = np.zeros(128, np.int64)
    code[[ord(c) for c in alphabet]] = range(len(alphabet))
    stream = code[np.frombuffer(_names()[encoding].encode(), np.uint8)]
    decoys, step = affordable(DECOYS, n), max(1, CHUNK // n)
    at = np.random.default_rng(n).integers(0, len(stream), decoys)
    part = lambda some: stream[(some[:, None] + np.arange(n)) % len(stream)]
    p = np.concatenate([p_values(part(at[a : a + step]), encoding) for a in range(0, decoys, step)])
    bins = np.minimum((p * BINS).astype(int), BINS - 1)
    return (1 + np.cumsum(np.bincount(bins, minlength=BINS)[::-1])[::-1]) / (decoys + 1)


def length_class(n: int) -> int:
    """Quarter octaves of the length."""
    return int(4 * math.log2(n) + 1e-9)


def shortest(cls: int) -> int:
    """The least length of a class."""
    return math.ceil(2 ** (cls / 4) - 1e-9)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str, float]]:
    """Start, end, class (encoding and length) and p-value of each candidate."""
    out = []
    for m in CANDIDATE.finditer(text):
        if (enc := encoding_of(m[0])) and not any(m.start() < b and a < m.end() for a, _, b in base):
            out.append((m.start(), m.end(), f"{enc[0]}:{length_class(len(enc[1]))}", float(p_values(np.array([enc[1]]), enc[0])[0])))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cls", pa.string()), ("p", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and candidates with their p-values, a row per row of ``docs``."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            base = [base_spans(t or "") for t in batch.column(1).to_pylist()]
            found = [candidates(t or "", b) for t, b in zip(batch.column(1).to_pylist(), base)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[{"start": a, "kind": KINDS[k], "end": e} for a, k, e in x] for x in base], SPANS),
                    pa.array([[{"start": a, "end": e, "cls": c, "p": p} for a, e, c, p in x] for x in found], FOUND),
                ],
                ["id", "base", "found"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    types = f"id {kind}, base array<struct<start:bigint,kind:string,end:bigint>>, found array<struct<start:bigint,end:bigint,cls:string,p:double>>"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, types)


def cut_of(counts: list[int], encoding: str, cls: int, alpha: float = ALPHA) -> int | None:
    """The least accepted bin of a class with counts[b] candidates in bin b; None if there is none.

    Decoys have the class's least length, at which names come furthest.
    """
    false = sum(counts) * decoy_shares(encoding, shortest(cls))
    accepted = np.cumsum(counts[::-1])[::-1]
    good = np.flatnonzero((accepted > 0) & (false <= alpha * accepted))
    return int(good[0]) if len(good) else None


def cuts(scanned: DataFrame, alpha: float = ALPHA) -> list[tuple[str, int]]:
    """Class and least accepted p-value bin of each class that has one.

    A class's counts, at most BINS, meet its decoys in a task; the driver reads a row for each class.
    """
    c = scanned.select(F.explode("found").alias("f")).select("f.cls", F.least(F.floor(F.col("f.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = c.groupBy("cls", "bin").count().groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("n"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cls, n in zip(*(col.to_pylist() for col in batch.columns)):
                encoding, length = cls.split(":")
                n = dict(n)
                found.append((cls, cut_of([n.get(b, 0) for b in range(BINS)], encoding, int(length), alpha)))
            found = [(cls, cut) for cls, cut in found if cut is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], ["cls", "cut"])

    return sorted((r["cls"], r["cut"]) for r in counts.mapInArrow(judge, "cls string, cut int").collect())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """id, base spans and all spans (arrays of start, kind, end) of every row.

    The scan is written once to the shared folder, because the cuts need all
    its counts before any candidate is judged. The cuts are at most a few
    hundred rows (encodings x length classes); the driver reads them and puts
    them into the plan as one literal map.
    """
    scanned = materialize(scan(docs, id_col, text_col))  # the result reads it, so it isn't released here
    table = F.create_map(*[F.lit(x) for row in [("", BINS + 1), *cuts(scanned, alpha)] for x in row])
    accepted = F.transform(
        F.filter("found", lambda f: F.floor(f["p"] * BINS) >= F.coalesce(F.try_element_at(table, f["cls"]), F.lit(BINS + 1))),
        lambda f: F.struct(f["start"].alias("start"), F.lit("random").alias("kind"), f["end"].alias("end")),
    )
    order = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    by_start = F.array_sort(F.transform(F.concat("base", accepted), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = F.transform(by_start, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return scanned.select("id", "base", spans.alias("spans"))


def op2_secrets_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the spans of every document: one row each, with base counts."""
    found = detect(read_table(spark, sf_dir, "documents"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS[:3]), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
