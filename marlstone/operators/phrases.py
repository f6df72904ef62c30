"""Graded matches of keywords in texts, on columns.

A text is read as tokens in lower case without marks, stop words left out;
sentence ends and bars part it. A keyword's content words are sought at three
levels: as they are, without inflection, and by word family. Eight tiers, from
best to least: the words side by side (100), so but inflected (92), in order
with up to GAP other words between (80, less 4 for each), in any order (66,
likewise), by family (50, likewise, and 2 less out of order), all somewhere (35),
some (25 by their share), none (0).

Null and empty texts and keywords are absent. A keyword of stop words alone is
looked for as it stands. A keyword whose stop words outnumber its one content
word ("dentist near me") can't be met on a page in full, and reaches no more
than the third tier.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructType

from ..runtime import read_table
from .text import _title

GAP = 3
TIERS = ("absent", "partial", "scattered", "family_proximity", "unordered_proximity", "ordered_with_gaps", "exact_phrase_inflected", "exact_phrase")
# Words left out, and inflections no rule gives.
STOP = frozenset("a an and are at by for from here in is it me my near of on or our that the this to us we with you your".split())
IRREGULAR = {"teeth": "tooth", "feet": "foot", "children": "child", "men": "man", "women": "woman", "people": "person"}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?](?=\s|$)|[|\n]")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Without plural endings."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("ches", "shes", "sses", "xes", "zes")):
        return word[:-2]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


@lru_cache(1 << 16)
def kin(a: str, b: str) -> bool:
    """Whether two stems share most of their beginning."""
    if a == b:
        return True
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n >= 5 and n >= 0.6 * max(len(a), len(b)) and max(len(a), len(b)) - n <= 4


def tokens(text: str) -> list[list[str]]:
    """Words of each stretch between barriers, stop words included, possessives without their s."""
    plain = unicodedata.normalize("NFKD", html.unescape(text)).lower()
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    out: list[list[str]] = [[]]
    for m in TOKEN.finditer(plain):
        if m[0] in ".!?|\n":
            out.append([])
        else:
            word = re.split("['’]", m[0])
            out[-1].append(word[0] if word[1:] in (["s"], []) else "".join(word))
    return [s for s in out if s]


def spans(words: list[str], content: list[str], test) -> list[tuple[int, int, int, bool]]:
    """Gaps, start, end, in order: for each start the shortest window of at most GAP other words with all content words."""
    found = []
    need = len(content)
    for a in range(len(words)):
        if not any(test(words[a], c) for c in content):
            continue
        for b in range(a + need, min(len(words), a + need + GAP) + 1):
            part = words[a:b]
            at, used = [], set()
            for c in content:
                k = next((k for k, w in enumerate(part) if k not in used and test(w, c)), None)
                if k is None:
                    break
                used.add(k)
                at.append(k)
            else:
                found.append((b - a - need, a, b, at == sorted(at)))
                break
    return found


def match(keyword: str | None, text: str | None) -> tuple[str, int, int]:
    """Tier, score, and how often a match of the third tier or better comes, none overlapping another."""
    every = [w for s in tokens(keyword or "") for w in s]
    stretches = tokens(text or "")
    if not every or not stretches:
        return "absent", 0, 0
    content = [w for w in every if w not in STOP]
    if not content:
        hits = sum(s[i : i + len(every)] == every for s in stretches for i in range(len(s)))
        return ("exact_phrase", 100, hits) if hits else ("absent", 0, 0)
    bare = [[w for w in s if w not in STOP] for s in stretches]
    stems = [stem(c) for c in content]
    same, bent, family = (lambda w, c: w == c), (lambda w, c: stem(w) == c), (lambda w, c: kin(stem(w), c))
    best, count = (0, 0), 0
    for words in bare:
        for gaps, _, _, ordered in spans(words, content, same):
            if ordered and gaps == 0:
                best = max(best, (7, 100))
        after = 0
        for gaps, a, b, ordered in spans(words, stems, bent):
            best = max(best, (6, 92) if ordered and gaps == 0 else (5, 80 - 4 * gaps) if ordered else (4, 66 - 4 * gaps))
            if ordered and a >= after:
                count, after = count + 1, b
        if best[0] < 4:
            for gaps, _, _, ordered in spans(words, stems, family):
                best = max(best, (3, 50 - 4 * gaps - 2 * (not ordered)))
    if best[0] < 3:
        seen = {stem(w) for words in bare for w in words}
        share = sum(c in seen for c in stems) / len(stems)
        best = (2, 35) if share == 1 else (1, int(25 * share + 0.5)) if share else (0, 0)
    if len(content) == 1 and len(every) >= 3 and best[0] > 5:
        best = (5, 80)
    return TIERS[best[0]], best[1], count


@pandas_udf(StructType().add("tier", StringType()).add("score", IntegerType()).add("n", IntegerType()))
def graded(keyword: pd.Series, text: pd.Series) -> pd.DataFrame:
    """tier, score and n of keyword and text columns, in Arrow batches."""
    return pd.DataFrame([match(k, t) for k, t in zip(keyword, text)], columns=["tier", "score", "n"])


def best_match(rows: DataFrame, group: str, keyword: str, text: str) -> DataFrame:
    """group, keyword, score, tier of the best text of each group and keyword."""
    m = rows.select(group, keyword, graded(F.col(keyword), F.col(text)).alias("m"))
    return m.groupBy(group, keyword).agg(F.max("m.score").alias("score"), F.max_by("m.tier", "m.score").alias("tier"))


def keyword_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title graded against the first two words of every benchmark item with which it shares a word."""
    items = read_table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("keyword")).distinct()
    pages = read_table(spark, sf_dir, "pages").select("page_id", _title(F.col("html")).alias("title"))
    words = pages.select("page_id", "title", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("word <> ''")
    keys = items.select("keyword", F.explode(F.split(F.lower("keyword"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
    pairs = words.join(keys, "word").select("page_id", "title", "keyword").distinct()
    return pairs.select("page_id", "keyword", graded(F.col("keyword"), F.col("title")).alias("m")).select("page_id", "keyword", "m.tier", "m.score", "m.n")


QUERIES = {f.__name__: f for f in (keyword_title_match,)}
ORACLE_SQL: dict[str, str] = {}
