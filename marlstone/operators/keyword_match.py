"""Keywords in texts, graded by how closely their words stand together, as a join of words.

Texts and keywords are read as words in lower case without marks; stop words are
left out, but keep nothing apart. Every word has keys: itself, its stem, the
other names of what it stands for (states, street words), its family (trades,
derivations). Texts' words meet keywords' words by equal keys, never by a stop word, and only
what meets is brought together, by text and keyword, as places; the
grading sees no text. A place holds at level 3 for the word itself, 2 for its stem or
another name, 1 for its family.

Tiers: all words side by side and as they are (100); so, but inflected (92); in
order within a window of G other words (80, less 4 for each); in any order (66,
likewise); by family (50, likewise, and 2 less out of order); all in the text
(35); some (25 by their share); pairs that share nothing have no row. G is 3 in
short fields and 6 in long ones; sentence ends, and bars in short fields, end a window. In short fields a
keyword's phrase aliases are sought as well; they count where they lift the tier, and never
above the family tier. A keyword of one content word among three or more reaches the third tier at most.
Beside the best match stands how often the keyword comes in order, none overlapping another.

Null and empty texts and keywords have no rows. A keyword of stop words alone matches as it stands or not at all.
Repeated keywords count once, repeated text rows are rows of their own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parts import PART, parts  # noqa: F401
from ..functions.settled import spread
from ..runtime import materialize, read_table
from .text import _title

# Tiers with their scores, words left out, irregular forms, words that only look like plurals, endings of derived words.
TIERS = ("absent", "partial_terms", "scattered_terms", "family_proximity", "unordered_proximity", "ordered_with_gaps", "exact_phrase_inflected", "exact_phrase")
FAMILY, ORDERED = 3, 5
STOP = frozenset("a an the in on at of for to and or with by from near nearby me my our your you is are was were be this that".split())
IRREGULAR = dict(p.split(":") for p in "teeth:tooth feet:foot children:child men:man women:woman people:person analyses:analysis crises:crisis bases:basis theses:thesis diagnoses:diagnosis prostheses:prosthesis indices:index appendices:appendix vertices:vertex".split())
NO_PLURAL = frozenset(
    "analysis address business bus gas texas kansas arkansas dallas vegas news series species dentures braces less plus glass class across process access success status campus virus focus crisis basis thesis prosthesis arthritis gingivitis periodontitis orthodontics pediatrics ceramics athletics always".split()
)
ENDINGS = "istry ician ology istic ational ation ically ical ement ment ness ance ence tion sion able ible ship hood ist ics ing ery ary ory ant ent ive ize ise ify yer ic al ly er or".split()
# Families of trades, states by code, name and older abbreviation, states of several words, street words, phrase aliases.
FAMILIES = {
    "dent": "dentist dentists dental dentistry dds dmd", "physician": "doctor doctors physician physicians md", "legal": "lawyer lawyers attorney attorneys legal law counsel",
    "insure": "insurance insurer insurers insure insured", "realty": "realtor realtors realty", "hvac": "ac hvac", "plumb": "plumber plumbers plumbing",
}
STATES = (
    "al alabama ala, ak alaska, az arizona ariz, ar arkansas ark, ca california calif, co colorado colo, ct connecticut conn, de delaware del, fl florida fla, ga georgia, hi hawaii, id idaho, il illinois ill, in indiana ind, ia iowa, ks kansas kan, ky kentucky, la louisiana, "
    "me maine, md maryland, ma massachusetts mass, mi michigan mich, mn minnesota minn, ms mississippi miss, mo missouri, mt montana mont, ne nebraska neb, nv nevada nev, oh ohio, ok oklahoma okla, or oregon ore, pa pennsylvania penn, tn tennessee tenn, tx texas, ut utah, vt vermont, "
    "va virginia, wa washington wash, wi wisconsin wis, wy wyoming wyo"
)
LONG_STATES = "nh new hampshire, nj new jersey, nm new mexico, ny new york, nc north carolina, nd north dakota, ri rhode island, sc south carolina, sd south dakota, wv west virginia, dc district of columbia"
STREETS = "dr doctor, st street, st saint, ave avenue, blvd boulevard, rd road, mt mount, ft fort"
PHRASES = "dentist: dental office, dentist: dental practice, dentist: dental clinic, realtor: real estate agent, ac: air conditioning, nyc: new york city"
NO_STOP_AFTER = frozenset("dr mr mrs ms st ave inc ltd no vs approx e g i".split())
MOST_ALIASES = 8
SHORT_GAP, LONG_GAP, COUNT_GAP = 3, 6, 3

_WORD = re.compile(r"[^\W_]+")
_END, _BARS, _PARAGRAPH, _ABBREVIATED = re.compile(r"[.!?;:](\s|$)"), re.compile("[|•·—–]"), re.compile(r"\n[ \t]*\n"), re.compile(r"\s*\.\s*")
_INVISIBLE = re.compile("[​-‍﻿­]")


def _names() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for group in (*STATES.split(", "), *STREETS.split(", ")):
        for a in group.split():
            out.setdefault(a, set()).update(b for b in group.split() if b != a)
    return out


NAMES = _names()
FAMILY_OF = {w: f for f, ws in FAMILIES.items() for w in ws.split()}
CODES = {s.split()[0] for s in (*STATES.split(", "), *LONG_STATES.split(", "))}
OLDER = {s.split()[2] for s in STATES.split(", ") if len(s.split()) > 2}
ALIASES = [(a.split(), b.split()) for a, b in (p.split(": ") for p in PHRASES.split(", "))]
ALIASES += [pair for s in LONG_STATES.split(", ") for pair in ((s.split()[:1], s.split()[1:]), (s.split()[1:], s.split()[:1]))]


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Without the endings of plurals and verbs."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 3 or any(c.isdigit() for c in word) or word in NO_PLURAL:
        return word
    if word.endswith("ies") and len(word) > 4:
        word = word[:-3] + "y"
    elif re.search("(ch|sh|x|z|s|o)es$", word):
        word = word[:-2]
    elif re.search("[^su]s$", word):
        word = word[:-1]
    if word in IRREGULAR or word in NO_PLURAL or len(word) <= 3:
        return IRREGULAR.get(word, word)
    ending = next((e for e in ("ing", "ed") if word.endswith(e)), "")
    rest = word[: len(word) - len(ending)]
    if not ending or len(rest) < 4 or not re.search("[aeiouy]", rest):
        return word
    if re.search(r"([bdgkmnprt])\1$", rest):
        return rest[:-1]
    return rest + "e" if re.search("(ur|ac|is|os|as|ov|iv|iz|bl)$", rest) else rest


@lru_cache(1 << 16)
def root(word: str) -> str:
    """The stem without up to two endings of derivation, each leaving four letters and a vowel."""
    word = stem(word)
    if any(c.isdigit() for c in word):
        return word
    for _ in range(2):
        cut = next((word[: -len(e)] for e in sorted(ENDINGS, key=lambda e: (-len(e), ENDINGS.index(e))) if word.endswith(e) and len(word) - len(e) >= 4 and re.search("[aeiouy]", word[: -len(e)])), None)
        if cut is None:
            break
        word = cut
    return word[:-1] if len(word) >= 5 and word.endswith("e") else word


def scanned(text: str, short: bool) -> list[tuple[str, int, bool, bool, bool]]:
    """Words with their stretch between barriers, whether another name may stand for them, whether they are
    stop words, and whether a hyphen or apostrophe binds them to the next one."""
    plain = re.sub("[   ]", " ", _INVISIBLE.sub("", html.unescape(text)))
    out: list[list] = []
    stretch = last = 0
    for m in _WORD.finditer(plain):
        gap, raw = plain[last : m.start()], m[0]
        word = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).lower()
        last = m.end()
        if out and word == "s" and gap in ("'", "’"):
            continue
        abbreviated = out and out[-1][0] in NO_STOP_AFTER and _ABBREVIATED.fullmatch(gap)
        if out and ((_END.search(gap + " ") if gap.strip() else None) and not abbreviated or (short and _BARS.search(gap)) or _PARAGRAPH.search(gap)):
            stretch += 1
        if out:
            out[-1][4] = gap in ("-", "'", "’", "‑")
        upper = raw == raw.upper() and raw != raw.lower()
        named = not (len(word) <= 2 and word in CODES and not upper) and not (word in OLDER and not raw[:1].isupper())
        out.append([word, stretch, named, word in STOP, False])
    return [tuple(w) for w in out]


def keys(word: str) -> list[tuple[str, int]]:
    """Keys of a word and the levels at which a text's word holds by them; other names apart."""
    if any(c.isdigit() for c in word):
        return [("n:" + word, 3)]
    out = [("n:" + word, 3), ("s:" + stem(word), 2)]
    if word in FAMILY_OF:
        out.append(("f:" + FAMILY_OF[word], 1))
    if len(root(word)) >= 4:
        out.append(("r:" + root(word), 1))
    return out


def text_keys(text: str, short: bool) -> list[dict]:
    """Every key of a text's content words and pairs of bound ones, with level, place and stretch; stop words by w: and their place among all words."""
    out, place = [], 0
    words = scanned(text, short)
    for i, (word, stretch, named, stop, bound) in enumerate(words):
        if stop:
            out.append({"key": "w:" + word, "level": 3, "place": i, "stretch": stretch})
            continue
        digits = any(c.isdigit() for c in word)
        own = keys(word) + ([("x:" + word, 2)] if named and not digits and word in NAMES else [])
        for a, b in ((i, i + 1), (i - 1, i)):  # bound words also are one word, at either's place
            if a >= 0 and b < len(words) and words[a][4] and not (words[a][3] or words[b][3]):
                own += [(k, 2) for k, v in keys(words[a][0] + words[b][0]) if v >= 2]
        out += [{"key": k, "level": v, "place": place, "stretch": stretch} for k, v in own]
        place += 1
    return out


def variants(content: list[str]) -> list[list[str]]:
    """The content words with one phrase alias put in, up to MOST_ALIASES ways."""
    out = []
    for old, new in ALIASES:
        for i in range(len(content) - len(old) + 1):
            if content[i : i + len(old)] == old and len(out) < MOST_ALIASES:
                out.append(content[:i] + [w for w in new if w not in STOP] + content[i + len(old) :])
    return out


def keyword_keys(keyword: str) -> list[dict]:
    """Every key of a keyword's terms, for each of its variants (0 is the keyword itself; -1 one of stop words alone)."""
    words = [w[0] for w in scanned(keyword, False)]
    content = [w for w in words if w not in STOP]
    if not content:
        return [{"variant": -1, "terms": len(words), "limit": 7, "term": i, "key": "w:" + w} for i, w in enumerate(words)]
    limit = ORDERED if len(content) == 1 and len(words) >= 3 else 7
    out = []
    for k, terms in enumerate([content, *variants(content)]):
        for i, w in enumerate(terms):
            digits = any(c.isdigit() for c in w)
            own = {key for key, _ in keys(w)} | (set() if digits else {"x:" + n for n in NAMES.get(w, ())})
            out += [{"variant": k, "terms": len(terms), "limit": min(limit, FAMILY) if k else limit, "term": i, "key": key} for key in sorted(own)]
    return out


def in_order(held: list[tuple[int, list[int]]], terms: int, level: int, most: int) -> int | None:
    """Where the terms end, in order and each as early as can be, from the first place on and at most ``most`` places on."""
    want = 0
    for place, levels in held:
        if place - held[0][0] > most:
            return None
        if levels[want] >= level:
            want += 1
            if want == terms:
                return place
        elif want == 0:
            return None
    return None


def in_any_order(held: list[tuple[int, list[int]]], terms: int, level: int, most: int) -> int | None:
    """Where the shortest window from the first place on ends in which every term has a place of its own."""
    owner: dict[int, int] = {}  # of a term, the place that holds it

    def give(k: int, seen: set[int]) -> bool:
        for t in range(terms):
            if held[k][1][t] >= level and t not in seen:
                seen.add(t)
                if t not in owner or give(owner[t], seen):
                    owner[t] = k
                    return True
        return False

    for k, (place, _) in enumerate(held):
        if place - held[0][0] > most:
            return None
        give(k, set())
        if len(owner) == terms:
            return place
    return None


def places(hits: list[tuple[int, int, int, int]], terms: int) -> dict[int, list[tuple[int, list[int]]]]:
    """By stretch, the places in order with the best level of each term there."""
    found: dict[tuple[int, int], list[int]] = {}
    for place, stretch, term, level in hits:
        own = found.setdefault((stretch, place), [0] * terms)
        own[term] = max(own[term], level)
    out: dict[int, list] = {}
    for stretch, place in sorted(found):
        out.setdefault(stretch, []).append((place, found[stretch, place]))
    return out


def best_of(held: list[tuple[int, list[int]]], terms: int, gap: int) -> tuple[int, int, int]:
    """Tier, score and last place of the best match that begins at the first place; tier 0 where none does."""
    best, begin, most = (0, 0, 0), held[0][0], terms + gap - 1
    for level in (3, 2, 1):
        end = in_order(held, terms, level, most)
        if end is not None:
            gaps = end - begin + 1 - terms
            tier, score = (FAMILY, 50 - 4 * gaps) if level == 1 else (7 if level == 3 else 6, 100 if level == 3 else 92) if gaps == 0 else (ORDERED, 80 - 4 * gaps)
            best = max(best, (tier, score, end), key=lambda b: b[1])
        if terms > 1 and level < 3 and (end := in_any_order(held, terms, level, most)) is not None:
            gaps = end - begin + 1 - terms
            best = max(best, (4, 66 - 4 * gaps, end) if level == 2 else (FAMILY, 48 - 4 * gaps, end), key=lambda b: b[1])
    return best


def grade(hits: list[tuple[int, int, int, int]], terms: int, gap: int, limit: int) -> tuple[int, int, int]:
    """Tier, score and count of the hits (place, stretch, term, level) of one text, keyword and variant, every term among them."""
    best, count = (0, 0), 0
    for held in places(hits, terms).values():
        after = -1
        for k in range(len(held)):
            if held[k][0] <= after:
                at_least = None
            else:
                at_least = best_of(held[k:], terms, COUNT_GAP)
            tier, score, end = best_of(held[k:], terms, gap)
            best = max(best, (tier, score), key=lambda b: (b[1], b[0]))
            if at_least and at_least[0] >= ORDERED:
                count, after = count + 1, at_least[2]
    best = best if best[0] else (2, 35)
    if best[0] > limit:
        held = 50 if best[0] > ORDERED else best[1] - (30 if best[0] == ORDERED else 18)
        best = (limit, 80) if limit == ORDERED else (FAMILY, held)
    return *best, count


HITS = "array<struct<place:int,stretch:int,term:int,level:int>>"
def matches(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, keyword_col: str, short: bool, partial: bool = True) -> DataFrame:
    """id, keyword, tier, score, n of every text and keyword that share a term; all terms, without ``partial``."""
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbered = spread(numbered)
    key = pa.struct([("key", pa.string()), ("level", pa.int32()), ("place", pa.int32()), ("stretch", pa.int32())])
    term = pa.struct([("variant", pa.int32()), ("terms", pa.int32()), ("limit", pa.int32()), ("term", pa.int32()), ("key", pa.string())])

    def scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, pc.utf8_length(whole.column(2)).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text_keys(t, short) for t in batch.column(2).to_pylist()], pa.list_(key))], ["row", "id", "keys"])

    def scan_keywords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keyword_keys(k) for k in batch.column(0).to_pylist()], pa.list_(term))], ["keyword", "keys"])

    id_type = texts.schema[id_col].dataType.simpleString()
    words = numbered.mapInArrow(scan_texts, f"row bigint, id {id_type}, keys array<struct<key:string,level:int,place:int,stretch:int>>").select("row", "id", F.explode("keys").alias("t")).select("row", "id", "t.*")
    distinct = keywords.select(F.col(keyword_col).cast("string").alias("keyword")).filter("keyword IS NOT NULL").distinct()
    terms = distinct.mapInArrow(scan_keywords, "keyword string, keys array<struct<variant:int,terms:int,limit:int,term:int,key:string>>").select("keyword", F.explode("keys").alias("k")).select("keyword", "k.*")
    if not short:
        terms = terms.filter("variant <= 0")
    terms = materialize(terms)
    own = ["row", "id", "keyword", "variant", "terms", "limit"]
    met = words.join(terms, "key").groupBy(*own).agg(F.collect_set(F.struct("place", "stretch", "term", "level")).alias("hits"))
    met = met.withColumn("have", F.size(F.array_distinct(F.transform("hits", lambda h: h["term"]))))
    gap = SHORT_GAP if short else LONG_GAP

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, pc.list_value_length(whole.column("hits")).to_pylist())):
            graded = []
            for variant, terms, limit, hits in zip(*(batch.column(c).to_pylist() for c in ("variant", "terms", "limit", "hits"))):
                own = [(h["place"], h["stretch"], h["term"], h["level"]) for h in hits]
                tier, score, n = grade(own, terms, 0 if variant < 0 else gap, limit)
                graded.append((0, 0, 0) if variant < 0 and tier < 7 else (tier, score, n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "keyword", "variant")), *[pa.array([g[i] for g in graded], pa.int32()) for i in range(3)]], ["row", "id", "keyword", "variant", "tier", "score", "n"])

    judged = met.filter("have = terms").mapInArrow(judge, f"row bigint, id {id_type}, keyword string, variant int, tier int, score int, n int").filter("tier > 0")
    if partial:
        share = F.greatest(F.lit(1), F.floor(25 * F.col("have") / F.col("terms") + 0.5).cast("int"))
        some = met.filter("have < terms AND variant >= 0").select("row", "id", "keyword", "variant", F.lit(1).alias("tier"), share.alias("score"), F.lit(0).alias("n"))
        judged = judged.unionByName(some)
    # of the keyword and its variants the highest tier, the keyword itself if none is higher; the count is the keyword's own
    best = judged.groupBy("row", "id", "keyword").agg(F.max(F.struct("tier", (F.col("variant") <= 0).alias("own"), "score")).alias("b"), F.coalesce(F.max(F.when(F.col("variant") <= 0, F.col("n"))), F.lit(0)).alias("n"))
    return best.select("id", "keyword", F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("b.tier")).alias("tier"), F.col("b.score").alias("score"), "n")


def page_text(markup: Column) -> Column:
    """Words of a page's body, blocks as paragraphs."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style|title|nav|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)</?(p|div|h[1-6]|li|article|body)\b[^>]*>", "\n\n"), "<[^>]*>", " ")


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and three words in a row of benchmark items, and one with stop words around it."""
    words = read_table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))
    rows = F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 4, 3), " "), F.concat(F.get("w", F.lit(5)), F.lit(" near me")))
    return words.select(F.explode(rows).alias("keyword"))


def keyword_in_titles(spark, sf_dir):
    """Benchmark keywords graded in page titles, a short field."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", _title(F.col("html")).alias("title"))
    return matches(pages, _keywords(spark, sf_dir), "page_id", "title", "keyword", True).withColumnRenamed("id", "page_id")


def keyword_in_bodies(spark, sf_dir):
    """Benchmark keywords of which a page's body, a long field, has every word, graded."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("body"))
    return matches(pages, _keywords(spark, sf_dir), "page_id", "body", "keyword", False, partial=False).withColumnRenamed("id", "page_id")


QUERIES = {f.__name__: f for f in (keyword_in_titles, keyword_in_bodies)}
ORACLE_SQL: dict[str, str] = {}
