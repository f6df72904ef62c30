"""Copy and its edits: uses of keywords and their close variants, phrases forced into it, what an edit
must keep, and how well Markdown reads.

All of it is expressions over a row's arrays of words, sentences, lines and blocks; only the order-keeping
alignment of two texts' blocks is a small function over Arrow batches. Null texts count as
empty, rows without words, blocks or phrases have defined results (stated below), repeated rows are rows of their own.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.settled import settled, spread
from ..runtime import read_table
from .text import bound

# Words that no keyword needs, questions that have the same answer everywhere and those that don't, asks that close a text.
STOP = ("in", "the", "a", "an", "of", "for", "near", "me", "and")
EVERYWHERE = r"(?i)\b(hurts?|hurting|painful|pain)\b|how long (does|will|is)|\bsafe\b|\brisks?\b|\bside effects?\b|\bwho should\b|\bcandidates?\b|\bsuitable\b|how does it (work|feel)"
LOCALLY = r"(?i)\bdo(?:es)? (?:you|your)\b|\bavailable\b|\boffere?d?\b|\bprovide[sd]?\b|\bat your\b|\bwhat types?\b|\bcan i (?:get|book|schedule)\b"
ASK = r"(?i)(?:^|[.!?;,]\s+|\b(?:and|or|then|so|to)\s+)(?:book|call|schedule|request|reserve|arrange|contact|visit|ask|start|get|find out|learn how|talk to|speak to|see)\b"
WINDOW = 8
# Shares of lost and of unmarked foreign units that an edit may have, their least letters, when a sentence restates another; openings that say nothing, instructions given back.
MOST_LOST, MOST_FOREIGN, LEAST_UNIT, LEAST_SENTENCE = 0.12, 0.05, 20, 25
SAME_WORDS, HELD_WORDS, FEW_WORDS = 0.72, 0.85, 4
FILLER = r"(?i)^(in today'?s|in this (article|post|guide)|welcome|we all know|it'?s no secret|when it comes to|there'?s no doubt|in the world of|nowadays)"
ECHO = "(?i)apply only verified, source-grounded improvements|mark every insertion|existing text verbatim"
GRADES = ((85, "Excellent"), (70, "Strong"), (55, "Fair"), (35, "Weak"), (0, "Poor"))
CUT = "\x01"


def bare(s: Column) -> Column:
    return F.trim(s, F.lit(" \t\r\n"))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


# --- keywords and their close variants


def stems(text: Column) -> Column:
    """Words in lower case, of letters a to z and digits, without a plural s."""
    words = tokens(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "))
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def needed(phrase: Column) -> Column:
    return F.filter(stems(phrase), lambda w: ~w.isin(*STOP))


def all_but_one(text: Column, phrase: Column) -> Column:
    """Is at most one of the phrase's words, and not the only one, missing from the text?"""
    own = needed(phrase)
    hits = F.size(F.filter(own, lambda w: F.array_contains(stems(text), w)))
    return (F.size(own) > 0) & (hits >= F.greatest(F.lit(1), F.size(own) - 1))


def uses(words: str, sets: str, window: int = WINDOW) -> Column:
    """How often the words (a column of stems) use each set of stems (a column of arrays): where a window
    holds all of one, the first such counts, and the search goes on after the last of its words. A window counts once.

    A window can be the first to hold a set only where the text or the search begins, which is after a word of a set, or
    where its last word is one; only these are looked at."""
    at = lambda i: F.slice(words, i + 1, F.lit(window))

    def step(acc: Column, i: Column) -> Column:
        hit = F.array_position(F.transform(sets, lambda s: (F.size(s) > 0) & F.forall(s, lambda w: F.array_contains(at(i), w))), F.lit(True))
        end = F.array_max(F.transform(F.element_at(F.col(sets), F.greatest(hit, F.lit(1)).cast("int")), lambda w: F.array_position(at(i), w)))
        counted = F.transform(acc["counts"], lambda c, k: F.when(k + 1 == hit, c + 1).otherwise(c))
        return F.when((i < acc["after"]) | (hit == 0), acc).otherwise(F.struct((i + end.cast("int")).alias("after"), counted.alias("counts")))

    start = F.struct(F.lit(0).alias("after"), F.transform(sets, lambda s: F.lit(0)).alias("counts"))
    every = F.when((F.size(words) > 0) & (F.size(sets) > 0), F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    known = F.array_distinct(F.flatten(sets))
    some = bound(known, lambda k: F.filter(every, lambda i: (i == 0) | F.array_contains(k, F.get(words, i - 1)) | F.array_contains(k, F.get(words, i + window - 1))))
    return F.aggregate(some, start, step, lambda acc: acc["counts"])


def close_variants(rows: DataFrame, text: str, phrases: str) -> DataFrame:
    """The rows with matched (the first phrase that the text has), counts (uses of each phrase) and total."""
    d = settled(rows.withColumn("_words", stems(F.col(text))).withColumn("_sets", F.transform(phrases, needed)))
    whole = lambda p, k: (F.size(F.get("_sets", k)) > 0) & (F.size(F.array_except(F.get("_sets", k), F.col("_words"))) == 0)
    d = d.withColumn("matched", F.get(F.filter(phrases, whole), F.lit(0))).withColumn("counts", uses("_words", "_sets"))
    return d.withColumn("total", F.aggregate("counts", F.lit(0), lambda a, c: a + c)).drop("_words", "_sets")


def _literal(s: Column) -> Column:
    return F.regexp_replace(s, r"([^A-Za-z0-9\s])", r"\\$1")


def forced(text: Column, phrases: Column, city: Column, brand: Column) -> Column:
    """Distinct fragments that put a phrase's word directly beside the city, other than the brand's own name with it."""
    place = F.trim(F.coalesce(city, F.lit("")))
    own = F.array_except(F.array_distinct(F.flatten(F.transform(phrases, needed))), stems(place))
    c, words = _literal(place), F.array_join(own, "|")
    masked = F.when(F.trim(F.coalesce(brand, F.lit(""))) != "", F.regexp_replace(text, F.concat(F.lit("(?i)"), _literal(F.trim(brand)), F.lit(r"\s+(?:of\s+)?"), c), F.lit(" "))).otherwise(text)
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])(?:(?:"), words, F.lit(r")[A-Za-z0-9_]*\s+"), c, F.lit("|"), c, F.lit(r"\s+(?:"), words, F.lit(r")[A-Za-z0-9_]*)(?![A-Za-z0-9_])"))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(masked, F.lit("")), pattern, 0), lambda m: F.regexp_replace(m, r"\s+", " ")))
    return F.when((place == "") | (F.size(own) == 0), F.array().cast("array<string>")).otherwise(found)


def decorated_question(question: Column, city: Column) -> Column:
    """Does the question name the city, though its answer is the same everywhere?"""
    named = F.rlike(F.lower(question), F.concat(F.lit(r"(?<![a-z0-9_])"), _literal(F.lower(F.trim(city))), F.lit(r"(?![a-z0-9_])")))
    return F.coalesce((F.trim(city) != "") & named & ~question.rlike(LOCALLY) & question.rlike(EVERYWHERE), F.lit(False))


def sentences(s: Column) -> Column:
    """Parts that end in a full stop, exclamation or question mark before white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(s, r"([.!?])\s+", f"$1{CUT}"), CUT), bare), lambda x: x != "")


def closes_with_ask(s: Column) -> Column:
    return F.coalesce(F.try_element_at(sentences(bare(s)), F.lit(-1)).rlike(ASK), F.lit(False))


# --- what an edit must keep


def compared(s: Column) -> Column:
    """Lower case, letters a to z and digits, single blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), "[^a-z0-9 ]", "")


def unmarked(edited: Column) -> Column:
    return F.regexp_replace(edited, r"(?s)\[NEW\].*?\[/NEW\]", " ")


def units(text: Column) -> Column:
    """Headings and list items without their marks, and sentences, in order."""
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda t: t != "")
    mark = r"^(#{1,6}\s+|(\d+[.)]|[-*])\s+)"
    return F.flatten(F.transform(lines, lambda t: F.when(t.rlike(mark), F.array(F.regexp_replace(t, mark, ""))).otherwise(sentences(F.regexp_replace(t, r"\s+", " ")))))


def _prose(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda t: (t != "") & ~t.rlike(r"^(#{1,6}\s|\d+[.)]|[-*|])"))
    return F.flatten(F.transform(lines, lambda t: sentences(F.regexp_replace(t, r"\s+", " "))))


def _share(all_: Column, bad) -> Column:
    return F.when(F.size(all_) == 0, 0.0).otherwise(F.size(F.filter(all_, bad)) / F.size(all_))


def bag(s: Column) -> Column:
    """Distinct words of a sentence."""
    return F.array_distinct(F.filter(F.split(compared(s), " "), lambda w: w != ""))


def restates(own: Column, others: Column) -> Column:
    """Has a sentence most of its words with one of the others? Sentences come as their bags of words."""

    def same(o: Column) -> Column:
        both, a, b = F.size(F.array_intersect(own, o)), F.size(own), F.size(o)
        return (b >= FEW_WORDS) & ((both / (a + b - both) >= SAME_WORDS) | (both / F.least(a, b) >= HELD_WORDS))

    return (F.size(own) >= FEW_WORDS) & F.exists(others, same)


def guards(pairs: DataFrame, original: str, edited: str) -> DataFrame:
    """The rows with lost and foreign (shares of the original's units that are gone, of unmarked sentences that are
    new), preserved, honest, redundant (marked sentences that restate others), cleaned (the edit without
    these), substantive (has the original prose?) and echo (are instructions given back?). Texts without units lose nothing."""
    # every text is settled before lambdas name it: an edit, its unmarked part, and units, sentences and bags as they are compared
    d = settled(pairs.withColumn("_o", F.coalesce(F.col(original), F.lit(""))).withColumn("_e", F.coalesce(F.col(edited), F.lit(""))))
    o, e = F.col("_o"), F.col("_e")
    d = settled(d.withColumn("_plain", unmarked(e)))
    d = d.withColumn("_kept", compared(F.col("_plain"))).withColumn("_from", compared(o))
    d = d.withColumn("_units", F.transform(units(o), compared)).withColumn("_said", F.transform(_prose(F.col("_plain")), compared))
    d = d.withColumn("_others", sentences(F.regexp_replace("_plain", r"\s+", " ")))
    d = d.withColumn("_new", F.filter(F.regexp_extract_all(e, F.lit(r"(?s)\[NEW\](.*?)\[/NEW\]"), 1), lambda b: ~F.contains(bare(b), F.lit("\n")) & ~bare(b).rlike(r"^(#{1,6}\s|\d+[.)]|[-*|])")))
    d = settled(d)
    long = lambda c, least: F.filter(c, lambda u: F.length(F.replace(u, F.lit(" "), F.lit(""))) >= least)
    d = d.withColumn("_units", long("_units", LEAST_UNIT)).withColumn("_said", long("_said", LEAST_SENTENCE))
    some = F.when(F.size("_new") > 0, F.transform("_others", bag))  # bags of the others, where anything is marked
    d = settled(d.withColumn("_bags", some).withColumn("_new", F.transform("_new", lambda b: F.struct(b.alias("b"), bag(bare(b)).alias("w")))))
    d = settled(d.withColumn("_again", F.transform(F.filter("_new", lambda n: restates(n["w"], F.col("_bags"))), lambda n: n["b"])))
    plain = F.filter(F.split(o, "\n"), lambda t: ~bare(t).rlike(r"^#{1,6}\s"))
    long_words = lambda t: F.filter(tokens(F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*\]\([^)]*\)", " "), "[^A-Za-z ]", " ")), lambda w: F.length(w) > 2)
    d = d.withColumn("lost", _share(F.col("_units"), lambda u: ~F.contains(F.col("_kept"), u))).withColumn("foreign", _share(F.col("_said"), lambda u: ~F.contains(F.col("_from"), u)))
    d = d.withColumn("preserved", F.col("lost") <= MOST_LOST).withColumn("honest", F.col("foreign") <= MOST_FOREIGN).withColumn("redundant", F.size("_again"))
    d = d.withColumn("cleaned", F.aggregate("_again", e, lambda t, b: F.replace(t, F.concat(F.lit("[NEW]"), b, F.lit("[/NEW]")), F.lit(""))))
    d = d.withColumn("substantive", F.exists(plain, lambda t: F.size(long_words(t)) >= 12)).withColumn("echo", e.rlike(ECHO))
    return d.drop("_o", "_e", "_plain", "_kept", "_from", "_units", "_said", "_others", "_bags", "_new", "_again")


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising run of values, not necessarily side by side."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        tails[k:], ends[k:] = ([v], [i]) if k == len(tails) else ([v, *tails[k + 1 :]], [i, *ends[k + 1 :]])
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal blocks in order: those that come once on either side and rise together, then, between
    them, equal ones from both ends."""
    once = lambda x: {v for v in set(x) if x.count(v) == 1} if len(x) < 64 else {v for v, n in pd.Series(x).value_counts().items() if n == 1}
    both = once(a) & once(b)
    place = {v: j for j, v in enumerate(b) if v in both}
    own = [i for i, v in enumerate(a) if v in both]
    fixed = [(own[k], place[a[own[k]]]) for k in longest_rise([place[a[i]] for i in own])]
    out, i0, j0 = [], 0, 0
    for i1, j1 in [*fixed, (len(a), len(b))]:
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        i2, j2, tail = i1, j1, []
        while i2 > i0 and j2 > j0 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            tail.append((i2, j2))
        out += tail[::-1]
        if i1 < len(a):
            out.append((i1, j1))
        i0, j0 = i1 + 1, j1 + 1
    return out


def aligned(a: list[str], b: list[str], marked: list[bool]) -> list[dict]:
    """What became of each block: kept; changed (half of their words or more are one another's); lost; marked; unmarked.
    Between kept blocks the first unmarked one that is alike, after those before, stands for a changed one."""
    out, i0, j0 = [], 0, 0
    for i1, j1 in [*anchors(a, b), (len(a), len(b))]:
        fresh = [j for j in range(j0, j1) if not marked[j]]
        for i in range(i0, i1):
            w = set(a[i].split())
            like = next((j for j in fresh if w and 2 * len(w & set(b[j].split())) >= len(w | set(b[j].split()))), None)
            out.append({"kind": "lost" if like is None else "changed", "original": i, "edited": like})
            if like is not None:
                out += [{"kind": "unmarked", "original": None, "edited": j} for j in fresh if j < like]
                fresh = [j for j in fresh if j > like]
        out += [{"kind": "unmarked", "original": None, "edited": j} for j in fresh]
        out += [{"kind": "marked", "original": None, "edited": j} for j in range(j0, j1) if marked[j]]
        if i1 < len(a):
            out.append({"kind": "kept", "original": i1, "edited": j1})
        i0, j0 = i1 + 1, j1 + 1
    return out


def block_changes(pairs: DataFrame, id_col: str, original: str, edited: str) -> DataFrame:
    """id, kind, original, edited: a row for each block of either text with its places. Markers open and close at block ends."""
    o, e = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(edited), F.lit(""))
    new = F.lit("\x02")
    parts = F.split(F.regexp_replace(e, r"(?s)\[NEW\](.*?)\[/NEW\]", f"{CUT}\x02$1{CUT}"), CUT)
    own = F.flatten(F.transform(parts, lambda p: F.transform(F.filter(F.transform(units(F.replace(p, new, F.lit(""))), compared), lambda u: u != ""), lambda u: F.struct(u.alias("u"), F.startswith(p, new).alias("new")))))
    rows = pairs.select(F.col(id_col).alias("id"), F.filter(F.transform(units(o), compared), lambda u: u != "").alias("a"), own.alias("b"))

    @F.pandas_udf("array<struct<kind:string,original:int,edited:int>>")
    def align(a: pd.Series, b: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([aligned(list(x), list(y), list(m)) for x, y, m in zip(a, b, new)])

    changes = align("a", F.transform("b", lambda x: x["u"]), F.transform("b", lambda x: x["new"]))
    return rows.select("id", F.explode(changes).alias("c")).select("id", "c.*")


# --- Markdown


def ramp(value: Column, low: float, high: float, most: int) -> Column:
    """0 at ``low`` to ``most`` at ``high``, rounded half up."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.lit(float(high - low))))
    return F.floor(share * most + 0.5).cast("int")


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """The rows with body (without markers), lines, kinds of lines, headings (level, text, at), paragraphs, sayings (sentences of prose)."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\[/?NEW\]", "")
    d = rows.withColumn("body", body).withColumn("lines", F.split("body", "\n"))
    kind = lambda t: (
        F.when(t == "", "blank").when(t.rlike(r"^#{1,6}\s+"), "heading").when(t.rlike(r"^\|.*\|$"), "table").when(t.rlike(r"^([-*]\s+|\d+[.)]\s+)"), "item").when(F.startswith(t, F.lit(">")), "quote").when(t.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule").otherwise("prose")
    )
    d = settled(settled(d).withColumn("kinds", F.transform("lines", lambda t: kind(bare(t)))))
    head = F.transform("lines", lambda t, i: F.struct(F.length(F.regexp_extract(bare(t), "^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_replace(bare(t), r"^#{1,6}\s+", "")).alias("text"), i.alias("at")))
    prose = F.array_join(F.transform("lines", lambda t, i: F.when(F.get("kinds", i) == "prose", bare(t)).otherwise(CUT)), " ")
    d = d.withColumn("headings", F.filter(head, lambda h: F.get("kinds", h["at"]) == "heading")).withColumn("paragraphs", F.filter(F.transform(F.split(prose, CUT), bare), lambda p: p != ""))
    ends = F.regexp_replace(F.array_join("paragraphs", " "), r"([.!?])\s+([A-Z\"“(])", f"$1{CUT}$2")
    d = settled(d)
    return d.withColumn("sayings", F.filter(F.transform(F.split(ends, CUT), bare), lambda s: F.length(s) > 1))


DIMENSIONS = ("answer", "evidence", "scannable", "structure", "faq", "readability")


def content_scores(rows: DataFrame, text: str) -> DataFrame:
    """The rows with n_words, points of the six dimensions, their total (of 100) and grade. An empty text has what no dimension asks for: 6 points for an early opening are none without one."""
    d = settled(parsed(rows, text))
    count = lambda c: F.size(tokens(c))
    d = d.withColumn("n_words", F.size(tokens(F.array_join("paragraphs", " "))))
    per1k = lambda n: n * 1000 / F.greatest(F.col("n_words"), F.lit(400))
    first = F.coalesce(F.get("paragraphs", F.lit(0)), F.lit(""))
    before = F.greatest(F.instr(F.col("body"), first) - 1, F.lit(0))
    begun = F.size(F.filter(sentences(first), lambda s: F.length(s) > 1))
    answer = F.when(first == "", 0).otherwise(ramp(150 - count(F.substring(F.col("body"), F.lit(1), before)), 0, 150, 6) + F.when(begun.between(2, 4), 5).otherwise(0) + F.when(first.rlike(FILLER), 0).otherwise(4))
    times = lambda p: F.regexp_count("body", F.lit(p))
    numbers = times(r"\b\d+(?:\.\d+)?\s?%") + times(r"\b\d+(?:,\d{3})+\b")
    citations = times(r"\([A-Za-z][^)]{2,60},\s*(?:19|20)\d{2}\)") + times(r"(?i)\baccording to\b") + times(r"\[[^\]]+\]\(https?://[^)]+\)")
    evidence = ramp(per1k(numbers), 0, 4, 10) + ramp(per1k(citations), 0, 3, 8) + ramp(times("[\"“][^\"”]{25,}[\"”]"), 0, 2, 7)
    items = F.size(F.filter("kinds", lambda k: k == "item"))
    tables = F.exists("kinds", lambda k: k == "table")
    mean = F.floor(F.aggregate("paragraphs", F.lit(0), lambda a, p: a + F.size(tokens(p))) / F.greatest(F.size("paragraphs"), F.lit(1)) + 0.5)
    scannable = ramp(per1k(items), 0, 12, 8) + F.when(tables, 7).otherwise(0) + F.when(mean == 0, 0).otherwise(ramp(120 - mean, 0, 60, 5))
    d = d.withColumn("_h2", F.transform(F.filter("headings", lambda h: h["level"] == 2), lambda h: h["at"]))
    d = settled(d)
    section = F.transform("_h2", lambda at, k: F.size(tokens(F.array_join(F.slice("lines", at + 1, F.coalesce(F.get("_h2", k + 1), F.size("lines")) - at), " "))))
    n = F.size("_h2")
    thin = F.size(F.filter(section, lambda w: w < 100))
    wanted = F.greatest(F.lit(2), F.floor(F.col("n_words") / 300 + 0.5))
    structure = F.when(n == 0, 0).otherwise(ramp(F.least(n / wanted, F.lit(1.0)), 0, 1, 8) + ramp(1 - thin / F.greatest(n, F.lit(1)), 0, 1, 7)) + F.when(F.exists("headings", lambda h: h["level"].isin(3, 4)), 5).otherwise(0)
    d = d.withColumn("_faq", F.array_position(F.transform("headings", lambda h: h["text"].rlike("(?i)faq|frequently asked")), F.lit(True)).cast("int"))
    d = settled(d)
    after = F.when(F.col("_faq") > 0, F.slice("headings", F.col("_faq") + 1, F.size("headings"))).otherwise(F.slice("headings", 1, 0))
    end = F.array_position(F.transform(after, lambda h: h["level"] <= F.get("headings", F.greatest(F.col("_faq") - 1, F.lit(0)))["level"]), F.lit(True)).cast("int")
    own = F.when(end > 0, F.slice(after, 1, F.greatest(end - 1, F.lit(0)))).otherwise(after)
    faq = F.when(F.col("_faq") > 0, 4).otherwise(0) + ramp(F.size(F.filter(own, lambda h: F.endswith(h["text"], F.lit("?")))), 0, 5, 6)
    lengths = F.transform("sayings", lambda s: F.size(tokens(s)))
    many = F.greatest(F.size("sayings"), F.lit(1))
    spoken = F.floor(F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / many + 0.5)
    readability = F.when(spoken == 0, 0).otherwise(ramp(35 - spoken, 0, 15, 6)) + F.when(F.size("sayings") == 0, 0).otherwise(ramp(1 - F.size(F.filter(lengths, lambda x: x > 30)) / many, 0.6, 1, 4))
    for name, points in zip(DIMENSIONS, (answer, evidence, scannable, structure, faq, readability)):
        d = d.withColumn(name, points.cast("int"))
    d = d.withColumn("total", sum((F.col(c) for c in DIMENSIONS[1:]), F.col("answer")))
    grade = F.lit(GRADES[-1][1])
    for least, name in reversed(GRADES):
        grade = F.when(F.col("total") >= least, name).otherwise(grade)
    return d.withColumn("grade", grade).drop("body", "lines", "kinds", "headings", "paragraphs", "sayings", "_h2", "_faq")


def coverage(text: Column) -> dict[str, Column]:
    """What a text is seen to have of what an article is reviewed for."""
    times = lambda p: F.regexp_count(text, F.lit(p))
    return {
        "table": text.rlike(r"\n\s*\|.*\|\s*\n\s*\|[\s\-:|]+\|"),
        "faq": text.rlike(r"(?i)(^|\n)#{2,3}\s+.*(faq|frequently asked)"),
        "citations": times(r"\([A-Za-z][^)]*\b(19|20)\d{2}\)") + times(r"(?i)\baccording to\b"),
        "numbers": times(r"\b\d+(\.\d+)?\s?%"),
        "quotes": times('"[^"]{15,}"') + times("“[^”]{15,}”"),
    }


# --- queries

#: Edits of documents and Markdown made of them, by expressions that Spark and DuckDB read alike.
EDITED = """CASE doc_id % 6 WHEN 1 THEN substr(text, instr(text, '. ') + 2) WHEN 2 THEN replace(text, ' the ', ' that ') WHEN 3 THEN concat(text, '\n[NEW]', substr(text, 1, instr(text, '. ')), '[/NEW]')
  WHEN 4 THEN concat(text, '\nThis sentence was slipped in without any marker at all.') WHEN 5 THEN concat('# A heading of its own\n[NEW]A sentence that nobody has read before today.[/NEW]\n', text) ELSE text END"""
MARKDOWN = """concat(CASE WHEN doc_id % 4 = 0 THEN 'In this guide we tell. ' WHEN doc_id % 4 = 1 THEN '# Title\n\n' ELSE '' END, replace(replace(text, '. The ', '.\n\n## The '), ', ', CASE WHEN doc_id % 3 = 0 THEN '\n- ' ELSE ', ' END),
  CASE WHEN doc_id % 5 = 0 THEN '\n\n## FAQ\n\n### Why?\n\nAs 45% say (Smith and others, 2020).\n\n### And how?\n\n## End\n| a | b |\n|---|---|\n| 1,000 | 2 |\n' WHEN doc_id % 5 = 1 THEN '\n> according to all\n***\n"A quotation of some length, as it should be."' ELSE '' END)"""


def _phrased(spark, sf_dir: str) -> DataFrame:
    """Documents with two phrases, a city and a brand that are words of their own."""
    d = spread(read_table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1))
    at = lambda *k: F.concat_ws(" ", *[F.get("w", F.lit(i)) for i in k])
    return d.select("doc_id", "text", F.array(at(3, 4), at(7, 8, 9)).alias("phrases"), F.coalesce(F.get("w", F.lit(5)), F.lit("")).alias("city"), F.coalesce(F.get("w", F.lit(2)), F.lit("")).alias("brand"))


def document_close_variants(spark, sf_dir):
    """How often each document uses two phrases of its own, and the first that it has."""
    d = close_variants(_phrased(spark, sf_dir), "text", "phrases")
    return d.select("doc_id", "matched", F.get("counts", F.lit(0)).alias("first"), F.get("counts", F.lit(1)).alias("second"), "total", all_but_one(F.substring("text", 1, 60), F.get("phrases", F.lit(1))).alias("nearly"))


def document_forced_phrases(spark, sf_dir):
    """Fragments of each document that put a word of its phrases directly beside its city."""
    d = _phrased(spark, sf_dir).select("doc_id", "city", F.posexplode(forced(F.col("text"), F.col("phrases"), F.col("city"), F.col("brand"))).alias("place", "fragment"))
    return d.select("doc_id", "city", "place", "fragment")


def _pairs(spark, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("original"), F.expr(EDITED).alias("edited"))


def document_edit_guards(spark, sf_dir):
    """What edits of the documents lose, slip in and restate."""
    d = guards(_pairs(spark, sf_dir), "original", "edited")
    return d.select("doc_id", "lost", "foreign", "preserved", "honest", "redundant", F.length("cleaned").alias("cleaned_chars"), "substantive", "echo", closes_with_ask(F.col("edited")).alias("asks"))


def document_block_changes(spark, sf_dir):
    """What became of each block of the documents in their edits."""
    return block_changes(_pairs(spark, sf_dir), "doc_id", "original", "edited").withColumnRenamed("id", "doc_id")


def document_content_scores(spark, sf_dir):
    """How well Markdown made of each document reads, in six dimensions."""
    d = spread(read_table(spark, sf_dir, "documents")).select("doc_id", F.expr(MARKDOWN).alias("markdown"))
    return content_scores(d, "markdown").select("doc_id", "n_words", *DIMENSIONS, "total", "grade", *[c.alias(f"has_{n}") for n, c in coverage(F.coalesce("markdown", F.lit(""))).items()])


QUERIES = {f.__name__: f for f in (document_close_variants, document_forced_phrases, document_edit_guards, document_block_changes, document_content_scores)}


_B = "chr(32) || chr(9) || chr(13) || chr(10)"


def _lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, {_B})), lambda x: x <> '')"


def _sentences(t: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_B})), lambda x: x <> '')"


def _compared(t: str) -> str:
    return f"regexp_replace(lower(trim(regexp_replace({t}, '\\s+', ' ', 'g'))), '[^a-z0-9 ]', '', 'g')"


def _stems(t: str) -> str:
    words = f"list_filter(string_split_regex(regexp_replace(lower({t}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CASE WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN substr(w, 1, length(w) - 1) ELSE w END)"


def _needed(t: str) -> str:
    return f"list_filter({_stems(t)}, lambda w: w NOT IN {STOP})"


def _ramp(value: str, low: float, high: float, most: int) -> str:
    return f"floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({value} - {low}) / {float(high - low)}::DOUBLE)) * {most} + 0.5)"


_PHRASED = f"""doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
  phrased AS (SELECT rid, doc_id, text, concat_ws(' ', w[4], w[5]) AS p1, concat_ws(' ', w[8], w[9], w[10]) AS p2, coalesce(w[6], '') AS city, coalesce(w[3], '') AS brand FROM doc),
  bag AS (SELECT *, {_stems("text")} AS st, {_needed("p1")} AS s1, {_needed("p2")} AS s2, {_stems("substr(text, 1, 60)")} AS near FROM phrased)"""
_ALL = "len({0}) > 0 AND list_has_all({1}, {0})"
_MARK = r"^(#{1,6}\s+|(\d+[.)]|[-*])\s+)"
_UNITS = f"""flatten(list_transform({_lines("{0}")}, lambda t: CASE WHEN regexp_matches(t, '{_MARK}') THEN [regexp_replace(t, '{_MARK}', '')] ELSE {_sentences("regexp_replace(t, '\\s+', ' ', 'g')")} END))"""
_BAG = f"""list_distinct(list_filter(string_split({_compared("{0}")}, ' '), lambda w: w <> ''))"""
_TIMES = "len(regexp_extract_all(body, '{0}'))"


def _many(pattern: str) -> str:
    return _TIMES.replace("{0}", pattern)


_HEADED = "list_transform(lines, lambda t, i: {'level': length(regexp_extract(trim(t, _B), '^(#{1,6})', 1)), 'text': trim(regexp_replace(trim(t, _B), '^#{1,6}\\s+', ''), _B), 'at': i})".replace("_B", _B)
_COUNT = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"

ORACLE_SQL = {
    "document_close_variants": f"""WITH RECURSIVE {_PHRASED},
      spot AS (SELECT rid, unnest(range(1, len(st) + 1)) AS i, st, s1, s2 FROM bag),
      part AS (SELECT rid, i, list_slice(st, i, i + {WINDOW - 1}) AS here, s1, s2 FROM spot),
      hit AS (SELECT rid, i, here, CASE WHEN {_ALL.format("s1", "here")} THEN 1 ELSE 2 END AS k, CASE WHEN {_ALL.format("s1", "here")} THEN s1 ELSE s2 END AS s FROM part WHERE ({_ALL.format("s1", "here")}) OR ({_ALL.format("s2", "here")})),
      ended AS (SELECT rid, i, k, i + list_max(list_transform(s, lambda w: list_position(here, w))) AS after FROM hit),
      run AS (
        SELECT rid, 1 AS after, 0 AS k, 0 AS n FROM bag
        UNION ALL
        SELECT rid, nxt, k, n FROM (SELECT r.rid, e.after AS nxt, e.k, r.n + 1 AS n, row_number() OVER (PARTITION BY r.rid ORDER BY e.i) AS o FROM run r JOIN ended e ON e.rid = r.rid AND e.i >= r.after) WHERE o = 1
      ),
      counted AS (SELECT rid, count(*) FILTER (k = 1) AS first, count(*) FILTER (k = 2) AS second FROM run GROUP BY rid)
      SELECT doc_id, CASE WHEN {_ALL.format("s1", "st")} THEN p1 WHEN {_ALL.format("s2", "st")} THEN p2 END AS matched, CAST(first AS INT) AS first, CAST(second AS INT) AS second, CAST(first + second AS INT) AS total,
        len(s2) > 0 AND len(list_filter(s2, lambda w: list_contains(near, w))) >= greatest(1, len(s2) - 1) AS nearly FROM bag JOIN counted USING (rid)""",
    "document_forced_phrases": f"""WITH {_PHRASED},
      own AS (SELECT *, list_filter(list_concat(s1, s2), lambda w: NOT list_contains({_stems("city")}, w)) AS terms, CASE WHEN brand <> '' THEN regexp_replace(text, '(?i)' || brand || '\\s+(?:of\\s+)?' || city, ' ', 'g') ELSE text END AS masked FROM bag),
      found AS (SELECT rid, doc_id, city, list_transform(regexp_extract_all(masked, '(?i)\\b(?:(?:' || array_to_string(terms, '|') || ')\\w*\\s+' || city || '|' || city || '\\s+(?:' || array_to_string(terms, '|') || ')\\w*)\\b'), lambda m: regexp_replace(m, '\\s+', ' ', 'g')) AS f FROM own WHERE city <> '' AND len(terms) > 0),
      each AS (SELECT rid, doc_id, city, unnest(f) AS fragment, unnest(range(len(f))) AS k FROM found),
      once AS (SELECT rid, doc_id, city, fragment, min(k) AS k FROM each GROUP BY ALL)
      SELECT doc_id, city, CAST(row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS INT) AS place, fragment FROM once""",
    "document_edit_guards": f"""WITH pair AS (SELECT doc_id, coalesce(text, '') AS o, coalesce({EDITED}, '') AS e FROM documents),
      un AS (SELECT *, regexp_replace(e, '(?s)\\[NEW\\].*?\\[/NEW\\]', ' ', 'g') AS u FROM pair),
      part AS (
        SELECT *, {_compared("u")} AS kept, {_compared("o")} AS source, list_filter({_UNITS.replace("{0}", "o")}, lambda x: length(replace({_compared("x")}, ' ', '')) >= {LEAST_UNIT}) AS units,
          list_filter(flatten(list_transform(list_filter({_lines("u")}, lambda t: NOT regexp_matches(t, '^(#{{1,6}}\\s|\\d+[.)]|[-*|])')), lambda t: {_sentences("regexp_replace(t, '\\s+', ' ', 'g')")})), lambda x: length(replace({_compared("x")}, ' ', '')) >= {LEAST_SENTENCE}) AS said,
          {_sentences("regexp_replace(u, '\\s+', ' ', 'g')")} AS others,
          list_filter(regexp_extract_all(e, '(?s)\\[NEW\\](.*?)\\[/NEW\\]', 1), lambda b: NOT contains(trim(b, {_B}), chr(10)) AND NOT regexp_matches(trim(b, {_B}), '^(#{{1,6}}\\s|\\d+[.)]|[-*|])')) AS fresh FROM un
      ),
      again AS (
        SELECT *, list_filter(fresh, lambda b: len({_BAG.replace("{0}", "b")}) >= {FEW_WORDS} AND len(list_filter(others, lambda x: len({_BAG.replace("{0}", "x")}) >= {FEW_WORDS} AND (
          len(list_intersect({_BAG.replace("{0}", "b")}, {_BAG.replace("{0}", "x")})) / (len({_BAG.replace("{0}", "b")}) + len({_BAG.replace("{0}", "x")}) - len(list_intersect({_BAG.replace("{0}", "b")}, {_BAG.replace("{0}", "x")}))) >= {SAME_WORDS}::DOUBLE
          OR len(list_intersect({_BAG.replace("{0}", "b")}, {_BAG.replace("{0}", "x")})) / least(len({_BAG.replace("{0}", "b")}), len({_BAG.replace("{0}", "x")})) >= {HELD_WORDS}::DOUBLE))) > 0) AS again,
          CASE WHEN len(units) = 0 THEN 0.0 ELSE len(list_filter(units, lambda x: NOT contains(kept, {_compared("x")}))) / len(units) END AS lost, CASE WHEN len(said) = 0 THEN 0.0 ELSE len(list_filter(said, lambda x: NOT contains(source, {_compared("x")}))) / len(said) END AS foreign_ FROM part
      )
      SELECT doc_id, CAST(lost AS DOUBLE) AS lost, CAST(foreign_ AS DOUBLE) AS foreign, lost <= {MOST_LOST}::DOUBLE AS preserved, foreign_ <= {MOST_FOREIGN}::DOUBLE AS honest, len(again) AS redundant,
        CAST(length(e) - coalesce(list_sum(list_transform(list_distinct(again), lambda b: (length(e) - length(replace(e, '[NEW]' || b || '[/NEW]', ''))))), 0) AS BIGINT) AS cleaned_chars,
        len(list_filter(string_split(o, chr(10)), lambda t: NOT regexp_matches(trim(t, {_B}), '^#{{1,6}}\\s') AND len(list_filter(string_split_regex(regexp_replace(regexp_replace(t, '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '[^A-Za-z ]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)) >= 12)) > 0 AS substantive,
        regexp_matches(e, '{ECHO}') AS echo, coalesce(regexp_matches(list_extract({_sentences(f"trim(e, {_B})")}, -1), '{ASK}'), false) AS asks FROM again""",
    "document_content_scores": f"""WITH made AS (SELECT doc_id, coalesce({MARKDOWN}, '') AS markdown FROM documents),
      body AS (SELECT doc_id, markdown, regexp_replace(markdown, '\\[/?NEW\\]', '', 'g') AS body FROM made),
      line AS (SELECT *, string_split(body, chr(10)) AS lines FROM body),
      kind AS (SELECT *, list_transform(lines, lambda t: CASE WHEN trim(t, {_B}) = '' THEN 'blank' WHEN regexp_matches(trim(t, {_B}), '^#{{1,6}}\\s+') THEN 'heading' WHEN regexp_matches(trim(t, {_B}), '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(trim(t, {_B}), '^([-*]\\s+|\\d+[.)]\\s+)') THEN 'item'
        WHEN starts_with(trim(t, {_B}), '>') THEN 'quote' WHEN regexp_matches(trim(t, {_B}), '^(-{{3,}}|\\*{{3,}}|_{{3,}})$') THEN 'rule' ELSE 'prose' END) AS kinds FROM line),
      piece AS (SELECT *, list_filter({_HEADED}, lambda h: kinds[h.at] = 'heading') AS headings,
        list_filter(list_transform(string_split(array_to_string(list_transform(lines, lambda t, i: CASE WHEN kinds[i] = 'prose' THEN trim(t, {_B}) ELSE chr(1) END), ' '), chr(1)), lambda p: trim(p, {_B})), lambda p: p <> '') AS paragraphs FROM kind),
      said AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(array_to_string(paragraphs, ' '), '([.!?])\\s+([A-Z"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x, {_B})), lambda x: length(x) > 1) AS sayings, {_COUNT.replace("{0}", "array_to_string(paragraphs, ' ')")} AS n_words,
        coalesce(paragraphs[1], '') AS first, list_transform(list_filter(headings, lambda h: h.level = 2), lambda h: h.at) AS h2, list_position(list_transform(headings, lambda h: regexp_matches(h.text, '(?i)faq|frequently asked')), true) AS fq FROM piece),
      more AS (SELECT *, greatest(n_words, 400) AS base, list_filter({_sentences("first")}, lambda x: length(x) > 1) AS begun, list_transform(sayings, lambda x: {_COUNT.replace("{0}", "x")}) AS lengths,
        list_transform(h2, lambda a, k: {_COUNT.replace("{0}", "array_to_string(list_slice(lines, a, CASE WHEN k < len(h2) THEN h2[k + 1] - 1 ELSE len(lines) END), ' ')")}) AS sections, CASE WHEN coalesce(fq, 0) > 0 THEN list_slice(headings, fq + 1, len(headings)) ELSE [] END AS below,
        floor(coalesce(list_sum(list_transform(paragraphs, lambda p: {_COUNT.replace("{0}", "p")})), 0) / greatest(len(paragraphs), 1) + 0.5) AS mean FROM said),
      last AS (SELECT *, coalesce(list_position(list_transform(below, lambda h: h.level <= headings[fq].level), true), 0) AS stop, floor(coalesce(list_sum(lengths), 0) / greatest(len(sayings), 1) + 0.5) AS spoken, len(list_filter(sections, lambda x: x < 100)) AS thin FROM more),
      dims AS (
        SELECT *, CASE WHEN first = '' THEN 0 ELSE {_ramp(f"150 - {_COUNT.replace('{0}', 'substr(body, 1, greatest(strpos(body, first) - 1, 0))')}", 0, 150, 6)} + CASE WHEN len(begun) BETWEEN 2 AND 4 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(first, '{FILLER.replace("'", "''")}') THEN 0 ELSE 4 END END AS answer,
          {_ramp(f"({_many(chr(92) + 'b' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?' + chr(92) + 's?%')} + {_many(chr(92) + 'b' + chr(92) + 'd+(?:,' + chr(92) + 'd{3})+' + chr(92) + 'b')}) * 1000 / base", 0, 4, 10)}
            + {_ramp(f"({_many(r'\([A-Za-z][^)]{2,60},\s*(?:19|20)\d{2}\)'.replace(chr(92) * 2, chr(92)))} + {_many(r'(?i)\baccording to\b'.replace(chr(92) * 2, chr(92)))} + {_many(r'\[[^\]]+\]\(https?://[^)]+\)'.replace(chr(92) * 2, chr(92)))}) * 1000 / base", 0, 3, 8)} + {_ramp(_many('["“][^"”]{25,}["”]'), 0, 2, 7)} AS evidence,
          {_ramp("len(list_filter(kinds, lambda k: k = 'item')) * 1000 / base", 0, 12, 8)} + CASE WHEN list_contains(kinds, 'table') THEN 7 ELSE 0 END + CASE WHEN mean = 0 THEN 0 ELSE {_ramp("120 - mean", 0, 60, 5)} END AS scannable,
          CASE WHEN len(h2) = 0 THEN 0 ELSE {_ramp("least(len(h2) / greatest(2, floor(n_words / 300 + 0.5)), 1.0::DOUBLE)", 0, 1, 8)} + {_ramp("1 - thin / greatest(len(h2), 1)", 0, 1, 7)} END + CASE WHEN len(list_filter(headings, lambda h: h.level IN (3, 4))) > 0 THEN 5 ELSE 0 END AS structure,
          CASE WHEN coalesce(fq, 0) > 0 THEN 4 ELSE 0 END + {_ramp("len(list_filter(CASE WHEN stop > 0 THEN list_slice(below, 1, stop - 1) ELSE below END, lambda h: suffix(h.text, '?')))", 0, 5, 6)} AS faq,
          CASE WHEN spoken = 0 THEN 0 ELSE {_ramp("35 - spoken", 0, 15, 6)} END + CASE WHEN len(sayings) = 0 THEN 0 ELSE {_ramp("1 - len(list_filter(lengths, lambda x: x > 30)) / greatest(len(sayings), 1)", 0.6, 1, 4)} END AS readability FROM last
      ),
      summed AS (SELECT *, answer + evidence + scannable + structure + faq + readability AS total FROM dims)
      SELECT doc_id, n_words, {", ".join(f"CAST({c} AS INT) AS {c}" for c in (*DIMENSIONS, "total"))}, CASE {" ".join(f"WHEN total >= {least} THEN '{name}'" for least, name in GRADES)} END AS grade,
        regexp_matches(markdown, '\\n\\s*\\|.*\\|\\s*\\n\\s*\\|[\\s\\-:|]+\\|') AS has_table, regexp_matches(markdown, '(?i)(^|\\n)#{{2,3}}\\s+.*(faq|frequently asked)') AS has_faq,
        len(regexp_extract_all(markdown, '\\([A-Za-z][^)]*\\b(19|20)\\d{{2}}\\)')) + len(regexp_extract_all(markdown, '(?i)\\baccording to\\b')) AS has_citations, len(regexp_extract_all(markdown, '\\b\\d+(\\.\\d+)?\\s?%')) AS has_numbers, len(regexp_extract_all(markdown, '"[^"]{{15,}}"')) + len(regexp_extract_all(markdown, '“[^”]{{15,}}”')) AS has_quotes FROM summed""",
}
