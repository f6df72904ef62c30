"""Graded keyword matches against an enumeration of all placements, and stated cases."""

import itertools
import random

from pyspark.sql import functions as F

from marlstone.operators import keyword_match as km


def level(word, term, named=True):
    if word == term:
        return 3
    if any(c.isdigit() for c in word + term):
        return 0
    if km.stem(word) == km.stem(term) or (named and word in km.NAMES.get(term, ())):
        return 2
    same_family = word in km.FAMILY_OF and km.FAMILY_OF[word] == km.FAMILY_OF.get(term)
    return 1 if same_family or (len(km.root(term)) >= 4 and km.root(word) == km.root(term)) else 0


def plain(keyword, text, gap):
    """Tier and score by trying every placement of the terms; keywords without aliases and of two content words or more."""
    terms = [w[0] for w in km.scanned(keyword, False) if not w[3]]
    words = [(w[0], w[1], w[2]) for w in km.scanned(text, True) if not w[3]]
    held = [[p for p, (w, _, named) in enumerate(words) if level(w, t, named)] for t in terms]
    best = (0, 0)
    for at in itertools.product(*held):
        if len(set(at)) < len(at) or len({words[p][1] for p in at}) > 1 or max(at) - min(at) + 1 > len(terms) + gap:
            continue
        least = min(level(words[p][0], t, words[p][2]) for p, t in zip(at, terms))
        gaps, ordered = max(at) - min(at) + 1 - len(terms), list(at) == sorted(at)
        if least == 1:
            found = (3, 50 - 4 * gaps - 2 * (not ordered))
        elif ordered and not gaps:
            found = (7, 100) if least == 3 else (6, 92)
        else:
            found = (5, 80 - 4 * gaps) if ordered else (4, 66 - 4 * gaps)
        best = max(best, found, key=lambda b: (b[1], b[0]))
    if not best[0] and any(held):
        share = sum(bool(h) for h in held) / len(terms)
        best = (2, 35) if share == 1 else (1, max(1, int(25 * share + 0.5)))
    return best


def found(spark, texts, keywords, short=True, **more):
    t = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("key", F.lit("clash")).withColumn("row", F.lit(1))
    k = spark.createDataFrame([(x,) for x in keywords], "keyword string")
    return {(r.id, r.keyword): (r.tier, r.score, r.n) for r in km.matches(t, k, "doc", "text", "keyword", short, **more).collect()}


def test_random_texts_against_all_placements(spark):
    g = random.Random(3)
    pool = "roof roofs roofer repair repairing repaired cost costs texas TX Austin austin old the in near a1".split()
    texts = [" ".join(g.choice(pool) + g.choice(["", "", "", ",", ".", " |"]) for _ in range(g.randint(1, 14))) for _ in range(150)]
    keywords = ["roof repair", "repair cost roof", "roof in texas", "austin tx", "old old roof", "a1 roof"]
    for short, gap in ((True, 3), (False, 6)):
        got = found(spark, texts, keywords, short)
        for (d, text), keyword in itertools.product(enumerate(texts), keywords):
            want = plain(keyword, text if short else text.replace("|", " "), gap)
            if want[0]:
                assert got[d, keyword][:2] == (km.TIERS[want[0]], want[1]), (text, keyword, got.get((d, keyword)), want)
            else:
                assert (d, keyword) not in got, (text, keyword)
        whole = found(spark, texts, keywords, short, partial=False)
        assert whole == {k: v for k, v in got.items() if v[0] != "partial_terms"}


def test_stated_cases(spark):
    cases = [
        ("dentist in salem", "Salem Dentist, MA", "unordered_proximity", 66),
        ("dentist in salem", "Dentist Near You in Salem", "exact_phrase", 100),
        ("dentist salem", "Bright Dental Salem", "family_proximity", 50),
        ("dentists salem", "the dentist Salem's best", "exact_phrase_inflected", 92),
        ("dentist near me", "A dentist for all", "ordered_with_gaps", 80),
        ("dentist boston", "Our dental office in Boston", "family_proximity", 46),  # the alias lifts no tier that the family reaches
        ("realtor boston", "a real estate agent in Boston", "family_proximity", 50),  # only by its alias, so no higher
        ("realtor boston", "Boston: an agent for real or estate", "scattered_terms", 35),
        ("boston massachusetts", "Boston, MA", "exact_phrase_inflected", 92),
        ("boston massachusetts", "Boston ma belle", "partial_terms", 13),
        ("new york plumber", "NY plumber", "family_proximity", 50),
        ("ecommerce shop", "e-commerce shop", "exact_phrase_inflected", 92),
        ("main street shop", "Main St shop", "exact_phrase_inflected", 92),
        ("roof repair", "Roof. Repair", "scattered_terms", 35),
        ("roof repair", "Roof, Dr. Repair", "ordered_with_gaps", 76),
        ("roof repair", "Roof | Repair", "scattered_terms", 35),
        ("café 24", "CAFE 24", "exact_phrase", 100),
        ("to be or", "that is to be or not", "exact_phrase", 100),
        ("the", "the the", "exact_phrase", 100),
    ]
    got = found(spark, [c[1] for c in cases], {c[0] for c in cases})
    assert [(c[0], c[1], *got.get((i, c[0]), (None, 0))[:2]) for i, c in enumerate(cases)] == cases
    assert (3, "the") in got and (2, "roof repair") not in got and not any(k == "dentist near me" and "dent" not in cases[d][1].lower() for d, k in got)


def test_fields_counts_and_edges(spark):
    far = "roof one two three four five six repair"
    assert found(spark, [far], ["roof repair"], True)[0, "roof repair"] == ("scattered_terms", 35, 0)
    assert found(spark, [far], ["roof repair"], False)[0, "roof repair"] == ("ordered_with_gaps", 56, 0)  # a count's window is 3 words
    assert found(spark, ["real estate agent boston"], ["realtor boston"], False)[0, "realtor boston"][0] == "partial_terms"  # no aliases in long fields
    counted = found(spark, ["roof repair roof repair roof repair", "roof roof repair repair", "repair roof"], ["roof repair"])
    assert [counted[i, "roof repair"][2] for i in range(3)] == [3, 1, 0]
    assert found(spark, [None, "", "the", "x"], [None, "", "roof", "roof"]) == {}
    assert found(spark, ["roof " * 20_000 + "repair"], ["roof repair", "roof repair"], False)[0, "roof repair"] == ("exact_phrase", 100, 1)


def test_stems_and_roots():
    assert [km.stem(w) for w in "teeth cities boxes roofs glass plumbing planned securing axes a1s dallas ties".split()] == ["tooth", "city", "box", "roof", "glass", "plumb", "plan", "secure", "ax", "a1s", "dallas", "tie"]
    assert km.root("dentistry") == km.root("dentist") == "dent" and km.root("car") != km.root("care") and km.root("installation") == km.root("installer") == "install"
