"""URL verdicts: rules, then word segmentation of hosts and naive Bayes.

Rules allow or block a host with its subdomains below a path; the longest that
fits wins. All other URLs are judged by multinomial naive Bayes over tokens of
host and path, learned from the URLs that rules decide. Host labels are often
words run together, so each distinct label is split by a unigram Viterbi over
words counted in all pages' HTML; only substrings that labels really have
are joined with the counts, so no lexicon is sent around. Words and labels may be of any length: words of over KEY
letters are met by their first KEY, and compared.

Null URLs and those without :// have empty host and path and are judged like
others (by the prior alone). Repeated rows count, and are returned, as often
as they come; an empty table gives an empty result; other columns are not read.
Tied scores allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, read_table

# Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
KEY, SMOOTHING = 63, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host with path) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n over all pages."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(html_col), F.lit(""))), F.lit("([a-z0-9]+)"), 1)).alias("word")
    return pages.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, cost: dict[str, float], unknown: float) -> list[str]:
    """Least-cost split; unknown words cost more for every letter, and always more than known ones. At a tie the
    last word is the longest."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    sizes = sorted({len(w) for w in cost}, reverse=True)
    cheap = 0  # the start from which an unknown word costs least, wherever it ends
    for j in range(1, len(label) + 1):
        if best[j - 1][0] - 3.0 * (j - 1) < best[cheap][0] - 3.0 * cheap:
            cheap = j - 1
        ways = [(best[cheap][0] + unknown + 3.0 * (j - cheap), cheap)]
        ways += [(best[j - k][0] + cost[label[j - k : j]], j - k) for k in sizes if k <= j and label[j - k : j] in cost]
        best.append(min(ways))
    out, j = [], len(label)
    while j:
        i = best[j][1]
        out.append(label[i:j])
        j = i
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for each distinct label."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    place = F.explode(F.sequence(F.lit(1), F.length("label"))).alias("i")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("label") - F.col("i") + 1))).alias("k")
    places = labels.filter(F.length("label") > 0).select("label", place)
    subs = places.select("label", "i", size).select("label", F.expr("substring(label, i, k)").alias("word")).distinct()
    met = subs.join(counts, "word").select("label", "word", "n")
    heads = places.filter(F.length("label") - F.col("i") >= KEY).select("label", "i", F.expr(f"substring(label, i, {KEY})").alias("head"))
    long_words = counts.filter(F.length("word") > KEY).withColumn("head", F.substring("word", 1, KEY))
    met = met.unionByName(heads.join(long_words, "head").filter("substring(label, i, length(word)) = word").select("label", "word", "n").distinct())
    known = met.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    unknown = math.log(total) + 1

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            names = batch.column(0).to_pylist()
            costs = [{x["word"]: math.log(total / x["n"]) for x in k or ()} for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([viterbi(n, c, unknown) for n, c in zip(names, costs)], pa.list_(pa.string()))], ["label", "words"])

    return labels.filter(F.length("label") > 0).join(known, "label", "left").mapInArrow(split, "label string, words array<string>")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict of every row."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    urls = materialize(parsed.groupBy("host", "path", "by_rule").agg(F.count(F.lit(1)).alias("n")))
    parts = urls.select("*", F.explode(F.split("host", "[.]")).alias("label"))
    words = materialize(segment(parts.select("label").distinct(), materialize(word_counts(pages, html_col))))
    of_host = parts.join(words, "label").select("host", "path", "by_rule", "n", F.explode("words").alias("w")).withColumn("token", F.concat(F.lit("h:"), "w")).drop("w")
    of_path = urls.select("*", F.explode(F.filter(F.split("path", "[^A-Za-z0-9]+"), lambda t: t != "")).alias("w")).withColumn("token", F.concat(F.lit("p:"), "w")).select("host", "path", "by_rule", "n", "token")
    tokens = materialize(of_host.unionByName(of_path))
    seen = lambda v: F.sum(F.when(F.col("by_rule") == v, F.col("n")).otherwise(0))
    counted = materialize(tokens.groupBy("token").agg(seen("allow").alias("a"), seen("block").alias("b")))
    t = counted.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    p = urls.agg(seen("allow"), seen("block")).first()
    vocabulary = SMOOTHING * (t[2] or 1)
    weight = F.log((F.col("a") + SMOOTHING) / ((t[0] or 0) + vocabulary)) - F.log((F.col("b") + SMOOTHING) / ((t[1] or 0) + vocabulary))
    prior = math.log(((p[0] or 0) + 1) / ((p[1] or 0) + 1))
    open_ = tokens.filter(F.col("by_rule").isNull()).select("host", "path", "token")
    scores = open_.join(counted.select("token", weight.alias("w")), "token").groupBy("host", "path").agg(F.sum("w").alias("score"))
    judged = parsed.join(scores, ["host", "path"], "left")
    ours = F.when(F.coalesce("score", F.lit(0.0)) + prior >= -1e-9, "allow").otherwise("block")
    return judged.select("id", "host", "path", "rule", F.coalesce("by_rule", ours).alias("verdict"))


def op4_url_segmentation_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
