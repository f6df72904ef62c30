"""Quality rules with verdicts by host, in DataFrame operations only.

Counts come from every whole text. Words are runs of characters other than
space and U+0009..U+000D. Null and empty texts have no words (and so fail).
Repeated rows are judged, and counted for their host, as often as they come;
an empty table gives an empty result. A null host is a host of its own.

Beside the base rules, softer rules are counted by host. The failure rate of a
rule at a host is shrunk towards all hosts by a beta prior, (failures + a) /
(documents + a + b), fitted by moments: its mean is the rate over all rows, its
variance what the hosts' rates vary by beyond the chance of their numbers of
documents (if nothing, all hosts have the mean). A host's verdict on a soft
rule is that it breaks it by habit where the shrunk rate is above that of all hosts by SURE standard deviations of
its posterior, and HOST_LIMIT at least: hosts are told from one another, and where they don't differ none has a habit.
Documents that break a soft rule which their host breaks by habit go, while a
slip at a host that keeps the rule as others do is let pass. Documents that break no rule
always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, read_table

MIN_WORDS, MAX_REPEAT = 50, 50  # base rules: words, per cent of repeated ones
SOFT_SYMBOLS, SOFT_DUP_LINES, SOFT_REPEAT = 10, 30, 30  # per cent of words, of lines, of words
HOST_LIMIT, SURE = 0.05, 2.0
SOFT = ("symbols", "dup_lines", "half_repeats")
BLANKS = "\t\n\x0b\x0c\r "
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_counts(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns with the counts of the text.

    Repeated three-word windows are found inside the row: windows sorted by
    their words' 64-bit hash lie beside their equals.
    """
    t = df.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("_t"))
    words = F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select(*keep, "_t", words.alias("_w"), lines.alias("_l"))
    size = F.size("_w")
    windows = F.when(
        size >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    t = t.select(
        *keep,
        size.cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        windows.alias("_g"),
    )
    beside = lambda x, k, d: F.coalesce(F.get("_g", k + d)["g"] == x["g"], F.lit(False))
    starts = F.sort_array(F.filter(F.transform("_g", lambda x, k: F.when(beside(x, k, -1) | beside(x, k, 1), x["i"]).otherwise(-1)), lambda i: i >= 0))
    t = t.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", starts.alias("_s"))
    steps = F.transform("_s", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_s", k + 1) - i, F.lit(3))))
    counts = F.struct(*[c for c in COUNTS if c != "n_repeat_words"], F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))
    # a row of its own: conditions on the counts aren't put in place of them below it, where each would count again
    return t.select(*keep, F.explode(F.array(counts)).alias("_c")).select(*keep, *[F.col(f"_c.{c}").alias(c) for c in COUNTS])


def broken() -> dict[str, Column]:
    """Each rule as a condition on the counts."""
    c = F.col
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > MAX_REPEAT * c("n_words"),
        "symbols": 100 * c("n_symbols") > SOFT_SYMBOLS * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > SOFT_DUP_LINES * c("n_lines"),
        "half_repeats": 100 * c("n_repeat_words") > SOFT_REPEAT * c("n_words"),
    }


def host_verdicts(flags: DataFrame, host_col: str) -> DataFrame:
    """host, n, and for each soft rule the shrunk failure rate (``rate_...``) and whether the host breaks it by habit (``habit_...``), a row per host.

    Only sums over the hosts, one row, reach the driver.
    """
    rules = broken()
    hosts = materialize(flags.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(rules[r].cast("long")).alias(r) for r in SOFT]))
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in SOFT]).first()
    mean = {r: (total[r] or 0) / (total["n"] or 1) for r in SOFT}
    p = {r: F.col(r) / F.col("n") for r in SOFT}
    beyond = hosts.filter("n > 1").agg(*[F.avg((p[r] - mean[r]) * (p[r] - mean[r]) - p[r] * (1 - p[r]) / (F.col("n") - 1)).alias(r) for r in SOFT]).first()
    rates = []
    for r in SOFT:
        weight = max(mean[r] * (1 - mean[r]) / beyond[r] - 1, 1.0) if (beyond[r] or 0) > 0 else 1e6
        rate = (F.col(r) + F.lit(mean[r] * weight)) / (F.col("n") + F.lit(weight))
        spread = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight) + 1))
        rates += [rate.alias(f"rate_{r}"), ((rate - SURE * spread > mean[r]) & (rate >= HOST_LIMIT)).alias(f"habit_{r}")]
    return hosts.select("host", "n", *rates)


def verdict() -> tuple[Column, Column]:
    """base_failed and kept, from counts and the host's habits."""
    rules = broken()
    base = rules["short"] | rules["repeats"]
    habit = F.lit(False)
    for r in SOFT:
        habit = habit | (rules[r] & F.coalesce(F.col(f"habit_{r}"), F.lit(False)))
    return base, ~base & ~habit


def _with_hosts(counted: DataFrame, host: str) -> DataFrame:
    """``counted`` with its hosts' rates; a few hosts are broadcast by their known size, many
    are shuffled, where adaptive execution splits a hot host."""
    hosts = host_verdicts(counted, host).select(F.col("host").alias("_host"), *[f"{x}_{r}" for r in SOFT for x in ("rate", "habit")])
    return counted.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, counts, base_failed, the host's rates and kept of every row.

    The counts are written once, without texts.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("_text"))
    joined = _with_hosts(materialize(with_counts(source, F.col("_text"), ["id", "host"])), "host")
    base, kept = verdict()
    return joined.select("id", "host", *COUNTS, base.alias("base_failed"), *[f"rate_{r}" for r in SOFT], kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Counts are made once; they are written together with the rows, those that
    fail a base rule without their texts, because the hosts' rates need all counts.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    text, host = names[docs.columns.index(text_col)], names[docs.columns.index(host_col)]
    counted = with_counts(d.withColumn("host", F.col(host).cast("string")), F.col(text), [*names, "host"])
    rules = broken()
    written = materialize(counted.withColumn(text, F.when(~(rules["short"] | rules["repeats"]), F.col(text))))
    return _with_hosts(written, "host").filter(verdict()[1]).select(*names).toDF(*docs.columns)


def op8_quality_rules_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; a document's source is its host."""
    j = judge(read_table(spark, sf_dir, "documents"))
    return j.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
