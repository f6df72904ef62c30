"""Check results: points, buckets, caps, bands, verdicts and orders of findings.

A check is a row (page, id, category, status, severity); status is pass, notice,
warning, fail, or one that isn't scored (na, skipped, informational).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..runtime import read_table

# Points of a status, bands of a score, ranks of severities.
BANDS = ((90, "excellent"), (75, "good"), (60, "fair"), (40, "poor"), (0, "critical"))
SEVERITY = {"critical": 0, "major": 1, "minor": 2}


def points() -> Column:
    """0..100 of a status; null where it isn't scored. A failure that is no error keeps a quarter."""
    s = F.col("status")
    return F.when(s == "pass", 100).when(s == "notice", 85).when(s == "warning", 50).when(s == "fail", F.when(F.col("severity") == "error", 0).otherwise(25))


def lookup(column: str, values: dict, default=None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(default))


def band(score: Column, bands=BANDS) -> Column:
    out = F.lit(bands[-1][1])
    for least, name in reversed(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def bucket_scores(checks: DataFrame, buckets: dict[str, str], tiers: dict) -> DataFrame:
    """page, bucket, score: rounded points of the scored checks, weighted by tier (1 where there is none);
    categories without a bucket are left out."""
    c = checks.select("page", lookup("category", buckets).alias("bucket"), points().alias("points"), lookup("id", tiers, 1).alias("tier"))
    scored = c.filter("bucket IS NOT NULL AND points IS NOT NULL").groupBy("page", "bucket").agg(F.sum(F.col("tier") * F.col("points")).alias("won"), F.sum("tier").alias("tiers"))
    return scored.select("page", "bucket", half_up(F.col("won") / F.col("tiers"), 0).cast("long").alias("score"))


def page_scores(checks: DataFrame, buckets: dict[str, str], weights: dict[str, float], tiers: dict, blockers: dict[str, tuple[list, int]]) -> DataFrame:
    """page, composite, cap, overall, band.

    The composite is the mean of the rounded bucket scores by their weights,
    renormalized over the buckets that have checks (weights count in
    thousandths, so that sums are exact). Where failed checks trigger
    groups of blockers, the least of their caps, less 5 for each further group
    and 10 at least, bounds it.
    """
    return tiered_scores(checks, buckets, weights, lookup("id", tiers, 1), blockers)


def tiered_scores(checks: DataFrame, buckets: dict[str, str], weights: dict[str, float], tier: Column, blockers: dict[str, tuple[list, int]]) -> DataFrame:
    """``page_scores`` with a check's tier as a column; all sums of a page are of one grouping, so the checks are made once."""
    held = {b: round(1000 * weights.get(b, 0)) for b in dict.fromkeys(buckets.values())}
    c = checks.select("page", "id", "status", lookup("category", buckets).alias("bucket"), points().alias("points"), tier.alias("tier"))
    scored = lambda b, v: F.sum(F.when((F.col("bucket") == b) & F.col("points").isNotNull(), v))
    sums = [x for k, b in enumerate(held) for x in (scored(b, F.col("tier") * F.col("points")).alias(f"won_{k}"), scored(b, F.col("tier")).alias(f"tiers_{k}"))]
    hits = [F.max((F.col("status") == "fail") & F.col("id").isin(ids)).alias(f"hit_{g}") for g, (ids, _) in blockers.items()]
    d = c.groupBy("page").agg(*sums, *hits)
    score = lambda k: half_up(F.col(f"won_{k}") / F.col(f"tiers_{k}"), 0).cast("long")
    total = sum(F.coalesce(w * score(k), F.lit(0)) for k, w in enumerate(held.values()))
    weight = sum(F.when(F.col(f"tiers_{k}").isNotNull(), w).otherwise(0) for k, w in enumerate(held.values()))
    least = F.least(*[F.when(F.col(f"hit_{g}"), cap) for g, (_, cap) in blockers.items()], F.lit(None).cast("int"))
    many = sum(F.col(f"hit_{g}").cast("int") for g in blockers)
    composite = F.when(weight > 0, half_up(total / weight, 0).cast("long"))
    out = d.select("page", composite.alias("composite"), F.when(many > 0, F.greatest(F.lit(10), least - 5 * (many - 1))).alias("cap"))
    overall = F.least("composite", "cap")
    return out.select("page", "composite", "cap", overall.alias("overall"), band(F.coalesce(overall, F.lit(0))).alias("band"))


def category_score(checks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page, score of weighted categories, in which an empty category scores 100."""
    s = F.col("status")
    value = F.when(s == "pass", 1.0).when(s == "notice", 0.55).when(s == "warning", 0.3).when(s == "fail", 0.0)
    per = checks.groupBy("page").agg(*[F.avg(F.when(F.col("category") == c, value)).alias(c) for c in weights])
    total = sum(w * F.coalesce(F.col(c), F.lit(1.0)) for c, w in weights.items())
    return per.select("page", half_up(100 * total / sum(weights.values()), 0).cast("long").alias("score"))


def worst_of(checks: DataFrame, order: str) -> DataFrame:
    """page, id, status: of a check that ran at several places, its first failing result, else its first."""
    first = F.min(F.struct((F.col("status") != "fail").alias("ok"), F.col(order).alias("o"), F.col("status").alias("status")))
    return checks.groupBy("page", "id").agg(first.alias("f")).select("page", "id", "f.status")


def section_status(checks: DataFrame) -> DataFrame:
    """page, section, status: fail over warning over manual over "all na" over pass."""
    has = lambda x: F.max(F.col("status") == x)
    status = F.when(has("fail"), "fail").when(has("warning"), "warning").when(has("manual"), "manual").when(F.min(F.col("status") == "na"), "na").otherwise("pass")
    return checks.groupBy("page", F.col("category").alias("section")).agg(status.alias("status"))


def verdict(checks: DataFrame) -> DataFrame:
    """page, verdict by the worst failing severity, with the counts that block and that warn."""
    fails = lambda s: F.count_if((F.col("status") == "fail") & (F.col("severity") == s))
    out = checks.groupBy("page").agg(fails("critical").alias("critical"), fails("major").alias("major"), fails("minor").alias("minor"), F.count_if(F.col("status") == "warning").alias("warnings"))
    v = F.when(F.col("critical") > 0, "FAIL").when(F.col("major") > 0, "REVISIONS REQUIRED").when(F.col("minor") > 0, "CONDITIONAL PASS").otherwise("PASS")
    return out.select("page", v.alias("verdict"), (F.col("critical") + F.col("major")).alias("blocking"), (F.col("minor") + F.col("warnings")).alias("warning"))


def findings(checks: DataFrame, most: int) -> DataFrame:
    """page, id, rank of the ``most`` first findings, and how many more there are: errors that fail,
    other failures, warnings, notices; what passes is none. Ranked before the cut."""
    s = F.col("status")
    kind = F.when(s == "fail", F.when(F.col("severity") == "error", 0).otherwise(1)).when(s == "warning", 2).when(s == "notice", 3)
    per_page = Window.partitionBy("page")
    ranked = checks.withColumn("kind", kind).filter("kind IS NOT NULL").select("page", "id", "kind", F.row_number().over(per_page.orderBy("kind", "id")).cast("long").alias("rank"), F.count(F.lit(1)).over(per_page).alias("n"))
    return ranked.filter(F.col("rank") <= most).select("page", "id", "rank", F.greatest(F.lit(0), F.col("n") - most).cast("long").alias("truncated"))


# --- rules that are data


def filled(pattern: str) -> Column:
    """A rule's pattern with each {name} as the escaped text of that column; null where one is missing or empty."""
    parts = []
    for k, piece in enumerate(re.split(r"\{([a-z_]+)\}", pattern)):
        value = F.nullif(F.trim(F.col(piece).cast("string")), F.lit("")) if k % 2 else F.lit(piece)
        parts.append(F.regexp_replace(value, r"([^\w\s])", r"\\$1") if k % 2 else value)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _hits(pattern: str) -> Column:
    return F.coalesce(F.col("unit_text").rlike(pattern) if "{" not in re.sub(r"\{\d+,?\d*\}", "", pattern) else F.regexp_like(F.col("unit_text"), filled(pattern)), F.lit(False))


def apply_rules(pieces: DataFrame, doc: str, rules: list[dict]) -> DataFrame:
    """doc, rule, status (pass, fail, na) and hits of every document and rule, in one pass over the pieces.

    ``pieces`` has doc, section, text and whatever columns the patterns name. A
    rule has key, type (forbid or require), pattern, and may have unit (field,
    the default, or sentence), sections (prefixes) and when (a pattern). A unit
    that matches breaks a forbid rule; a require rule fails where no unit in its
    sections matches, and passes where there are no units. With ``when``, units
    must match that as well to be forbidden, and a require rule is na in
    documents without such a unit. A pattern with a missing value never matches.
    """
    wide = pieces.withColumn("unit_text", F.coalesce("text", F.lit(""))).withColumn("unit", F.lit("field"))
    if any(r.get("unit") == "sentence" for r in rules):
        cut = pieces.withColumn("unit_text", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"))).withColumn("unit", F.lit("sentence"))
        wide = wide.unionByName(cut)
    wide = wide.filter(F.trim("unit_text") != "")
    found = []
    for k, r in enumerate(rules):
        inside = F.col("unit") == r.get("unit", "field")
        if r.get("sections"):
            here = F.lit(False)
            for prefix in r["sections"]:
                here = here | F.col("section").startswith(prefix)
            inside = inside & F.coalesce(here, F.lit(False))
        when = _hits(r["when"]) if r.get("when") else F.lit(True)
        hit = _hits(r["pattern"]) & (when if r["type"] == "forbid" else F.lit(True))
        found += [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & hit).alias(f"h{k}"), F.count_if(inside & when).alias(f"w{k}")]
    counts = pieces.select(doc).distinct().join(wide.groupBy(doc).agg(*found), doc, "left").fillna(0)
    rows = []
    for k, r in enumerate(rules):
        h, n, w = F.col(f"h{k}"), F.col(f"n{k}"), F.col(f"w{k}")
        if r["type"] == "forbid":
            status = F.when(h > 0, "fail").otherwise("pass")
        else:
            status = F.when((w == 0) & F.lit(bool(r.get("when"))), "na").when((n > 0) & (h == 0), "fail").otherwise("pass")
        rows.append(F.struct(F.lit(r["key"]).alias("rule"), status.alias("status"), h.alias("hits")))
    return counts.select(doc, F.explode(F.array(*rows)).alias("r")).select(doc, "r.*")


# --- queries: orders are pages, their lines checks

BUCKETS = {f"c{k}": b for k, b in zip(range(1, 7), ("title", "title", "content", "schema", "links", "links"))}
WEIGHTS = {"title": 0.4, "content": 0.3, "schema": 0.22, "links": 0.2}
TIERS = {1: 3, 2: 2, 3: 2}
BLOCKERS = {"index": ([1, 2], 40), "content": ([3], 60)}


def line_checks(spark, sf_dir: str, severities: tuple[str, str, str]) -> DataFrame:
    """page, id, category, status, severity of each line: status by its quantity, severity by its flag."""
    q, flag, line = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linenumber")
    status = F.when(q <= 8, "fail").when(q <= 16, "warning").when(q <= 22, "notice").when(q <= 26, "na").when(q <= 28, "manual").otherwise("pass")
    severity = F.when(flag == "R", severities[0]).when(flag == "A", severities[1]).otherwise(severities[2])
    d = read_table(spark, sf_dir, "lineitem")
    return d.select(F.col("l_orderkey").alias("page"), line.alias("id"), F.concat(F.lit("c"), line.cast("string")).alias("category"), status.alias("status"), severity.alias("severity"), F.col("l_partkey").alias("place"))


def _weighted(spark, sf_dir):
    return line_checks(spark, sf_dir, ("error", "warning", "notice"))


def check_bucket_scores(spark, sf_dir):
    """Composite, cap, overall score and band of each page."""
    return page_scores(_weighted(spark, sf_dir), BUCKETS, WEIGHTS, TIERS, BLOCKERS)


def check_category_score(spark, sf_dir):
    return category_score(_weighted(spark, sf_dir), {"c1": 25, "c2": 30, "c3": 15, "c4": 15, "c5": 10, "c6": 5})


def check_verdicts(spark, sf_dir):
    return verdict(line_checks(spark, sf_dir, ("critical", "major", "minor")))


def check_section_status(spark, sf_dir):
    c = line_checks(spark, sf_dir, ("critical", "major", "minor")).withColumn("category", F.when(F.col("id") <= 2, "head").otherwise("body"))
    return section_status(c)


def check_worst_of(spark, sf_dir):
    """Of each page's sections the first failing status by place."""
    c = _weighted(spark, sf_dir).withColumn("id", F.when(F.col("id") <= 3, 1).otherwise(2))
    return worst_of(c, "place")


def check_findings(spark, sf_dir):
    return findings(_weighted(spark, sf_dir), 2)


RULES = [
    {"key": "no_shouting", "type": "forbid", "pattern": "!!"},
    {"key": "no_lone_at", "type": "forbid", "pattern": r"(^|\s)at(\s|$)", "unit": "sentence", "when": r"(^|\s)the(\s|$)"},
    {"key": "names_language", "type": "require", "pattern": r"(^|\s){lang}(\s|$)"},
    {"key": "has_stop", "type": "require", "pattern": "[.]", "sections": ["src1"]},
    {"key": "license_named", "type": "require", "pattern": "Version", "when": "License|Apache|CC BY"},
]


def document_rules(spark, sf_dir):
    """A few rules over all documents, with sources as sections: how many documents pass each."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"), "text", "lang")
    return apply_rules(d, "doc_id", RULES).groupBy("rule", "status").agg(F.count(F.lit(1)).alias("documents"), F.sum("hits").alias("hits"))


QUERIES = {f.__name__: f for f in (document_rules, check_bucket_scores, check_category_score, check_verdicts, check_section_status, check_worst_of, check_findings)}


def _checks_sql(a: str, b: str, c: str) -> str:
    return f"""ch AS (SELECT l_orderkey AS page, l_linenumber AS id, 'c' || l_linenumber AS category, l_partkey AS place,
      CASE WHEN l_quantity <= 8 THEN 'fail' WHEN l_quantity <= 16 THEN 'warning' WHEN l_quantity <= 22 THEN 'notice' WHEN l_quantity <= 26 THEN 'na' WHEN l_quantity <= 28 THEN 'manual' ELSE 'pass' END AS status,
      CASE l_returnflag WHEN 'R' THEN '{a}' WHEN 'A' THEN '{b}' ELSE '{c}' END AS severity FROM lineitem)"""


_W = _checks_sql("error", "warning", "notice")
_S = _checks_sql("critical", "major", "minor")

ORACLE_SQL = {
    "document_rules": r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, lang FROM documents), s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS u FROM d),
      h AS (SELECT doc_id, count(CASE WHEN regexp_matches(u, '(^|\s)at(\s|$)') AND regexp_matches(u, '(^|\s)the(\s|$)') THEN 1 END) AS h FROM s GROUP BY 1),
      r AS (SELECT 'no_shouting' AS rule, CASE WHEN contains(t, '!!') THEN 'fail' ELSE 'pass' END AS status, CAST(contains(t, '!!') AS INT) AS hits FROM d
        UNION ALL SELECT 'no_lone_at', CASE WHEN h > 0 THEN 'fail' ELSE 'pass' END, h FROM h
        UNION ALL SELECT 'names_language', CASE WHEN trim(t) <> '' AND NOT regexp_matches(t, '(^|\s)' || lang || '(\s|$)') THEN 'fail' ELSE 'pass' END, CAST(regexp_matches(t, '(^|\s)' || lang || '(\s|$)') AS INT) FROM d
        UNION ALL SELECT 'has_stop', CASE WHEN source LIKE 'src1%' AND trim(t) <> '' AND NOT contains(t, '.') THEN 'fail' ELSE 'pass' END, CAST(source LIKE 'src1%' AND contains(t, '.') AS INT) FROM d
        UNION ALL SELECT 'license_named', CASE WHEN NOT regexp_matches(t, 'License|Apache|CC BY') THEN 'na' WHEN contains(t, 'Version') THEN 'pass' ELSE 'fail' END, CAST(contains(t, 'Version') AS INT) FROM d)
      SELECT rule, status, count(*) AS documents, CAST(sum(hits) AS BIGINT) AS hits FROM r GROUP BY ALL""",
    "check_bucket_scores": f"""WITH {_W}, p AS (SELECT page, CASE WHEN id <= 2 THEN 'title' WHEN id = 3 THEN 'content' WHEN id = 4 THEN 'schema' WHEN id <= 6 THEN 'links' END AS bucket,
        CASE status WHEN 'pass' THEN 100 WHEN 'notice' THEN 85 WHEN 'warning' THEN 50 WHEN 'fail' THEN CASE WHEN severity = 'error' THEN 0 ELSE 25 END END AS points, CASE WHEN id = 1 THEN 3 WHEN id <= 3 THEN 2 ELSE 1 END AS tier FROM ch),
      b AS (SELECT page, bucket, floor(sum(tier * points) / sum(tier) + 0.5) AS score, CASE bucket WHEN 'title' THEN 400 WHEN 'content' THEN 300 WHEN 'schema' THEN 220 ELSE 200 END AS weight FROM p WHERE bucket IS NOT NULL AND points IS NOT NULL GROUP BY page, bucket),
      m AS (SELECT page, CAST(floor(sum(weight * score) / sum(weight) + 0.5) AS BIGINT) AS composite FROM b GROUP BY page),
      k AS (SELECT page, bool_or(status = 'fail' AND id IN (1, 2)) AS g, bool_or(status = 'fail' AND id = 3) AS h FROM ch GROUP BY page),
      o AS (SELECT page, composite, CASE WHEN g AND h THEN 35 WHEN g THEN 40 WHEN h THEN 60 END AS cap FROM k LEFT JOIN m USING (page)),
      t AS (SELECT *, CASE WHEN composite IS NULL THEN cap WHEN cap IS NULL THEN composite ELSE least(composite, cap) END AS overall FROM o)
      SELECT *, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair' WHEN overall >= 40 THEN 'poor' ELSE 'critical' END AS band FROM t""",
    "check_category_score": f"""WITH {_W}, v AS (SELECT page, id, CASE status WHEN 'pass' THEN 1.0::DOUBLE WHEN 'notice' THEN 0.55::DOUBLE WHEN 'warning' THEN 0.3::DOUBLE WHEN 'fail' THEN 0.0::DOUBLE END AS v FROM ch),
      a AS (SELECT page, {', '.join(f"coalesce(avg(CASE WHEN id = {k} THEN v END), 1) AS c{k}" for k in range(1, 7))} FROM v GROUP BY page)
      SELECT page, CAST(floor(100 * (25 * c1 + 30 * c2 + 15 * c3 + 15 * c4 + 10 * c5 + 5 * c6) / 100 + 0.5) AS BIGINT) AS score FROM a""",
    "check_verdicts": f"""WITH {_S}, n AS (SELECT page, count(CASE WHEN status = 'fail' AND severity = 'critical' THEN 1 END) AS a, count(CASE WHEN status = 'fail' AND severity = 'major' THEN 1 END) AS b,
        count(CASE WHEN status = 'fail' AND severity = 'minor' THEN 1 END) AS c, count(CASE WHEN status = 'warning' THEN 1 END) AS w FROM ch GROUP BY page)
      SELECT page, CASE WHEN a > 0 THEN 'FAIL' WHEN b > 0 THEN 'REVISIONS REQUIRED' WHEN c > 0 THEN 'CONDITIONAL PASS' ELSE 'PASS' END AS verdict, a + b AS blocking, c + w AS warning FROM n""",
    "check_section_status": f"""WITH {_S} SELECT page, CASE WHEN id <= 2 THEN 'head' ELSE 'body' END AS section, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warning') THEN 'warning'
      WHEN bool_or(status = 'manual') THEN 'manual' WHEN bool_and(status = 'na') THEN 'na' ELSE 'pass' END AS status FROM ch GROUP BY ALL""",
    "check_worst_of": f"""WITH {_W}, r AS (SELECT page, CASE WHEN id <= 3 THEN 1 ELSE 2 END AS id, status, place FROM ch)
      SELECT page, id, status FROM r QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY status <> 'fail', place, status) = 1""",
    "check_findings": f"""WITH {_W}, k AS (SELECT *, CASE status WHEN 'fail' THEN CASE WHEN severity = 'error' THEN 0 ELSE 1 END WHEN 'warning' THEN 2 WHEN 'notice' THEN 3 END AS kind FROM ch),
      r AS (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY kind, id) AS rank, count(*) OVER (PARTITION BY page) AS n FROM k WHERE kind IS NOT NULL)
      SELECT page, id, rank, greatest(0, n - 2) AS truncated FROM r WHERE rank <= 2""",
}
