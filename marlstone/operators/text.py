"""Text over columns: words, shingles, overlap, TF-IDF and sparse cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.numbers import half_up
from ..functions.stems import stemmed
from ..runtime import materialize, read_table
from .blocks import met, pairs_from, unit_vectors


def plain_words(text: Column) -> Column:
    """Words of a-z and 0-9; all else parts them ("foo-bar" is two words, "é" none)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingle_set(words: str, k: int = 3) -> Column:
    """Distinct 64-bit hashes of the runs of k words in the column ``words``; empty where there are fewer.

    The words must be a column of their own, not an expression, which the
    optimizer would evaluate again for every run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(k)]))
    return F.when(F.size(words) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_sets(df: DataFrame, id_col: str, text: Column, k: int = 3) -> DataFrame:
    """id, n, shingles of every text: the distinct 64-bit hashes of its runs of k words, and how many."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(k)]))
    own = bound(plain_words(text), lambda w: F.when(F.size(w) >= k, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))
    return df.select(F.col(id_col).alias("id"), bound(own, lambda s: F.struct(F.size(s).alias("n"), s.alias("shingles"))).alias("r")).select("id", "r.n", "r.shingles")


def shingle_rows(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, n, s: a row for each distinct shingle of a text, and how many it has. Nothing is written: joined with a
    smaller side, rows are made and met in passing."""
    return shingle_sets(df, id_col, text).select("id", "n", F.explode("shingles").alias("s"))


def jaccard_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, jaccard of all pairs that share a shingle, by an equi-join on (id, n, s)
    rows; sizes travel with the rows, so nothing is joined twice. The right side is the smaller: it is written,
    so that its true size decides whether it is sent to the left one's tasks or both are shuffled."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), "s")

    shared = rows(left, "left").join(rows(materialize(right), "right"), "s").groupBy("left_id", "right_id", "left_n", "right_n").agg(F.count(F.lit(1)).alias("both"))
    return shared.select("left_id", "right_id", half_up(F.col("both") / (F.col("left_n") + F.col("right_n") - F.col("both")), 4).alias("jaccard"))


def term_counts(docs: DataFrame) -> DataFrame:
    """id, term, tf of (id, words)."""
    return docs.select("id", F.explode("words").alias("term")).filter((F.length("term") > 1) & ~F.col("term").rlike("^[0-9]+$")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(tf: DataFrame, n: int, most_share: float = 0.6) -> DataFrame:
    """id, term, weight = tf ln(n/df); terms in more than ``most_share`` of documents are dropped,
    which also keeps hot terms out of the joins that follow."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") / n <= most_share)
    return tf.join(df, "term").select("id", "term", (F.col("tf") * F.log(n / F.col("df"))).alias("weight"))


def cosine_pairs(weights: DataFrame, least: float) -> DataFrame:
    """i < j, cosine >= least > 0 of all pairs, as products of blocks of unit vectors: pairs below ``least`` have no rows anywhere."""
    kind = weights.schema["id"].dataType
    found = met(materialize(unit_vectors(weights)), pairs_from(least), "i bigint, j bigint, v double")
    return found.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), F.col("v").alias("cosine"))


def _title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def title_weights(pages: DataFrame) -> DataFrame:
    """id, term, weight: TF-IDF of titles' words, dropping terms in over 60 per cent of the pages."""
    tf = term_counts(pages.select(F.col("page_id").alias("id"), plain_words(_title(F.col("html"))).alias("words")))
    return tf_idf(tf, pages.count())


def text_wordcount(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(plain_words(F.col("text"))).cast("long").alias("words"))


def shingle_jaccard_benchmark(spark, sf_dir):
    """Document and benchmark pairs that share three-word shingles, with their Jaccard index."""
    d = shingle_rows(read_table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return jaccard_pairs(d, shingle_rows(read_table(spark, sf_dir, "benchmark"), "item_id", F.col("text")))


def tfidf_terms(spark, sf_dir):
    """Titles' terms with document frequency and idf."""
    p = read_table(spark, sf_dir, "pages")
    tf = term_counts(p.select(F.col("page_id").alias("id"), plain_words(_title(F.col("html"))).alias("words")))
    n = p.count()
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).filter(F.col("df") / n <= 0.6).select("term", "df", "tf", half_up(F.log(n / F.col("df")), 6).alias("idf"))


def head_weights(pages: DataFrame) -> DataFrame:
    """``title_weights`` of distinct titles, each by its first page."""
    first = pages.groupBy(_title(F.col("html"))).agg(F.min("page_id").alias("id"))
    return title_weights(pages).join(first.select("id"), "id", "left_semi")


def title_cosine_pairs(spark, sf_dir):
    """Pairs of distinct titles, each by its first page, with a TF-IDF cosine of 0.08 or more;
    ``title_classes`` has the pages of each."""
    return cosine_pairs(head_weights(read_table(spark, sf_dir, "pages")), 0.08).select("i", "j", half_up(F.col("cosine"), 4).alias("cosine"))


def title_classes(spark, sf_dir):
    """Each page with the first page of the same title."""
    p = read_table(spark, sf_dir, "pages").select("page_id", _title(F.col("html")).alias("title"))
    first = p.groupBy("title").agg(F.min("page_id").alias("class_id"))
    return p.join(first, "title").select("page_id", "class_id")


def url_parts(spark, sf_dir):
    """Normalized URL, root domain, segments, template, type and slug of each page."""
    u = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(u).alias("normal"), urls.root_domain(u).alias("root"), F.array_join(urls.path_segments(u), "|").alias("segments"), urls.template(u).alias("template"), urls.slugify(_title(F.col("html"))).alias("slug"))


def url_template_counts(spark, sf_dir):
    t = read_table(spark, sf_dir, "pages").select(urls.template(F.col("url")).alias("template"))
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("pages"))


def page_signals(spark, sf_dir):
    """Title length, headings, paragraphs and links of each page, and its checks' score."""
    h = F.col("html")
    n = lambda pattern: F.regexp_count(h, F.lit(pattern)).cast("long")
    s = read_table(spark, sf_dir, "pages").select("page_id", F.length(_title(h)).cast("long").alias("title_chars"), n("<h1[ >]").alias("h1"), n("<p[ >]").alias("paragraphs"), n("<a [^>]*href=").alias("links"), n("<script").alias("scripts"))
    points = F.when(F.col("title_chars").between(10, 60), 40).otherwise(20) + F.when(F.col("h1") == 1, 30).otherwise(0) + F.when(F.col("paragraphs") >= 3, 20).otherwise(10) + F.when(F.col("links") >= 1, 10).otherwise(0)
    return s.withColumn("score", points.cast("long"))


def benchmark_title_sets(spark, sf_dir):
    """Set operations: benchmark words that titles lack, share, and their union's size."""
    words = lambda df, c: df.select(F.explode(plain_words(c)).alias("w")).distinct()
    a = words(read_table(spark, sf_dir, "benchmark"), F.col("text"))
    b = words(read_table(spark, sf_dir, "pages"), _title(F.col("html")))
    tagged = a.withColumn("a", F.lit(1)).unionByName(b.withColumn("b", F.lit(1)), allowMissingColumns=True).groupBy("w").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return tagged.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_benchmark"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))


# Fields of a page with their weight, and words that no term has.
FIELDS = (("title", r"<title>([^<]*)</title>", 3.0), ("h1", r"<h1[^>]*>([^<]*)</h1>", 2.5), ("first", r"<p>([^<]+)", 0.5))
SLUG_WEIGHT = 2.0
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def weighted_terms(fields: DataFrame, stop: tuple[str, ...] = STOP_WORDS, longest: int = 3) -> DataFrame:
    """id, term, tf of (id, field, weight, text): runs of one to ``longest`` words of a field, each
    occurrence adding the field's weight. Stop words, single letters and numbers go beforehand.

    Words are rows, and a run is a word with those after it, so that no text
    is parsed again for each of its runs.
    """
    words = fields.select("id", "field", "weight", F.posexplode(plain_words(F.col("text"))).alias("k", "word"))
    kept = words.filter((F.length("word") > 1) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(*stop))
    after = Window.partitionBy("id", "field").orderBy("k")
    kept = kept.select("id", "weight", F.col("word").alias("w0"), *[F.lead("word", n).over(after).alias(f"w{n}") for n in range(1, longest)])
    runs = [F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *[f"w{m}" for m in range(n + 1)])) for n in range(longest)]
    return kept.select("id", "weight", F.explode(F.array_compact(F.array(*runs))).alias("term")).groupBy("id", "term").agg(F.sum("weight").alias("tf"))


def page_term_profile(spark, sf_dir):
    """Weighted runs of words from title, h1, slug and first paragraph of each page, with idf; those in over
    60 per cent of the pages are left out."""
    p = read_table(spark, sf_dir, "pages")
    slug = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    parts = [F.struct(F.lit(n).alias("field"), F.lit(w).alias("weight"), F.regexp_extract("html", x, 1).alias("text")) for n, x, w in FIELDS]
    parts.append(F.struct(F.lit("slug").alias("field"), F.lit(SLUG_WEIGHT).alias("weight"), slug.alias("text")))
    tf = weighted_terms(p.select(F.col("page_id").alias("id"), F.explode(F.array(*parts)).alias("f")).select("id", "f.*"))
    n = p.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") / n <= 0.6)
    return tf.join(df, "term").select(F.col("id").alias("page_id"), "term", "tf", half_up(F.log(n / F.col("df")), 6).alias("idf"))


def benchmark_stems(spark, sf_dir):
    """Stems of the benchmark's words, with their forms and occurrences."""
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(plain_words(F.col("text"))).alias("word"))
    counts = words.filter((F.length("word") > 1) & ~F.col("word").isin(*STOP_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stemmed(counts, "word").groupBy("stem").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (benchmark_stems, text_wordcount, page_term_profile, shingle_jaccard_benchmark, tfidf_terms, title_cosine_pairs, title_classes, url_parts, url_template_counts, page_signals, benchmark_title_sets)}

W = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
TF_SQL = f"""tf AS (SELECT page_id AS id, term, count(*) AS tf FROM (SELECT page_id, unnest({W.format(TITLE)}) AS term FROM pages) WHERE length(term) > 1 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL),
      n AS (SELECT count(*) AS n FROM pages), df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term HAVING count(*) / (SELECT n FROM n) <= 0.6)"""
SHINGLES = "CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE [] END"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
TEMPLATE = f"""'/' || array_to_string(list_transform({SEGMENTS}, lambda s: CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?') THEN '{{date}}'
      WHEN regexp_full_match(s, '[0-9]+(\\.html?)?') THEN '{{n}}' WHEN regexp_full_match(s, '[a-z0-9]+(-[a-z0-9]+){{2,}}') THEN '{{slug}}' ELSE s END), '/')"""

ORACLE_SQL = {
    "text_wordcount": f"SELECT doc_id, CAST(len({W.format('text')}) AS BIGINT) AS words FROM documents",
    "shingle_jaccard_benchmark": f"""WITH d AS (SELECT id, {SHINGLES} AS s FROM (SELECT doc_id AS id, {W.format('text')} AS w FROM documents)), b AS (SELECT id, {SHINGLES} AS s FROM (SELECT item_id AS id, {W.format('text')} AS w FROM benchmark)),
      x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM d), y AS (SELECT id, len(s) AS n, unnest(s) AS g FROM b)
      SELECT * FROM (SELECT x.id AS left_id, y.id AS right_id, floor(count(*) / (x.n + y.n - count(*)) * 10000 + 0.5) / 10000 AS jaccard FROM x JOIN y USING (g) GROUP BY x.id, y.id, x.n, y.n)""",
    "page_term_profile": f"""WITH f AS ({' UNION ALL '.join(f"SELECT page_id, '{n}' AS field, {w} AS weight, {W.format(f"regexp_extract(html, '{x}', 1)")} AS ws FROM pages" for n, x, w in FIELDS)} UNION ALL SELECT page_id, 'slug', {SLUG_WEIGHT}, {W.format(PATH)} FROM pages),
      u AS (SELECT page_id, field, weight, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM f),
      l AS (SELECT page_id, weight, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y FROM u WHERE length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN {STOP_WORDS} WINDOW o AS (PARTITION BY page_id, field ORDER BY k)),
      g AS (SELECT page_id, weight, w AS term FROM l UNION ALL SELECT page_id, weight, w || ' ' || x FROM l WHERE x IS NOT NULL UNION ALL SELECT page_id, weight, w || ' ' || x || ' ' || y FROM l WHERE y IS NOT NULL),
      t AS (SELECT page_id, term, CAST(sum(weight) AS DOUBLE) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM pages)
      SELECT page_id, term, tf, floor(ln((SELECT n FROM n) / df) * 1000000 + 0.5) / 1000000 AS idf FROM t JOIN (SELECT term, count(*) AS df FROM t GROUP BY 1) USING (term) WHERE df / (SELECT n FROM n) <= 0.6""",
    "tfidf_terms": f"WITH {TF_SQL} SELECT term, df, tf, floor(ln((SELECT n FROM n) / df) * 1000000 + 0.5) / 1000000 AS idf FROM df",
    "title_cosine_pairs": f"""WITH {TF_SQL}, w AS (SELECT id, term, tf.tf * ln((SELECT n FROM n) / df.df) AS w FROM tf JOIN df USING (term)), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
      v AS (SELECT * FROM u WHERE id IN (SELECT min(page_id) FROM pages GROUP BY {TITLE}))
      SELECT i, j, floor(c * 10000 + 0.5) / 10000 AS cosine FROM (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS c FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY ALL) WHERE c >= 0.08""",
    "title_classes": f"SELECT page_id, min(page_id) OVER (PARTITION BY {TITLE}) AS class_id FROM pages",
    "url_parts": f"""SELECT page_id, CASE WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]+') THEN lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END END AS normal,
      regexp_extract(regexp_replace({HOST}, '^www\\.', ''), '([^.]*\\.)?[^.]*$') AS root, array_to_string({SEGMENTS}, '|') AS segments, {TEMPLATE} AS template,
      regexp_replace(regexp_replace(lower({TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""",
    "url_template_counts": f"SELECT {TEMPLATE} AS template, count(*) AS pages FROM pages GROUP BY ALL",
    "page_signals": f"""WITH s AS (SELECT page_id, CAST(length({TITLE}) AS BIGINT) AS title_chars, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS h1, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs,
      CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts FROM pages)
      SELECT *, CAST(CASE WHEN title_chars BETWEEN 10 AND 60 THEN 40 ELSE 20 END + CASE WHEN h1 = 1 THEN 30 ELSE 0 END + CASE WHEN paragraphs >= 3 THEN 20 ELSE 10 END + CASE WHEN links >= 1 THEN 10 ELSE 0 END AS BIGINT) AS score FROM s""",
    "benchmark_title_sets": f"""WITH a AS (SELECT DISTINCT unnest({W.format('text')}) AS w FROM benchmark), b AS (SELECT DISTINCT unnest({W.format(TITLE)}) AS w FROM pages)
      SELECT count(CASE WHEN b.w IS NULL THEN 1 END) AS only_benchmark, count(CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN 1 END) AS shared, count(*) AS either FROM a FULL JOIN b ON a.w = b.w""",
}
