"""Landed files as tables, and tables as files: keyword CSV, reports, robots, sitemaps, JSON, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..runtime import mark, materialize, read_table, sweep

ROBOTS_AGENTS = ("*",)


def number(text: Column) -> Column:
    """The leading whole number of a text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def keyword_csv(spark: SparkSession, path: str, columns: list[str], numbers: list[str], key: str = "keyword") -> DataFrame:
    """Rows of a CSV file with a header; an error where a column is missing. Rows without a keyword are
    left out, numbers default to 0, and ``keyword_norm`` is the trimmed lower-case keyword."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    rows = raw.select(*[number(F.col(c)).alias(c) if c in numbers else F.trim(F.col(c)).alias(c) for c in columns])
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn(f"{key}_norm", F.lower(F.col(key)))


def write_by_client(rows: DataFrame, path: str, client: str = "client_id") -> None:
    """Replace the partitions of those clients that ``rows`` has, and leave the others."""
    rows.write.partitionBy(client).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def is_report_error(raw: Column) -> Column:
    """Blank or beginning with "error", in upper or lower case: no data."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    return (t == "") | t.startswith("ERROR") | t.startswith("error")


def _report_lines(reports: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("line", "text")
    return reports.filter(~is_report_error(F.col(text_col))).select(id_col, lines).filter(F.trim("text") != "")


def report_rows(reports: DataFrame, id_col: str, text_col: str, names: list[str], skip: int = 1) -> DataFrame:
    """Semicolon reports by position, without quoting, cells trimmed; error reports give no rows."""
    cells = _report_lines(reports, id_col, text_col).filter(F.col("line") >= skip).select(id_col, "line", F.transform(F.split("text", ";"), lambda x: F.trim(x)).alias("c"))
    return cells.select(id_col, "line", *[F.get("c", k).alias(n) for k, n in enumerate(names)])


def report_rows_by_header(reports: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line, cells (a map by the report's own header) of semicolon reports; cells missing at a line's end are empty."""
    lines = _report_lines(reports, id_col, text_col).select(id_col, "line", F.transform(F.split("text", ";"), lambda x: F.trim(x)).alias("c"))
    heads = lines.filter("line = 0").select(id_col, F.col("c").alias("head"))
    body = lines.filter("line > 0").join(heads, id_col)
    cells = F.map_from_arrays("head", F.transform("head", lambda h, k: F.coalesce(F.get("c", k), F.lit(""))))
    return body.select(id_col, "line", cells.alias("cells"))


def robots_rules(files: DataFrame, host_col: str, text_col: str, agents: tuple[str, ...] = ROBOTS_AGENTS) -> DataFrame:
    """host, rules: the Disallow prefixes of the agents' groups as written; neither wildcards nor Allow lines count. Fields' and agents' names have no case, paths have."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), r"(?m)#.*$", ""), r"\r", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^(user-agent|disallow)\s*:"))
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("body"), F.array().cast("array<string>").alias("rules"))

    def step(s: Column, line: Column) -> Column:
        value = F.trim(F.regexp_extract(line, r":(.*)$", 1))
        agent = F.lower(line).startswith("user-agent")
        named = F.lower(value).isin(*[a.lower() for a in agents])
        # Agents that follow one another share a group; one after rules opens the next.
        on = F.when(agent, F.when(s["body"], named).otherwise(s["on"] | named)).otherwise(s["on"])
        rules = F.when(~agent & s["on"] & (value != ""), F.concat(s["rules"], F.array(value))).otherwise(s["rules"])
        return F.struct(on.alias("on"), (~agent).alias("body"), rules.alias("rules"))

    return files.select(host_col, F.aggregate(lines, start, step)["rules"].alias("rules"))


def disallowed(path: Column, rules: Column) -> Column:
    """Whether a path starts with any rule, as written."""
    return F.exists(rules, lambda r: path.startswith(r))


def sitemap_urls(files: DataFrame, file_col: str, xml_col: str) -> DataFrame:
    """file, kind (page or sitemap), url, lastmod: entries of sitemaps and sitemap indexes; the first of
    equal normalized URLs stays."""
    entry = F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<((?:url|sitemap)>.*?)</(?:url|sitemap)>"), 1)).alias("e")
    rows = files.select(file_col, entry).select(
        file_col,
        F.when(F.col("e").startswith("sitemap>"), "sitemap").otherwise("page").alias("kind"),
        F.replace(F.trim(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1)), F.lit("&amp;"), F.lit("&")).alias("url"),
        F.nullif(F.trim(F.regexp_extract("e", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod"),
    )
    keyed = rows.filter("url <> ''").withColumn("normal", F.coalesce(urls.normalize_url(F.col("url")), "url"))
    best = keyed.groupBy("normal", "kind").agg(F.min(F.struct(file_col, "url", "lastmod")).alias("r"))
    return best.select(f"r.{file_col}", "kind", "r.url", "r.lastmod")


# Names of sitemaps of media, and of files that are no pages.
MEDIA_SITEMAPS = r"(?i)(image|video|news)[-_]?sitemap|sitemap[-_]?(image|video|news)"
NO_PAGES = r"(?i)\.(jpe?g|png|gif|webp|svg|pdf|mp4|zip|css|js)([?#]|$)"


def bare_host(url: Column) -> Column:
    """Host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1)), r"^www\.", "")


def sitemap_closure(files: DataFrame, roots: DataFrame, file_col: str, xml_col: str, depth: int = 5) -> DataFrame:
    """root, url, lastmod, level: the pages that each root file reaches through indexes of up to ``depth`` levels.

    ``files`` are landed (their URL, their text), ``roots`` (root) the URLs of the files to begin with. A file is read
    once for a root, at its least level, so files that name one another end; names with and without www,
    or of another scheme, are one file. Files that aren't there or hold neither kind lead nowhere; sitemaps of media and
    files that are no pages are left out, and so is a page of another host than its root's (www aside). Of equal pages
    of a root the one of the least level, file and text stays. Levels are joins of the new files with the edges.
    """
    since = mark(files.sparkSession)
    key = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://(?i:www\.)?", ""), "/+$", "")
    entry = F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?s)<((?:url|sitemap)>.*?)</(?:url|sitemap)>"), 1)).alias("e")
    loc = F.replace(F.trim(F.regexp_replace(F.regexp_extract("e", r"(?s)<loc>(.*?)</loc>", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$|\s+", "")), F.lit("&amp;"), F.lit("&"))
    rows = files.select(key(F.col(file_col)).alias("file"), F.col(file_col).alias("name"), entry)
    rows = rows.select("file", "name", F.startswith("e", F.lit("sitemap>")).alias("index"), loc.alias("url"), F.nullif(F.trim(F.regexp_extract("e", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod")).filter("url <> ''")
    rows = materialize(rows)
    edges = materialize(rows.filter("index").select("file", key(F.col("url")).alias("child")).distinct())
    front = seen = materialize(roots.select("root", key(F.col("root")).alias("file")).distinct().withColumn("level", F.lit(0)))
    for level in range(1, depth + 1):
        reached = edges.join(front, "file").select("root", F.col("child").alias("file")).distinct()
        front = materialize(reached.join(seen.select("root", "file"), ["root", "file"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    pages = rows.filter(~F.col("index") & ~F.col("name").rlike(MEDIA_SITEMAPS) & ~F.col("url").rlike(NO_PAGES)).join(seen, "file").filter(bare_host(F.col("url")) == bare_host(F.col("root")))
    best = pages.groupBy("root", F.coalesce(urls.normalize_url(F.col("url")), "url").alias("normal")).agg(F.min(F.struct("level", "file", "url", "lastmod")).alias("r"))
    return sweep(best.select("root", "r.url", "r.lastmod", "r.level"), since)


def in_sitemap(pages: DataFrame, url_col: str, entries: DataFrame, readable: bool) -> DataFrame:
    """``pages`` with in_sitemap: true, false, or null where no sitemap could be read; ends' slashes don't count."""
    if not readable:
        return pages.withColumn("in_sitemap", F.lit(None).cast("boolean"))
    bare = lambda c: F.regexp_replace(F.col(c), "/+$", "")
    known = entries.filter("kind = 'page'").select(bare("url").alias("_u")).distinct().withColumn("_hit", F.lit(True))
    return pages.join(known, bare(url_col) == F.col("_u"), "left").withColumn("in_sitemap", F.coalesce("_hit", F.lit(False))).drop("_u", "_hit")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of JSON files, whole files each; an empty table where the path is missing. Corrupt files give null fields."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """file, meta (map of key to text), body of Markdown files that may begin with a block between lines of three dashes."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w-]+)", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r":(.*)$", 1)), r"""^["']|["']$""", "").alias("v"))
    return raw.select("file", F.map_from_entries(F.transform(lines, entry)).alias("meta"), F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One header per file, quotes doubled inside quotes; arrays are joined by " | ", nulls are empty."""
    flat = [F.array_join(f.name, " | ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast("string").alias(f.name) for f in rows.schema]
    rows.select(*flat).write.csv(path, header=True, mode="overwrite", escape='"', emptyValue="", nullValue="")


# --- queries: files made of the pages' hosts and URLs

ROBOTS = "User-agent: other\nDisallow: /\n\nuser-Agent: *\nDisallow: /en/1 # old\nDISALLOW: /FR/\nDisallow: /de/\nDisallow:\n"


def robots_blocked(spark, sf_dir):
    """Pages that a robots file, the same for every host, keeps from being read."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    rules = robots_rules(pages.select("host", F.lit(ROBOTS).alias("txt")).distinct(), "host", "txt")
    return pages.join(rules, "host").filter(disallowed(F.col("path"), F.col("rules"))).select("page_id", "path")


def sitemap_reach(spark, sf_dir):
    """Pages of each host's sitemap: an index of three files and of a further index, which has a fourth and the first index again."""
    pages = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("k"), bare_host(F.col("url")).alias("host"), "url").filter("host <> ''")
    loc = lambda u: F.concat(F.lit("<loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    url = F.concat(F.lit("<url>"), loc(F.col("url")), F.lit("</url>"))
    part = F.concat(F.lit("https://www."), "host", F.lit("/part"), F.col("k").cast("string"), F.lit(".xml"))
    parts = pages.groupBy("host", "k").agg(F.array_join(F.array_sort(F.collect_list(url)), "\n").alias("xml")).select(part.alias("file"), "xml")
    hosts = pages.select("host").distinct()
    child = lambda name: F.concat(F.lit("<sitemap><loc>http://"), "host", F.lit(f"/{name}.xml</loc></sitemap>"))
    index = lambda name, names: hosts.select(F.concat(F.lit("https://"), "host", F.lit(f"/{name}.xml")).alias("file"), F.concat(*[child(n) for n in names]).alias("xml"))
    files = parts.unionByName(index("sitemap", ("part0", "part1", "part2", "more", "gone"))).unionByName(index("more", ("part3", "sitemap")))
    found = sitemap_closure(files, hosts.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("root")), "file", "xml")
    return found.select("root", "url", "level")


QUERIES = {f.__name__: f for f in (robots_blocked, sitemap_reach)}

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"
_AT = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
ORACLE_SQL = {
    "robots_blocked": "SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) WHERE starts_with(path, '/en/1') OR starts_with(path, '/FR/') OR starts_with(path, '/de/')",
    "sitemap_reach": f"""WITH p AS (SELECT {_HOST} AS host, url, CASE WHEN page_id % 4 = 3 THEN 2 ELSE 1 END AS level, page_id % 4 AS k,
        CASE WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]+') THEN lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {_AT} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END ELSE url END AS normal FROM pages)
      SELECT 'https://' || host || '/sitemap.xml' AS root, arg_min(url, (level, k, url)) AS url, min(level) AS level FROM p WHERE host <> '' GROUP BY host, normal""",
}
