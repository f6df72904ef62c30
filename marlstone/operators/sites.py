"""Link graphs, click depth, page types, templates, clusters of pages with hubs and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.numbers import half_up
from ..runtime import mark, materialize, read_table, release, sweep

# Weights and limits of the scores; defaults, to be replaced by a user's own.
HUB_WEIGHTS = {"breadth": 0.30, "inbound": 0.25, "words": 0.15, "depth": 0.15, "specific": 0.15}
HUB_LEAST, HUB_MARGIN = 0.5, 0.15
BURIED, THIN, SMALLEST, LARGEST = 4, 500, 3, 12


# --- links


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst of pages that link to one another: hrefs, resolved against the page and normalized,
    joined with the pages' URLs. Of pages with equal URLs the last is meant; self links and links
    to pages that aren't there are left out, repeats count once."""
    p = pages.select(F.col(id_col).alias("src"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""<a\s[^>]*href=["']([^"'#]+)"""), 1)).alias("href")
    origin = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    links = p.select("src", "url", href).select("src", F.when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.col("href")).alias("to"))
    targets = p.select(urls.normalize_url(F.col("url")).alias("normal"), "src").groupBy("normal").agg(F.max("src").alias("dst"))
    found = links.select("src", urls.normalize_url(F.col("to")).alias("normal")).join(targets, "normal")
    return found.filter("src <> dst").select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, inbound, outbound of (node) and distinct edges (src, dst)."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inbound"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outbound"))
    return nodes.join(into, "node", "left").join(out, "node", "left").fillna(0, ["inbound", "outbound"])


def click_depth(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth: clicks from outside, the roots at 1; null where no path leads.

    Breadth first, a join of the new nodes with the edges for each level; the
    edges stay where they are, and every level is written.
    """
    since = mark(nodes.sparkSession)
    edges = materialize(edges)
    seen = front = materialize(roots.join(nodes, "node", "left_semi").distinct().withColumn("depth", F.lit(1)))
    depth = 1
    while not front.isEmpty():
        depth += 1
        reached = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = materialize(reached.join(seen, "node", "left_anti").join(nodes, "node", "left_semi").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return sweep(nodes.join(seen, "node", "left"), since)


def diagnostics(pages: DataFrame) -> DataFrame:
    """``pages`` (inbound, depth, words, months) with orphan, buried, thin, stale and the flags joined."""
    flags = {
        "orphan": F.col("inbound") == 0,
        "buried": F.col("depth") >= BURIED,
        "thin": (F.col("words") > 0) & (F.col("words") < THIN),
        "stale": F.col("months") > 18,
    }
    out = pages.select("*", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])
    return out.withColumn("flags", F.array_join(F.array_compact(F.array(*[F.when(F.col(k), k) for k in flags])), ","))


def density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, n, internal (directed edges inside), density of (node, cluster)."""
    a, b = members.select(F.col("node").alias("src"), "cluster"), members.select(F.col("node").alias("dst"), F.col("cluster").alias("other"))
    inside = edges.join(a, "src").join(b, "dst").filter("cluster = other").groupBy("cluster").agg(F.count(F.lit(1)).alias("internal"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    possible = F.col("n") * (F.col("n") - 1)
    return size.join(inside, "cluster", "left").fillna(0, ["internal"]).withColumn("density", F.when(possible > 0, F.col("internal") / possible).otherwise(0.0))


def boosted(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """i < j, similarity raised by links: 0.10 for a link one way, 0.36 where both ways, 1 at most.

    Pairs that are linked but not similar appear with the boost alone.
    """
    linked = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("ways"))
    both = pairs.join(linked, ["i", "j"], "full")
    boost = F.when(F.col("ways") >= 2, 0.36).when(F.col("ways") == 1, 0.10).otherwise(0.0)
    return both.select("i", "j", F.least(F.lit(1.0), F.coalesce("similarity", F.lit(0.0)) + boost).alias("similarity"))


# --- clusters


def average_linkage(nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """node, cluster (its smallest node) after merging while two clusters' mean similarity exceeds ``least``.

    Average linkage in rounds: every pair of clusters that are each other's
    nearest merges at once, which gives the merges of the one-by-one method, as
    the linkage is reducible. A pair's similarities are kept as their sum, so a
    merge is a relabelling and one aggregation; pairs that aren't listed count
    as zero. Ties go to the smaller nodes.
    """
    members = materialize(nodes.select("node", F.col("node").alias("cluster")))
    sums = materialize(pairs.filter("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("similarity").alias("s")))
    while True:
        size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        near = sums.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        near = near.withColumn("mean", F.col("s") / (F.col("na") * F.col("nb"))).filter(F.col("mean") > least)
        rank = F.struct("mean", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        best = near.select(F.col("a").alias("x"), rank.alias("r")).unionByName(near.select(F.col("b").alias("x"), rank.alias("r"))).groupBy("x").agg(F.max("r").alias("r"))
        merges = materialize(best.groupBy((-F.col("r.a")).alias("a"), (-F.col("r.b")).alias("b")).count().filter("count = 2").select("a", "b"))
        if merges.isEmpty():
            release(sums)
            return members
        to = merges.select(F.col("b").alias("old"), F.col("a").alias("new"))
        named = lambda df, c: df.join(to.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        moved = named(named(sums, "a"), "b").filter("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("s").alias("s"))
        following = materialize(moved.select(F.col("x").alias("a"), F.col("y").alias("b"), "s"))
        joined = materialize(named(members, "cluster").select("node", "cluster"))
        for done in (sums, members, merges):
            release(done)
        sums, members = following, joined


def sized_clusters(members: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """node, cluster, with null for the members of clusters below ``smallest``."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return members.join(size, "cluster").select("node", F.when(F.col("n") >= smallest, F.col("cluster")).alias("cluster"))


def hubs(pages: DataFrame) -> DataFrame:
    """A row per cluster: hub (null for a gap), score, ambiguous, of pages with node, cluster, breadth
    (0..1), inbound (within the cluster), words, depth (of the URL), specific (slug words), penalty.

    Each value is set against its cluster's extremes; where no page of a
    cluster is linked, the links' weight is spread over the others.
    """
    c = Window.partitionBy("cluster")
    up = lambda x: F.when(F.max(x).over(c) > 0, F.col(x) / F.max(x).over(c)).otherwise(0.0)
    down = lambda x: F.when(F.max(x).over(c) > F.min(x).over(c), (F.max(x).over(c) - F.col(x)) / (F.max(x).over(c) - F.min(x).over(c))).otherwise(1.0)
    parts = {"breadth": F.col("breadth"), "inbound": up("inbound"), "words": up("words"), "depth": down("depth"), "specific": down("specific")}
    total = sum(HUB_WEIGHTS.values())
    scale = F.when(F.max("inbound").over(c) > 0, 1.0).otherwise(total / (total - HUB_WEIGHTS["inbound"]))
    score = sum(HUB_WEIGHTS[k] * v * (F.lit(1.0) if k == "inbound" else scale) for k, v in parts.items()) - F.coalesce("penalty", F.lit(0.0))
    scored = pages.select("cluster", "node", score.alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "node")
    two = scored.withColumn("k", F.row_number().over(order)).filter("k <= 2").groupBy("cluster").agg(
        F.max(F.when(F.col("k") == 1, F.col("node"))).alias("node"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second")
    )
    gap = F.col("score") < HUB_LEAST
    margin = (F.col("score") - F.col("second")) / F.greatest(F.abs("score"), F.lit(1e-6))
    return two.select("cluster", F.when(~gap, F.col("node")).alias("hub"), half_up(F.col("score"), 4).alias("score"), (~gap & F.coalesce(margin < HUB_MARGIN, F.lit(False))).alias("ambiguous"))


def health(clusters: DataFrame) -> DataFrame:
    """0..100 of clusters with hub, breadth (of the hub), n, density, mean_depth (reachable pages; null if none)."""
    hub = F.col("hub").isNotNull()
    raw = F.when(hub, 30 + 20 * F.coalesce("breadth", F.lit(0.0))).otherwise(0.0) + F.when(F.col("n").between(SMALLEST, LARGEST), 15).otherwise(0) + 20 * F.col("density")
    raw = raw + F.when(F.col("mean_depth").isNotNull(), 15 * F.greatest(F.lit(0.0), 1 - F.col("mean_depth") / 8)).otherwise(0.0)
    return clusters.withColumn("health", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 0).cast("long"))


# --- URLs


def template_levels(pages: DataFrame, url_col: str, most_rare: int = 8) -> DataFrame:
    """page row with ``template``: level by level, the values under one emerging prefix become {date} where they are
    several and all years, {n} where several and all numbers; else those that come once become {slug}, if they are
    more than ``most_rare``. A value that comes twice or more keeps its name.

    Rounds work on distinct paths with their counts, and on those alone that share their
    prefix with another: what stands under a prefix of its own keeps the rest of its names, so there are as many
    rounds as levels at which paths part, however deep a path is. Pages are joined once.
    """
    since = mark(pages.sparkSession)
    seg = F.coalesce(urls.path_segments(F.col(url_col)), F.array().cast("array<string>"))
    open_ = materialize(pages.select(seg.alias("seg")).groupBy("seg").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit("")))
    done, level = [], 0
    while True:
        # what is left of a path, under its template so far
        here = F.get("seg", F.lit(level))
        alone = open_.groupBy("t").agg(F.count(F.lit(1)).alias("paths"))
        told = open_.join(alone, "t")
        rest = F.array_join(F.slice("seg", level + 1, F.greatest(F.size("seg") - level, F.lit(0))), "/")
        single = (F.col("paths") == 1) & (F.size("seg") > level)
        done.append(materialize(told.filter(here.isNull() | (F.col("paths") == 1)).select("seg", F.when(single, F.concat("t", F.lit("/"), rest)).otherwise(F.col("t")).alias("template"))))
        open_ = materialize(told.filter(here.isNotNull() & (F.col("paths") > 1)).select("seg", "n", "t"))
        if open_.isEmpty():
            break
        values = open_.groupBy("t", here.alias("v")).agg(F.sum("n").alias("c"))
        kinds = values.groupBy("t").agg(F.count(F.lit(1)).alias("kinds"), F.bool_and(F.col("v").rlike("^(19|20)[0-9]{2}$")).alias("years"), F.bool_and(F.col("v").rlike("^[0-9]+$")).alias("numbers"), F.count_if(F.col("c") < 2).alias("rare"))
        many = F.col("kinds") > 1
        name = F.when(many & F.col("years"), "{date}").when(many & F.col("numbers"), "{n}").when((F.col("c") < 2) & (F.col("rare") > most_rare), "{slug}").otherwise(F.col("v"))
        named = values.join(kinds, "t").select(F.col("t").alias("_t"), F.col("v").alias("_v"), name.alias("name"))
        open_ = materialize(open_.join(named, (F.col("t") == F.col("_t")) & (here == F.col("_v"))).select("seg", "n", F.concat_ws("/", "t", "name").alias("t")))
        level += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    rows = pages.withColumn("_seg", seg)
    joined = rows.join(every.withColumnRenamed("seg", "_seg"), "_seg")
    return sweep(joined.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template"))).drop("_seg"), since)


def typed(pages: DataFrame, path: Column, overrides: DataFrame | None = None, rules=urls.PAGE_TYPES) -> DataFrame:
    """``pages`` with page_type and type_source: a user's override by template, else the rules, else "other"."""
    by_rule = urls.page_type(path, rules)
    if overrides is None:
        return pages.withColumn("page_type", by_rule).withColumn("type_source", F.when(by_rule == "other", "default").otherwise("rule"))
    o = overrides.select("template", F.col("page_type").alias("_own"))
    joined = pages.join(o, "template", "left")
    source = F.when(F.col("_own").isNotNull(), "override").when(by_rule == "other", "default").otherwise("rule")
    return joined.withColumn("page_type", F.coalesce("_own", by_rule)).withColumn("type_source", source).drop("_own")


def representatives(pages: DataFrame, types: str, url: str, most: int = 10) -> DataFrame:
    """The shortest URL of each type (the first of equals), for the ``most`` largest types."""
    one = pages.groupBy(types).agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct(F.length(url).alias("n"), F.col(url).alias("url"))).alias("r"))
    return one.orderBy(F.desc("pages"), types).limit(most).select(types, "pages", F.col("r.url").alias("url"))


def even_sample(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Rows at places floor(i * len / n) of the order, all where there are fewer; deterministic.

    Places come from ranks within ranges of the order and the ranges' counts,
    so no task sorts the whole table.
    """
    total = rows.count()
    if total <= n:
        return rows
    ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(rows.repartitionByRange(ways, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy("_p").count().collect()  # one row for each range
    before, starts = 0, {}
    for p, k in sorted(tuple(r) for r in counts):
        starts[p], before = before, before + k
    shift = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + shift[F.col("_p")]
    turn = f"((_at * {n} + {total} - 1) div {total})"  # the first i whose place is here or later
    return spread.withColumn("_at", place.cast("long")).filter(f"{turn} < {n} AND ({turn} * {total}) div {n} = _at").drop("_p", "_at")


# --- queries: parts are pages, lines that follow one another in an order are links, brands are clusters


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("src <> dst").select("src", "dst").distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def link_degree(spark, sf_dir):
    """Pages by links in and out."""
    return degrees(part_nodes(spark, sf_dir), part_edges(spark, sf_dir))


def link_click_depth(spark, sf_dir):
    """Clicks to each page from the home page's links (the pages that the first page links to)."""
    edges = part_edges(spark, sf_dir)
    return click_depth(part_nodes(spark, sf_dir), edges, edges.filter("src = 1").select(F.col("dst").alias("node")))


def link_page_diagnostics(spark, sf_dir):
    """Flags of each page: orphan, buried, thin."""
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 20).cast("long").alias("words"), (F.col("p_partkey") % 30).cast("long").alias("months"))
    d = link_degree(spark, sf_dir).select("node", "inbound").join(link_click_depth(spark, sf_dir), "node").join(parts, "node")
    return diagnostics(d).select("node", "inbound", "depth", "words", "flags")


def link_cluster_density(spark, sf_dir):
    m = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return density(m, part_edges(spark, sf_dir)).withColumn("density", half_up(F.col("density"), 6))


def _brand_pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"), (F.col("p_size") * 20).cast("long").alias("words"), F.size(F.split("p_type", " ")).alias("depth"), F.size(F.split("p_name", " ")).alias("specific"), (F.col("p_size") / 50).alias("breadth"))
    own = p.select("node", "cluster")
    e = part_edges(spark, sf_dir).join(own.withColumnRenamed("node", "dst"), "dst").join(own.select(F.col("node").alias("src"), F.col("cluster").alias("from")), "src").filter("cluster = from")
    inbound = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inbound"))
    return p.join(inbound, "node", "left").fillna(0, ["inbound"]).withColumn("penalty", F.lit(0.0))


def cluster_hubs(spark, sf_dir):
    """The hub of each cluster of pages."""
    return hubs(_brand_pages(spark, sf_dir))


def cluster_health(spark, sf_dir):
    """Health of each cluster from its hub, size, density and mean click depth."""
    h = cluster_hubs(spark, sf_dir).select("cluster", "hub")
    pages = _brand_pages(spark, sf_dir)
    deep = link_click_depth(spark, sf_dir).join(pages.select("node", "cluster"), "node").groupBy("cluster").agg(F.avg("depth").alias("mean_depth"))
    wide = h.join(pages.select(F.col("node").alias("hub"), "breadth"), "hub", "left").join(link_cluster_density(spark, sf_dir), "cluster").join(deep, "cluster", "left")
    return health(wide).select("cluster", "hub", "n", "health")


def url_template_levels(spark, sf_dir):
    """Templates of all pages' URLs, with their numbers of pages and an example."""
    t = template_levels(read_table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("pages"), F.min("url").alias("example"))


def page_type_rollup(spark, sf_dir):
    """Pages and share of each type, with the type's source and its representative URL."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    t = typed(read_table(spark, sf_dir, "pages").select("page_id", "url"), path)
    rep = representatives(t, "page_type", "url")
    by = t.groupBy("page_type").agg(F.max("type_source").alias("type_source"))
    total = t.count()
    return rep.join(by, "page_type").select("page_type", "pages", "url", "type_source", half_up(F.col("pages") / F.lit(total), 4).alias("share"))


def page_even_sample(spark, sf_dir):
    """A hundred events spread evenly over all of them by time."""
    return even_sample(read_table(spark, sf_dir, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 100).select("event_id")


def page_title_clusters(spark, sf_dir):
    """Average-linkage clusters of pages by their titles' terms; null for clusters below three pages."""
    from .topics import page_linkage

    return sized_clusters(page_linkage(spark, sf_dir))


QUERIES = {f.__name__: f for f in (link_degree, link_click_depth, link_page_diagnostics, link_cluster_density, cluster_hubs, cluster_health, url_template_levels, page_type_rollup, page_even_sample, page_title_clusters)}

EDGES_SQL = """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey)"""
DEPTH_SQL = f"""{EDGES_SQL}, reach AS (SELECT dst AS node, 1 AS depth FROM edges WHERE src = 1 AND dst IN (SELECT p_partkey FROM part)
      UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON r.node = e.src WHERE r.depth < 25),
      depths AS (SELECT p_partkey AS node, min(depth) AS depth FROM part LEFT JOIN reach ON p_partkey = node GROUP BY 1),
      deg AS (SELECT p_partkey AS node, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON p_partkey = i.dst LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON p_partkey = o.src)"""
CLUSTER_SQL = f"""{DEPTH_SQL}, dens AS (SELECT p_brand AS cluster, n, coalesce(internal, 0) AS internal, CASE WHEN n > 1 THEN coalesce(internal, 0) / (n * (n - 1)) ELSE 0 END AS density
        FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) LEFT JOIN (SELECT a.p_brand AS brand, count(*) AS internal FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand = b.p_brand GROUP BY 1) ON p_brand = brand),
      f AS (SELECT p_partkey AS node, p.p_brand AS cluster, p.p_size * 20 AS words, len(string_split(p.p_type, ' ')) AS depth, len(string_split(p.p_name, ' ')) AS specific, p.p_size / 50 AS breadth,
        (SELECT count(*) FROM edges JOIN part q ON src = q.p_partkey WHERE dst = p.p_partkey AND q.p_brand = p.p_brand) AS inbound FROM part p),
      g AS (SELECT *, max(inbound) OVER c AS mi, max(words) OVER c AS mw, max(depth) OVER c AS xd, min(depth) OVER c AS nd, max(specific) OVER c AS xs, min(specific) OVER c AS ns FROM f WINDOW c AS (PARTITION BY cluster)),
      s AS (SELECT cluster, node, breadth, 0.3::DOUBLE * breadth * k + 0.25::DOUBLE * CASE WHEN mi > 0 THEN inbound / mi ELSE 0 END + 0.15::DOUBLE * CASE WHEN mw > 0 THEN words / mw ELSE 0 END * k
        + 0.15::DOUBLE * CASE WHEN xd > nd THEN (xd - depth) / (xd - nd) ELSE 1 END * k + 0.15::DOUBLE * CASE WHEN xs > ns THEN (xs - specific) / (xs - ns) ELSE 1 END * k AS score
        FROM (SELECT *, CASE WHEN mi > 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 0.75 END AS k FROM g)),
      r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, node) AS k, lead(score) OVER (PARTITION BY cluster ORDER BY score DESC, node) AS second FROM s),
      hub AS (SELECT cluster, CASE WHEN score >= 0.5 THEN node END AS hub, floor(score * 10000 + 0.5) / 10000 AS score, score >= 0.5 AND coalesce((score - second) / greatest(abs(score), 1e-6) < 0.15, false) AS ambiguous, breadth FROM r WHERE k = 1)"""
_SEG = "list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"


def _levels(n: int) -> str:
    """Level by level over all pages, with counts by window."""
    out, last = f"l0 AS (SELECT url, {_SEG} AS seg, '' AS t FROM pages)", "l0"
    for k in range(1, n + 1):
        out += f""", v{k} AS (SELECT t, seg[{k}] AS v, count(*) AS c FROM {last} WHERE len(seg) >= {k} GROUP BY ALL),
          k{k} AS (SELECT t, count(*) AS kinds, bool_and(regexp_full_match(v, '(19|20)[0-9]{{2}}')) AS years, bool_and(regexp_full_match(v, '[0-9]+')) AS numbers, count(*) FILTER (c < 2) AS rare FROM v{k} GROUP BY t),
          l{k} AS (SELECT url, seg, CASE WHEN len(seg) < {k} THEN l.t ELSE l.t || '/' || CASE WHEN kinds > 1 AND years THEN '{{date}}' WHEN kinds > 1 AND numbers THEN '{{n}}' WHEN c < 2 AND rare > 8 THEN '{{slug}}' ELSE seg[{k}] END END AS t
            FROM {last} l LEFT JOIN v{k} v ON v.t = l.t AND v.v = seg[{k}] LEFT JOIN k{k} k ON k.t = l.t)"""
        last = f"l{k}"
    return out


_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(path, '{pattern}') THEN '{name}'" for name, pattern in urls.PAGE_TYPES) + " ELSE 'other' END"

ORACLE_SQL = {
    "link_degree": f"WITH RECURSIVE {DEPTH_SQL} SELECT * FROM deg",
    "link_click_depth": f"WITH RECURSIVE {DEPTH_SQL} SELECT * FROM depths",
    "link_page_diagnostics": f"""WITH RECURSIVE {DEPTH_SQL} SELECT node, inbound, depth, p_size * 20 AS words, array_to_string(list_filter([CASE WHEN inbound = 0 THEN 'orphan' END, CASE WHEN depth >= 4 THEN 'buried' END,
      CASE WHEN p_size * 20 BETWEEN 1 AND 499 THEN 'thin' END, CASE WHEN node % 30 > 18 THEN 'stale' END], lambda x: x IS NOT NULL), ',') AS flags FROM deg JOIN depths USING (node) JOIN part ON node = p_partkey""",
    "link_cluster_density": f"WITH RECURSIVE {CLUSTER_SQL} SELECT cluster, n, internal, floor(density * 1000000 + 0.5) / 1000000 AS density FROM dens",
    "cluster_hubs": f"WITH RECURSIVE {CLUSTER_SQL} SELECT cluster, hub, score, ambiguous FROM hub",
    "cluster_health": f"""WITH RECURSIVE {CLUSTER_SQL}, m AS (SELECT p_brand AS cluster, avg(depth) AS mean_depth FROM depths JOIN part ON node = p_partkey GROUP BY 1)
      SELECT cluster, hub, n, CAST(floor(greatest(0, least(100, CASE WHEN hub IS NOT NULL THEN 30 + 20 * breadth ELSE 0 END + CASE WHEN n BETWEEN 3 AND 12 THEN 15 ELSE 0 END + 20 * floor(density * 1000000 + 0.5) / 1000000
        + coalesce(15 * greatest(0, 1 - mean_depth / 8), 0))) + 0.5) AS BIGINT) AS health FROM hub JOIN dens USING (cluster) LEFT JOIN m USING (cluster)""",
    "url_template_levels": f"WITH {_levels(6)} SELECT CASE WHEN t = '' THEN '/' ELSE t END AS template, count(*) AS pages, min(url) AS example FROM l6 GROUP BY ALL",
    "page_type_rollup": f"""WITH t AS (SELECT url, {_TYPES} AS page_type FROM (SELECT url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
      r AS (SELECT page_type, count(*) AS pages, arg_min(url, (length(url), url)) AS url FROM t GROUP BY 1)
      SELECT page_type, pages, url, CASE WHEN page_type = 'other' THEN 'default' ELSE 'rule' END AS type_source, floor(pages / (SELECT count(*) FROM t) * 10000 + 0.5) / 10000 AS share FROM r ORDER BY pages DESC, page_type LIMIT 10""",
    "page_even_sample": """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS total FROM events)
      SELECT DISTINCT event_id FROM n JOIN range(100) i(i) ON pos = i * total // 100""",
}
