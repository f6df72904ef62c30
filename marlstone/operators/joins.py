"""Joins of the reports: pages near other clusters, layers by membership, precedence, cadence, dependencies, claims.

Unless said otherwise a null key matches nothing and its row stays with nulls or
zeros, repeated rows count each, and empty inputs give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..runtime import materialize, read_table
from .blocks import met, pairs_from, sums_by, unit_vectors
from .text import head_weights, title_classes

CANNIBAL, DUAL_MARGIN = 0.75, 0.05  # defaults, to be replaced by a user's own
# Days that a frequency allows, and patterns of claims.
CADENCE = {"Weekly": 7, "Biweekly": 14, "Monthly": 30, "Quarterly": 90}
FIGURE = r"([0-9][0-9.,]*)\s*%|\b[0-9][0-9,]*\s+(in|out of|per)\s+[0-9][0-9,]*\b|\b[0-9][0-9,]*(\.[0-9]+)?\s*(million|billion|thousand|percent)\b"
NOT_FIGURES = r"\(?[0-9]{3}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}|[0-9]{5}(-[0-9]{4})?|\$[0-9,]+(\.[0-9]{2})?|[0-9]{1,2}:[0-9]{2}\s*(am|pm)|[0-9]+\s*(st|nd|rd|th)\s+(floor|suite|ste)|copyright\s+©?\s*[0-9]{4}|©\s*[0-9]{4}|established\s+in\s+[0-9]{4}"
GROWTH = r"increase|growth|grew|rose|rise|higher|more than|roi|return|faster"
QUOTED = r"[\"“][^\"”]{20,}[\"”]"
SPEAKER = r"\b(As|According to)\s+[A-Z][\w.'’-]+(\s+[A-Z][\w.'’-]+)+"
BODY = r"\bat\s+[A-Z][^,(.]{2,60}"
CITED = r"\([^(),]{2,60},\s*((19|20)[0-9]{2})\)"
NAMED = r"\b[Aa]ccording to\s+[A-Z][^,.;]{2,60}"
STAND_IN = r"example\.(com|org|net)|yoursite|yourdomain|lorem|/path/to/"
UNFILLED = r"\[(x|y|n|name|full name|credential(/title)?|title|org(anisation|anization)?|year|source|population|action|quote)\]|\(source,\s*year\)"


# --- clusters and pairs


def _kinds(members: DataFrame) -> DataFrame:
    """node, cluster, kind: nodes that are equal have one kind; where none is given each is its own."""
    return members if "kind" in members.columns else members.withColumn("kind", F.col("node"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs of kinds from either side; one of a kind with itself once."""
    back = pairs.filter("i <> j").select(F.col("j").alias("kind"), F.col("i").alias("peer"), "similarity")
    return pairs.select(F.col("i").alias("kind"), F.col("j").alias("peer"), "similarity").unionByName(back)


def cannibals(members: DataFrame, pairs: DataFrame, least: float = CANNIBAL) -> DataFrame:
    """cluster, i, j, n_i, n_j, similarity of kinds (i <= j) within a cluster that are alike enough to compete, with
    their nodes there. ``pairs`` (i, j, similarity) may pair a kind with itself, which competes where it has two nodes or more;
    equal nodes are never listed pair by pair."""
    count = _kinds(members).groupBy("kind", "cluster").agg(F.count(F.lit(1)).alias("n"))
    a, b = (count.select(F.col("kind").alias(k), "cluster", F.col("n").alias(f"n_{k}")) for k in ("i", "j"))
    found = pairs.filter(F.col("similarity") >= least).join(a, "i").join(b, ["j", "cluster"])
    return found.filter("i <> j OR n_i > 1").select("cluster", "i", "j", "n_i", "n_j", "similarity")


def cluster_means(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, own, cluster, mean: mean similarity to a cluster's other members, for clusters with any like one; unlisted pairs are zero.

    Sums are made for kinds, not nodes; a node's similarity to itself is taken off in its own cluster.
    """
    m = _kinds(members)
    count = m.groupBy(F.col("kind").alias("peer"), "cluster").agg(F.count(F.lit(1)).alias("nodes"))
    sums = _both_ways(pairs).join(count, "peer").groupBy("kind", "cluster").agg(F.sum(F.col("similarity") * F.col("nodes")).alias("s"), F.coalesce(F.max(F.when(F.col("kind") == F.col("peer"), F.col("similarity"))), F.lit(0)).alias("itself"))
    return means_of(m, sums)


def means_of(members: DataFrame, sums: DataFrame) -> DataFrame:
    """``cluster_means`` of members (node, cluster, kind) from sums (kind, cluster, s, itself): a kind's similarities summed over
    a cluster's nodes, its own included, and that to itself."""
    m = members
    size = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    of = m.select("node", F.col("cluster").alias("own"), "kind").join(sums, "kind").join(size, "cluster")
    at_home = F.coalesce((F.col("own") == F.col("cluster")).cast("int"), F.lit(0))
    others, s = F.col("n") - at_home, F.col("s") - at_home * F.col("itself")
    return of.filter(s > 0).select("node", "own", "cluster", F.when(others > 0, s / others).otherwise(0.0).alias("mean"))


def nearest_cluster(nodes: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, cluster, mean: for each node its best cluster by mean similarity, the least at a tie; null where none is alike."""
    return nearest_of(nodes, cluster_means(members, pairs))


def nearest_of(nodes: DataFrame, means: DataFrame) -> DataFrame:
    """``nearest_cluster`` from ``cluster_means``."""
    best = means.groupBy("node").agg(F.max(F.struct("mean", (-F.col("cluster")).alias("c"))).alias("b"))
    return nodes.join(best, "node", "left").select("node", (-F.col("b.c")).alias("cluster"), F.col("b.mean").alias("mean"))


def dual_members(members: DataFrame, pairs: DataFrame, margin: float = DUAL_MARGIN) -> DataFrame:
    """node, dual: whether another cluster is within ``margin`` of a node's own in mean similarity; a cluster without alike pages is at zero."""
    return dual_of(members, cluster_means(members, pairs), margin)


def dual_of(members: DataFrame, means: DataFrame, margin: float) -> DataFrame:
    """``dual_members`` from ``cluster_means``."""
    own = F.col("cluster") == F.col("own")
    per = means.groupBy("node").agg(F.max(F.when(own, F.col("mean"))).alias("mine"), F.max(F.when(~own, F.col("mean"))).alias("best"))
    several = members.select("cluster").distinct().limit(2).count() > 1
    rows = members.select("node").join(per, "node", "left")
    return rows.select("node", (F.lit(several) & (F.coalesce("mine", F.lit(0.0)) - F.coalesce("best", F.lit(0.0)) <= margin)).alias("dual"))


# --- lookups


def with_members(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left rows joined with right rows whose array columns contain the left's keys ({left key: right array}).

    Arrays become rows, so that it is an equi-join and no pairing of all rows.
    """
    rows = right
    for key, array in keys.items():
        rows = rows.withColumn(key, F.explode(F.array_distinct(array)))
    return left.join(rows.drop(*keys.values()), list(keys))


def by_precedence(rows: DataFrame, key: str, sources: dict[str, DataFrame], default: str) -> DataFrame:
    """``rows`` with value and source: of the first of ``sources`` (key, value; one row a key) that has one, else ``default``."""
    out = rows
    for name, df in sources.items():
        out = out.join(df.select(key, F.col("value").alias(f"from_{name}")), key, "left")
    names = list(sources)
    source = F.coalesce(*[F.when(F.col(f"from_{n}").isNotNull(), n) for n in names], F.lit("default"))
    return out.select(*rows.columns, F.coalesce(*[F.col(f"from_{n}") for n in names], F.lit(default)).alias("value"), source.alias("source"))


def cadence(schedule: DataFrame, tasks: DataFrame, today: Column) -> DataFrame:
    """client, task, frequency, flag, last_done of a schedule: On Track where a task of the client whose name contains the
    first word was done within the frequency's days, At Risk where one is open, else Missed."""
    days = F.create_map(*[F.lit(x) for pair in CADENCE.items() for x in pair])
    s = schedule.select("client", "task", "frequency", F.lower(F.substring_index("task", " ", 1)).alias("word"), F.coalesce(days[F.col("frequency")], F.lit(30)).alias("days"))
    t = tasks.select("client", F.lower("name").alias("name"), "status", "due")
    fits = F.contains("name", "word")
    recent = fits & (F.col("status") == "Done") & (F.col("due") >= F.date_sub(today, F.col("days")))
    open_ = fits & F.col("status").isin("In Progress", "This Week", "Today", "Backlog")
    rows = s.join(t, "client", "left").groupBy("client", "task", "frequency").agg(F.max(F.when(recent, F.col("due"))).alias("last_done"), F.count_if(open_).alias("open"))
    flag = F.when(F.col("last_done").isNotNull(), "On Track").when(F.col("open") > 0, "At Risk").otherwise("Missed")
    return rows.select("client", "task", "frequency", flag.alias("flag"), "last_done")


def dependency_audit(uses: DataFrame, base: DataFrame) -> DataFrame:
    """module, entry, status of uses (module, pattern) and entries (entry, active): OK, ERROR for a missing entry, WARNING for
    an inactive one, TEMPLATE for a pattern with a placeholder; and, without a module, ORPHAN for active entries that none uses."""
    u = uses.select("module", F.col("pattern").alias("entry")).distinct()
    joined = u.join(base, "entry", "left")
    status = F.when(F.contains("entry", F.lit("{")), "TEMPLATE").when(F.col("active").isNull(), "ERROR").when(F.col("active"), "OK").otherwise("WARNING")
    lone = base.filter("active").join(u.select("entry").distinct(), "entry", "left_anti").select(F.lit(None).cast(u.schema["module"].dataType).alias("module"), "entry", F.lit("ORPHAN").alias("status"))
    return joined.select("module", "entry", status.alias("status")).unionByName(lone)


def first_seen(rows: DataFrame, group: str, text: str, order: list[str], most: int = 15) -> DataFrame:
    """group, rank, text: distinct texts, whatever their case, as first seen; ``most`` of each group."""
    key = F.lower(F.trim(text))
    first = rows.filter(F.trim(text) != "").groupBy(group, key.alias("key")).agg(F.min(F.struct(*order, F.trim(text).alias("text"))).alias("f"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("f"))
    return first.select(group, place.alias("rank"), F.col("f.text").alias("text")).filter(F.col("rank") <= most)


# --- claims


def claims(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ordinal, type, inner of the blocks [NEW:type]..[/NEW] with stat, quote or cite; other blocks keep their place in the count."""
    blocks = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"(?s)(\[NEW(?::[a-z]+)?\].*?\[/NEW\])"), 1)
    rows = docs.select(id_col, F.posexplode(blocks).alias("ordinal", "block"))
    kind = F.regexp_extract("block", r"^\[NEW:([a-z]+)\]", 1)
    inner = F.trim(F.regexp_extract("block", r"(?s)^\[NEW:[a-z]+\](.*)\[/NEW\]$", 1))
    return rows.select(id_col, "ordinal", kind.alias("type"), inner.alias("inner")).filter(F.col("type").isin("stat", "quote", "cite"))


def screened(rows: DataFrame, year: int) -> DataFrame:
    """``rows`` (type, inner) with the verdict that needs no lookup: refuted, not_a_claim, or null for one to be checked."""
    t = F.col("inner")
    scrubbed = F.regexp_replace(t, f"(?i){NOT_FIGURES}", " ")
    percent = F.try_to_number(F.regexp_replace(F.regexp_extract(scrubbed, r"([0-9][0-9.,]*)\s*%", 1), r",|\.$", ""), F.lit("999999999999999.999999"))
    future = F.coalesce(F.regexp_extract(t, CITED, 1).try_cast("int") > year, F.lit(False))
    stat = F.when(~scrubbed.rlike(f"(?i){FIGURE}"), "not_a_claim").when(future | (F.coalesce(percent > 100, F.lit(False)) & ~t.rlike(f"(?i){GROWTH}")), "refuted")
    dated = F.coalesce(F.regexp_extract(t, r"\(([0-9]{4})\)", 1).try_cast("int") > year, F.lit(False))
    quote = F.when(~t.rlike(QUOTED), "not_a_claim").when(~t.rlike(SPEAKER) | ~t.rlike(BODY) | dated, "refuted")
    url = F.regexp_extract(t, r"(https?://[^\s)<>\"']+)", 1)
    cite = F.when((url == "") & ~t.rlike(NAMED) & ~t.rlike(CITED), "not_a_claim").when(url.rlike(f"(?i){STAND_IN}"), "refuted")
    verdict = F.when(t.rlike(f"(?i){UNFILLED}"), "refuted").when(F.col("type") == "stat", stat).when(F.col("type") == "quote", quote).otherwise(cite)
    return rows.withColumn("verdict", verdict)


# --- queries


LIKE, WHOLE = 0.08, 10000  # cosines below the first count as zero, others in whole parts of the second, so that sums are exact


def _title_pairs(spark, sf_dir, least: int):
    """Titles of ``least`` ten-thousandths or more by their first pages, each that has terms with itself too."""
    vectors = materialize(unit_vectors(head_weights(read_table(spark, sf_dir, "pages"))))
    found = met(vectors, pairs_from(max(LIKE, (least - 0.5) / WHOLE - 1e-9)), "i bigint, j bigint, v double")
    pairs = found.select("i", "j", F.floor(F.col("v") * WHOLE + 0.5).cast("long").alias("similarity")).filter(F.col("similarity") >= least)
    return pairs.unionByName(vectors.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(WHOLE).cast("long").alias("similarity")))


def _title_means(spark, sf_dir, members: DataFrame) -> DataFrame:
    """``cluster_means`` of titles; the sums are made where blocks of titles meet, so no pairs are listed."""
    vectors = unit_vectors(head_weights(read_table(spark, sf_dir, "pages")))
    there = members.groupBy("kind", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("kind").cast("bigint").alias("id")).agg(F.collect_list(F.struct(F.col("cluster").cast("bigint").alias("c"), "n")).alias("t"))
    placed = vectors.join(there, "id").select(*vectors.columns, F.transform("t", lambda x: x["c"]).alias("clusters"), F.transform("t", lambda x: x["n"]).alias("counts"))
    like = lambda d: np.where(d >= LIKE, np.floor(d * WHOLE + 0.5), 0.0)
    sums = met(materialize(placed), sums_by(like, WHOLE), "x bigint, c bigint, s bigint").groupBy(F.col("x").alias("kind"), F.col("c").alias("cluster")).agg(F.sum("s").alias("s"))
    return means_of(members, sums.withColumn("itself", F.lit(WHOLE)))


def _fifths(spark, sf_dir):
    """Pages in five clusters by id, with the first page of the same title as their kind."""
    return title_classes(spark, sf_dir).select(F.col("page_id").alias("node"), (F.col("page_id") % 5).alias("cluster"), F.col("class_id").alias("kind"))


def title_cannibals(spark, sf_dir):
    """Like titles of one cluster, each by its first page, with their pages there; ``title_classes`` has the pages of each."""
    return cannibals(_fifths(spark, sf_dir), _title_pairs(spark, sf_dir, 3000), 3000)


def title_nearest_cluster(spark, sf_dir):
    """Each page's nearest cluster by titles."""
    m = _fifths(spark, sf_dir)
    return nearest_of(m.select("node"), _title_means(spark, sf_dir, m)).select("node", "cluster", half_up(F.col("mean"), 3).alias("mean"))


def title_dual_members(spark, sf_dir):
    """Pages that belong to another cluster nearly as well."""
    m = _fifths(spark, sf_dir)
    return dual_of(m, _title_means(spark, sf_dir, m), 10)


def layers_by_membership(spark, sf_dir):
    """Customers with the suppliers that serve both their nation and their segment: how many, and the first."""
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    k = F.col("s_suppkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25).alias("nations"), F.array(F.element_at(segments, (k % 5 + 1).cast("int")), F.element_at(segments, ((k + 2) % 5 + 1).cast("int"))).alias("serves"))
    c = read_table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    return with_members(c, s, {"c_nationkey": "nations", "c_mktsegment": "serves"}).groupBy("c_nationkey", "c_mktsegment", "customers").agg(F.count(F.lit(1)).alias("suppliers"), F.min("s_suppkey").alias("first"))


def precedence_merge(spark, sf_dir):
    """A type for each part: the buyer's, else the model's, else the cache's, else "other"."""
    p = read_table(spark, sf_dir, "part")
    pick = lambda c, v: p.filter(c).select("p_partkey", v.alias("value"))
    sources = {"override": pick("p_size < 5", F.col("p_brand")), "model": pick("p_retailprice > 1200", F.col("p_type")), "cache": pick("p_partkey % 3 = 0", F.col("p_name"))}
    return by_precedence(p.select("p_partkey"), "p_partkey", sources, "other")


def task_cadence(spark, sf_dir):
    """Orders as tasks of customers, who each have a recurring one."""
    c, o = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    every = F.element_at(F.array(*[F.lit(f) for f in CADENCE]), (F.col("c_custkey") % 4 + 1).cast("int"))
    schedule = c.select(F.col("c_custkey").alias("client"), F.concat((F.col("c_custkey") % 5 + 1).cast("string"), F.lit("- review")).alias("task"), every.alias("frequency"))
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Backlog").otherwise("Dropped")
    tasks = o.select(F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("name"), status.alias("status"), F.col("o_orderdate").cast("date").alias("due"))
    return cadence(schedule, tasks, F.to_date(F.lit("2000-06-01"))).withColumn("last_done", F.col("last_done").cast("string"))


def order_dependencies(spark, sf_dir):
    """Orders that use parts, as modules and entries of a base: counts by status."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), F.when(F.col("l_linenumber") == 7, "{part}").otherwise((F.col("l_partkey") + F.when(F.col("l_linenumber") == 6, 1000000).otherwise(0)).cast("string")).alias("pattern"))
    base = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("entry"), (F.col("p_size") > 10).alias("active"))
    return dependency_audit(lines, base).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entry").alias("entries"))


def turns_first_seen(spark, sf_dir):
    """Distinct first words of a conversation's turns, as first said."""
    t = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\s.,!?]+)", 1).alias("word"))
    return first_seen(t, "conv_id", "word", ["turn", "role"], 3)


def claim_screen(spark, sf_dir):
    """Lines of documents with a figure, a quotation mark or an address, as marked claims, by verdict."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    kind = F.when(F.contains("line", F.lit("http")), "cite").when(F.contains("line", F.lit('"')), "quote").when(F.col("line").rlike("[0-9]"), "stat")
    marked = d.select("doc_id", F.concat(F.lit("[NEW:"), kind, F.lit("]"), "line", F.lit("[/NEW] and [NEW:link]x[/NEW]")).alias("text"))
    return screened(claims(marked, "doc_id", "text"), 2024).groupBy("type", "verdict").agg(F.count(F.lit(1)).alias("claims"))


QUERIES = {f.__name__: f for f in (title_cannibals, title_nearest_cluster, title_dual_members, layers_by_membership, precedence_merge, task_cadence, order_dependencies, turns_first_seen, claim_screen)}

#: Page by page, from the pages' own words; nothing is shared with the Spark form but the definition.
_PAIRS = r"""words AS (SELECT page_id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+')) AS t FROM pages),
  tf AS (SELECT page_id, t, count(*) AS f FROM words WHERE length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') GROUP BY ALL), total AS (SELECT count(*) AS n FROM pages),
  wt AS (SELECT page_id, t, f * ln(n / df) AS w FROM tf JOIN (SELECT t, count(*) AS df FROM tf GROUP BY t) USING (t), total WHERE df / n <= 0.6), unit AS (SELECT page_id, t, w / sqrt(sum(w * w) OVER (PARTITION BY page_id)) AS w FROM wt WHERE w <> 0),
  m AS (SELECT page_id AS node, page_id % 5 AS cluster, min(page_id) OVER (PARTITION BY regexp_extract(html, '<title>([^<]*)</title>', 1)) AS kind FROM pages),
  ways AS (SELECT a.page_id AS node, b.page_id AS peer, CAST(round(floor(sum(a.w * b.w) * 10000 + 0.5)) AS BIGINT) AS s FROM unit a JOIN unit b ON a.t = b.t AND a.page_id <> b.page_id GROUP BY a.page_id, b.page_id HAVING sum(a.w * b.w) >= 0.08)"""
_MEANS = f"""{_PAIRS}, size AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1), means AS (SELECT ways.node AS node, p.cluster AS cluster, o.cluster AS own, sum(s) / (n - CAST(p.cluster = o.cluster AS INT)) AS mean FROM ways JOIN m p ON ways.peer = p.node JOIN m o ON ways.node = o.node JOIN size ON size.cluster = p.cluster GROUP BY ways.node, p.cluster, o.cluster, n)"""


def _sql_regex(p: str) -> str:
    return p.replace("'", "''")


ORACLE_SQL = {
    "title_cannibals": f"""WITH {_PAIRS}, own AS (SELECT cluster, kind, count(*) AS n FROM m GROUP BY ALL),
      like_ AS (SELECT DISTINCT a.cluster AS cluster, a.kind AS i, b.kind AS j, s FROM ways JOIN m a ON a.node = ways.node JOIN m b ON b.node = ways.peer WHERE a.cluster = b.cluster AND a.kind <= b.kind AND s >= 3000)
      SELECT l.cluster AS cluster, i, j, x.n AS n_i, y.n AS n_j, s AS similarity FROM like_ l JOIN own x ON x.cluster = l.cluster AND x.kind = i JOIN own y ON y.cluster = l.cluster AND y.kind = j""",
    "title_nearest_cluster": f"WITH {_MEANS}, r AS (SELECT node, cluster, mean FROM means QUALIFY row_number() OVER (PARTITION BY node ORDER BY mean DESC, cluster) = 1) SELECT m.node AS node, r.cluster AS cluster, floor(mean * 1000 + 0.5) / 1000 AS mean FROM m LEFT JOIN r USING (node)",
    "title_dual_members": f"WITH {_MEANS} SELECT m.node AS node, coalesce(max(CASE WHEN means.cluster = own THEN mean END), 0) - coalesce(max(CASE WHEN means.cluster <> own THEN mean END), 0) <= 10 AS dual FROM m LEFT JOIN means USING (node) GROUP BY 1",
    "layers_by_membership": """WITH s AS (SELECT s_suppkey, [s_nationkey, (s_nationkey + 7) % 25] AS ns, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'] AS g FROM supplier), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL)
      SELECT c.*, count(*) AS suppliers, min(s_suppkey) AS first FROM c JOIN s ON list_contains(ns, c_nationkey) AND list_contains([g[s_suppkey % 5 + 1], g[(s_suppkey + 2) % 5 + 1]], c_mktsegment) GROUP BY ALL""",
    "precedence_merge": "SELECT p_partkey, CASE WHEN p_size < 5 THEN p_brand WHEN p_retailprice > 1200 THEN p_type WHEN p_partkey % 3 = 0 THEN p_name ELSE 'other' END AS value, CASE WHEN p_size < 5 THEN 'override' WHEN p_retailprice > 1200 THEN 'model' WHEN p_partkey % 3 = 0 THEN 'cache' ELSE 'default' END AS source FROM part",
    "task_cadence": f"""WITH s AS (SELECT c_custkey AS client, (c_custkey % 5 + 1) || '- review' AS task, {list(CADENCE)}[c_custkey % 4 + 1] AS frequency, {list(CADENCE.values())}[c_custkey % 4 + 1] AS days FROM customer),
      j AS (SELECT client, task, frequency, max(CASE WHEN o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= DATE '2000-06-01' - CAST(days AS INT) THEN CAST(o_orderdate AS DATE) END) AS last_done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open
        FROM s LEFT JOIN orders ON o_custkey = client AND contains(lower(o_orderpriority), split_part(task, ' ', 1)) GROUP BY ALL)
      SELECT client, task, frequency, CASE WHEN last_done IS NOT NULL THEN 'On Track' WHEN open > 0 THEN 'At Risk' ELSE 'Missed' END AS flag, strftime(last_done, '%Y-%m-%d') AS last_done FROM j""",
    "order_dependencies": """WITH u AS (SELECT DISTINCT l_orderkey AS module, CASE l_linenumber WHEN 7 THEN '{part}' WHEN 6 THEN CAST(l_partkey + 1000000 AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS entry FROM lineitem),
      b AS (SELECT CAST(p_partkey AS VARCHAR) AS entry, p_size > 10 AS active FROM part),
      r AS (SELECT entry, CASE WHEN entry = '{part}' THEN 'TEMPLATE' WHEN active IS NULL THEN 'ERROR' WHEN active THEN 'OK' ELSE 'WARNING' END AS status FROM u LEFT JOIN b USING (entry) UNION ALL SELECT entry, 'ORPHAN' FROM b WHERE active AND entry NOT IN (SELECT entry FROM u))
      SELECT status, count(*) AS n, count(DISTINCT entry) AS entries FROM r GROUP BY 1""",
    "turns_first_seen": r"""WITH w AS (SELECT conv_id, turn, role, regexp_extract(coalesce(text, ''), '^([^\s.,!?]+)', 1) AS word FROM conversations), f AS (SELECT * FROM w WHERE word <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(word) ORDER BY turn, role, word) = 1)
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, word) AS rank, word AS text FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, word) <= 3""",
    "claim_screen": f"""WITH d AS (SELECT trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS t FROM documents), k AS (SELECT t, CASE WHEN contains(t, 'http') THEN 'cite' WHEN contains(t, '"') THEN 'quote' WHEN regexp_matches(t, '[0-9]') THEN 'stat' END AS type FROM d),
      s AS (SELECT *, regexp_replace(t, '(?i){_sql_regex(NOT_FIGURES)}', ' ', 'g') AS u, regexp_extract(t, '(https?://[^\\s)<>"'']+)', 1) AS url FROM k WHERE type IS NOT NULL),
      v AS (SELECT type, CASE WHEN regexp_matches(t, '(?i){_sql_regex(UNFILLED)}') THEN 'refuted' WHEN type = 'stat' THEN CASE WHEN NOT regexp_matches(u, '(?i){_sql_regex(FIGURE)}') THEN 'not_a_claim'
          WHEN coalesce(TRY_CAST(regexp_extract(t, '{_sql_regex(CITED)}', 1) AS INT) > 2024, false) OR (coalesce(TRY_CAST(replace(regexp_extract(u, '([0-9][0-9.,]*)\\s*%', 1), ',', '') AS DOUBLE) > 100, false) AND NOT regexp_matches(t, '(?i){GROWTH}')) THEN 'refuted' END
        WHEN type = 'quote' THEN CASE WHEN NOT regexp_matches(t, '{_sql_regex(QUOTED)}') THEN 'not_a_claim' WHEN NOT regexp_matches(t, '{_sql_regex(SPEAKER)}') OR NOT regexp_matches(t, '{_sql_regex(BODY)}') OR coalesce(TRY_CAST(regexp_extract(t, '\\(([0-9]{{4}})\\)', 1) AS INT) > 2024, false) THEN 'refuted' END
        ELSE CASE WHEN url = '' AND NOT regexp_matches(t, '{_sql_regex(NAMED)}') AND NOT regexp_matches(t, '{_sql_regex(CITED)}') THEN 'not_a_claim' WHEN regexp_matches(url, '(?i){STAND_IN}') THEN 'refuted' END END AS verdict FROM s)
      SELECT type, verdict, count(*) AS claims FROM v GROUP BY ALL""",
}
