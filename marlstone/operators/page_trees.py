"""HTML pages as trees, and the JSON-LD inside them as nodes.

One fold over a page's tag stream, with a stack of the open elements, gives the
elements in document order: an element's index, its parent's, its depth, the index of its last
descendant (so that "inside" is a comparison of indexes), its attributes, and its range in the
page's text. Relations between elements then are expressions over the array of
a page; nothing is exploded or shuffled.

Stated rules, of which a full parser has more: comments, and the insides of RAW elements, are
no markup; VOID elements hold nothing; CLOSES names what an opening tag ends by itself; an end
tag ends the nearest open element of its name with all inside it, unless a boundary lies
between, and else nothing; html and body are added where a page has none, and end with the page. Formatting
that is left open isn't carried on into the next paragraph. A tag ends at the first ">" outside
quotes. The page's text is free of what SILENT elements hold, with entities resolved.

A null page is an empty one: html and body alone. Repeated rows are rows of their own.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table

# Elements without content, with raw content, without text, of the head; ends that opening tags imply, with what shields from them.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style", "noscript", "title", "textarea")
SILENT = ("script", "style", "noscript")
HEAD = ("html", "head", "title", "meta", "link", "script", "style", "base", "noscript")
BLOCKS = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
SCOPE = ("table", "td", "th", "caption", "button", "body")
CLOSES = {
    **{b: (("p",), SCOPE) for b in BLOCKS},
    "li": (("li",), ("ul", "ol", *SCOPE)),
    "dt": (("dt", "dd"), ("dl", *SCOPE)),
    "dd": (("dt", "dd"), ("dl", *SCOPE)),
    "option": (("option",), ("select", *SCOPE)),
    "a": (("a",), SCOPE),
    "button": (("button",), ("table", "td", "th", "caption", "body")),
    "td": (("td", "th"), ("tr", "table", "body")),
    "th": (("td", "th"), ("tr", "table", "body")),
    "tr": (("tr",), ("table", "body")),
    **{s: (("thead", "tbody", "tfoot"), ("table", "body")) for s in ("thead", "tbody", "tfoot")},
}
TABLE = ("table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th")
INLINE = ("a", "abbr", "b", "cite", "code", "em", "font", "i", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u")

_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
TOKEN = r"(?is)<!--.*?-->|<[!?][a-z][^>]*>|" + "|".join(rf"<{t}(?:[\s/]{_REST})?>.*?</{t}\s*>" for t in RAW) + rf"|</?[a-z][a-z0-9-]*(?:[\s/]{_REST})?>"
_TOKEN, _NAME = re.compile(TOKEN), re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_OPEN = re.compile(rf"(?is)<[a-z][a-z0-9-]*((?:[\s/]{_REST})?)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

NODE = "struct<k:int,tag:string,a:map<string,string>,parent:int,depth:int,last:int,start:int,stop:int>"
TREE = f"nodes array<{NODE}>, text string, linked array<string>, comments array<string>"


def attributes(tag: str) -> dict[str, str]:
    """Names in lower case with their values, without entities; of a repeated name the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(_OPEN.match(tag)[1]):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


def shielded(tag: str) -> tuple[str, ...]:
    """What an end tag does not reach beyond."""
    return BLOCKS + SCOPE if tag in INLINE else ("table", "body") if tag in TABLE else SCOPE


def grown(page: str) -> tuple[list[dict], str, list[str], list[str]]:
    """Elements, text, JSON-LD blocks and comments of a page."""
    nodes: list[dict] = []
    open_: list[int] = []
    text: list[str] = []
    linked, comments = [], []
    length = at = 0

    def end(depth: int) -> None:
        while len(open_) > depth:
            nodes[open_.pop()].update(last=len(nodes) - 1, stop=length)

    def nearest(names: tuple[str, ...], shields: tuple[str, ...]) -> int:
        for i in range(len(open_) - 1, -1, -1):
            tag = nodes[open_[i]]["tag"]
            if tag in names:
                return i
            if tag in shields:
                break
        return -1

    def start(tag: str, a: dict[str, str]) -> None:
        nodes.append({"k": len(nodes), "tag": tag, "a": list(a.items()), "parent": open_[-1] if open_ else -1, "depth": len(open_), "last": 0, "start": length, "stop": 0})
        open_.append(len(nodes) - 1)

    def say(s: str) -> None:
        nonlocal length
        if s:
            if not any(nodes[k]["tag"] in ("head", "body") for k in open_) and s.strip():
                inside("p")
            s = html.unescape(s)
            text.append(s)
            length += len(s)

    def inside(tag: str) -> None:
        """Add html and body where ``tag`` needs them."""
        if not nodes and tag != "html":
            start("html", {})
        if tag not in HEAD and tag != "body" and not any(nodes[k]["tag"] == "body" for k in open_):
            end(1)
            start("body", {})

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at, token = m.end(), m[0]
        if token.startswith("<!--"):
            comments.append(token[4:-3])
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag in ("html", "body"):
                continue
            i = nearest((tag,), shielded(tag))
            if i >= 0:
                end(i)
            continue
        if tag in ("html", "body") and any(n["tag"] == tag for n in nodes):
            continue
        inside(tag)
        if tag == "body":
            end(1)
        names, shields = CLOSES.get(tag, ((), ()))
        i = nearest(names, shields) if names else -1
        if i >= 0:
            end(i)
        a = attributes(token)
        start(tag, a)
        if tag in RAW and (close := re.search(r"(?i)</[a-z]+\s*>$", token)) and (head := _OPEN.match(token)).end() <= close.start():
            body = token[head.end() : close.start()]
            if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
                linked.append(body)
            if tag not in SILENT:
                body = html.unescape(body)
                text.append(body)
                length += len(body)
            end(len(open_) - 1)
        elif tag in VOID:
            end(len(open_) - 1)
    say(page[at:])
    inside("p")
    end(0)
    return nodes, "".join(text), linked, comments


def trees(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` with nodes, text, linked (JSON-LD blocks) and comments."""
    names = pages.columns
    d = pages.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(html_col)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(pages.schema))
    node = pa.struct([("k", pa.int32()), ("tag", pa.string()), ("a", pa.map_(pa.string(), pa.string())), *[(c, pa.int32()) for c in ("parent", "depth", "last", "start", "stop")]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [grown(p or "") for p in part.column(at).to_pylist()]
                columns = [pa.array([f[0] for f in found], pa.list_(node)), pa.array([f[1] for f in found], pa.string()), *[pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (2, 3)]]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "nodes", "text", "linked", "comments"])

    grown_ = d.mapInArrow(scan, f"{kinds}, {TREE}")
    return grown_.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *[F.col(c).alias(c) for c in ("nodes", "text", "linked", "comments")])


def inside(n: Column, outer: Column) -> Column:
    """Is node ``n`` a descendant of ``outer``?"""
    return (n["k"] > outer["k"]) & (n["k"] <= outer["last"])


def text_of(text: Column, n: Column) -> Column:
    return F.substring(text, n["start"] + 1, n["stop"] - n["start"])


def tree_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each element: page, k, tag, parent, depth, last, ancestors (outermost first), chars of its text."""
    t = trees(pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html"))).select("page", "nodes", F.explode("nodes").alias("n"))
    above = F.transform(F.filter("nodes", lambda m: (m["k"] < F.col("n.k")) & (m["last"] >= F.col("n.k"))), lambda m: m["tag"])
    return t.select("page", "n.k", "n.tag", "n.parent", "n.depth", "n.last", F.concat_ws(">", above).alias("ancestors"), (F.col("n.stop") - F.col("n.start")).alias("chars"))


# --- JSON-LD

# Properties that hold further entities.
NESTED = ("employee", "member", "founder", "author", "provider", "physician", "department", "breadcrumb", "itemReviewed", "subOrganization", "parentOrganization", "review", "makesOffer", "hasOfferCatalog")
DEPTH = 5  # properties that are followed into each other
ENTITY = "struct<depth:int,types:array<string>,json:string>"


def entities(block: str) -> list[dict] | None:
    """Typed objects of a JSON-LD block in reading order, those of a graph before its holder, those of properties after it;
    lists and graphs are opened where they stand. None for what is no JSON."""
    try:
        root = json.loads(block)
    except (ValueError, RecursionError):
        return None
    out, todo = [], [(root, 0, False)]
    while todo:
        v, depth, opened = todo.pop()
        if isinstance(v, list):
            todo += [(x, depth, False) for x in reversed(v)]
        elif isinstance(v, dict) and depth <= DEPTH:
            if v.get("@graph") and not opened:
                todo += [(v, depth, True), (v["@graph"], depth, False)]
                continue
            if types := [str(t) for t in (v["@type"] if isinstance(v.get("@type"), list) else [v.get("@type")]) if t]:
                out.append({"depth": depth, "types": types, "json": json.dumps(v, ensure_ascii=False)})
            todo += [(v[k], depth + 1, False) for k in reversed(NESTED) if v.get(k)]
    return out


def with_entities(tree_rows: DataFrame) -> DataFrame:
    """The rows of ``trees`` with their JSON-LD's entities and how many blocks are broken."""

    @F.pandas_udf(f"struct<entities:array<{ENTITY}>,broken:int>")
    def walk(blocks: pd.Series) -> pd.DataFrame:
        found = [[entities(b) for b in page] for page in blocks]
        return pd.DataFrame({"entities": [[e for f in page for e in f or ()] for page in found], "broken": [sum(f is None for f in page) for page in found]})

    return tree_rows.withColumn("_w", walk("linked")).select("*", "_w.entities", "_w.broken").drop("_w")


def schema_entities(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each entity, and for each page's broken blocks one with their number: page, place, depth, type (joined), name, error."""
    t = with_entities(trees(pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html")))).select("page", "entities", "broken")
    bad = F.when(F.col("broken") > 0, F.array(F.struct(F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("types"), F.lit(None).cast("string").alias("json")))).otherwise(F.array())
    rows = t.select("page", "broken", F.posexplode(F.concat("entities", bad)).alias("place", "e"))
    name = F.try_variant_get(F.try_parse_json("e.json"), "$.name", "string")
    return rows.select("page", "place", "e.depth", F.array_join("e.types", ",").alias("type"), name.alias("name"), F.when(F.col("e.json").isNull(), F.concat(F.col("broken").cast("string"), F.lit(" broken"))).alias("error"))
