"""URL and slug expressions, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1))


def normalize_url(url: Column) -> Column:
    """Host in lower case, no query and fragment, no trailing slashes but the root's; null unless absolute."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    whole = F.concat(scheme, F.lit("://"), host(url), F.when(path == "", "/").otherwise(path))
    return F.when(url.rlike(r"^[a-zA-Z]+://[^/?#]+"), whole)


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def root_domain(url: Column) -> Column:
    """The host's last two labels, without www."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    return F.substring_index(h, ".", -2)


def slugify(text: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def template(url: Column) -> Column:
    """Path with dates, numbers and long slugs as placeholders."""
    seg = lambda s: (
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(s.rlike(r"^[0-9]+(\.html?)?$"), "{n}")
        .when(s.rlike(r"^[a-z0-9]+(-[a-z0-9]+){2,}$"), "{slug}")
        .otherwise(s)
    )
    return F.concat(F.lit("/"), F.array_join(F.transform(path_segments(url), seg), "/"))


# Page types with the path patterns that tell them, first match wins; a default, to be replaced by a user's own.
PAGE_TYPES = (
    ("home", r"^/?$"),
    ("blog", r"/(blog|news|articles?|posts?)(/|$)"),
    ("product", r"/(products?|shop|store)(/|$)"),
    ("service", r"/(services?|solutions?)(/|$)"),
    ("location", r"/(locations?|areas?)(/|$)"),
    ("language", r"^/(en|fr|de|es)(/|$)"),
)


def page_type(path: Column, rules=PAGE_TYPES) -> Column:
    """The first rule's type that fits the path, or "other"."""
    out = F.lit("other")
    for name, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out
