"""Registered queries of the library and their SQL."""

from __future__ import annotations

from ..operators import checks, classify, collections, joins, keywords, keyword_match, market, page_checks, page_dressed, phrases, regions, reports, sites, store, text, topics, writing
from ..sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (keywords, market, store, text, sites, checks, collections, phrases, reports, keyword_match, page_checks, page_dressed, classify, joins, writing, topics, regions, files):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
