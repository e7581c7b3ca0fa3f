"""Registered queries of the audit engine and their SQL twins, by subject."""

from . import access, branches, crawled, pages, sites, state, structured, texts, web

_PARTS = (pages, texts, sites, structured, crawled, state, branches, access, web)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
