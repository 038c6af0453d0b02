"""All registered queries: name -> (function, expected SQL or None)."""

from __future__ import annotations

from . import fields, products, sessions, streams, urls


def all_queries() -> dict:
    groups = (urls, fields, products, sessions, streams)
    return {name: q for g in groups for name, q in g.QUERIES.items()}
