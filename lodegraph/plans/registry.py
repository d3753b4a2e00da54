"""All queries of the core library, by name."""

from __future__ import annotations

from lodegraph.plans import communities, context, dataprep, federation, linkage, passes, retrieval, search, structure

FLAGSHIP = "god_nodes"
_MODULES = (dataprep, structure, search, linkage, communities, context, passes, federation, retrieval)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
