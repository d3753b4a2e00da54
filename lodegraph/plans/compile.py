"""Query objects to DataFrame plans. One conjunction of predicates; Catalyst chooses the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.functions.jql import Query, parse_jql
from lodegraph.operators import graph as G
from lodegraph.operators import text as T
from lodegraph.operators.traverse import reach

HOPS = 3
COLUMN_WEIGHTS = {"symbol_name": 10.0, "signature": 4.0, "docstring": 2.0, "source_text": 1.0}


def name_matches(name: Column, value: str) -> Column:
    """Glob, else the name itself or a part of it, without regard to case."""
    low = F.lower(name)
    if any(c in value for c in "*?["):
        return low.rlike(X.glob_regex(value.lower()))
    return F.contains(low, F.lit(value.lower()))


def _compare(column: Column, op: str, value: str) -> Column:
    """The comparison; with what is no whole number nothing compares."""
    if not value.removeprefix("-").isdecimal():
        return F.lit(False)
    n = int(value)
    return {">": column > n, ">=": column >= n, "<": column < n, "<=": column <= n}.get(op, column == n)


def compile_query(query: Query | str, nodes: DataFrame, edges: DataFrame, strict: bool = True) -> DataFrame:
    """Matching nodes with their degree, most connected first, ties by node id, cut at the query's limit.

    Filters come before the limit. With `related:` the relations of `has_rel:` restrict the walk; alone they ask for
    an edge of any of the types at the node. With strict=False an OR in the text makes the index clauses alternatives.
    """
    q = parse_jql(query) if isinstance(query, str) else query
    tests: list[Column] = []
    if q.types:
        tests.append(F.col("symbol_type").isin(q.types))
    if q.layer:
        tests.append(X.layer(F.col("symbol_type"), F.coalesce("symbol_name", F.lit("")), F.col("parent_symbol"), F.col("rel_path")) == q.layer)
    tests += [X.matches_path(F.col("rel_path"), v) for v in q.values("file")[:1]]
    tests += [name_matches(F.col("symbol_name"), v) for v in q.values("name")[:1]]
    if q.text:
        words = T.tokens(F.concat_ws(" ", *[c for c in COLUMN_WEIGHTS if c in nodes.columns]))
        tests.append(T.matches(words, T.all_terms(q.text)))
    got = nodes
    if tests:
        if q.any_of and not strict:
            got = got.where(X.any_of(tests))
        else:
            for t in tests:
                got = got.where(t)
    related, relations = q.first("related"), q.relations
    if related:
        anchor = nodes.where(F.lower("symbol_name") == related.lower()).select("node_id")
        used = edges.where(F.col("rel_type").isin(G.edge_types(relations))) if relations else edges
        got = got.join(reach(used, anchor, HOPS, q.direction).select("node_id").distinct(), "node_id", "left_semi")
    elif relations:
        got = G.has_relation(got, edges, *relations)
    got = G.with_degree(got, edges)
    for c in q.connections:
        got = got.where(_compare(F.col("degree"), c.op, c.value))
    return got.select("node_id", "symbol_name", "symbol_type", "rel_path", "degree").orderBy(F.desc("degree"), "node_id").limit(q.limit)
