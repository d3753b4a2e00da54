"""One object over a folder of tables: the calls a user of a code-graph service makes, each giving a DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.jql import is_jql, parse_question
from lodegraph.operators import enrichment, expansion, traverse
from lodegraph.operators import graph as G
from lodegraph.operators import text as T
from lodegraph.plans.compile import COLUMN_WEIGHTS, compile_query
from lodegraph.sources.tables import table


class CodeGraph:
    """All repositories of a folder, or some of them. Views are lazy; nothing runs before a result is read."""

    def __init__(self, spark: SparkSession, folder: str, repositories: list[str] | None = None):
        self.spark, self.folder, self.repositories = spark, folder, repositories

    def _mine(self, df: DataFrame) -> DataFrame:
        return df if self.repositories is None else df.where(F.col("wiki_id").isin(self.repositories))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._mine(G.nodes_view(table(self.spark, self.folder, "repo_nodes"), "signature", "docstring", "source_text"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._mine(G.edges_view(table(self.spark, self.folder, "repo_edges")))

    def query(self, text: str) -> DataFrame:
        """Symbols for a query in the field language or in words."""
        return compile_query(text if is_jql(text) else parse_question(text).to_jql(), self.nodes, self.edges)

    def search(self, text: str, k: int = 20) -> DataFrame:
        return T.top(T.bm25(self.nodes, "node_id", COLUMN_WEIGHTS, T.parse_query(text), ["symbol_name", "symbol_type", "rel_path"]), "node_id", k)

    def resolve(self, names: list[str]) -> DataFrame:
        return enrichment.resolve(self.nodes, self.spark.createDataFrame([(n,) for n in names], "key string"))

    def relationships(self, node_id: str, depth: int = 1, direction: str = "both", min_confidence: str | None = None, limit: int = 100) -> DataFrame:
        return traverse.relationships(self.edges, self.spark.createDataFrame([(node_id,)], "node_id string"), depth, direction, min_confidence, top=limit)

    def path(self, start: str, goal: str, max_depth: int = 25) -> DataFrame:
        return traverse.shortest_path(self.edges, start, goal, max_depth)

    def expand(self, ids: list[str], budget: int = 10) -> DataFrame:
        return expansion.expand(self.nodes, self.edges, self.spark.createDataFrame([(i,) for i in ids], "node_id string"), budget)

    def code(self, node_id: str, offset: int = 0, limit: int = 200) -> DataFrame:
        """Lines of a symbol's text."""
        return self.nodes.where(F.col("node_id") == node_id).select("node_id", F.array_join(F.slice(F.split("source_text", "\n"), offset + 1, limit), "\n").alias("code"))

    def files(self, pattern: str = "*") -> DataFrame:
        from lodegraph.functions.scalars import matches_path

        return self.nodes.where("symbol_type = 'module'").where(matches_path(F.col("rel_path"), pattern)).select("wiki_id", "rel_path").distinct()

    def grep(self, pattern: str) -> DataFrame:
        return T.grep(self.nodes.where("symbol_type = 'module'"), "rel_path", "source_text", pattern)

    def stats(self) -> DataFrame:
        return G.stats(self.nodes, self.edges)

    def god_nodes(self, top: int = 20) -> DataFrame:
        return G.god_nodes(self.nodes, self.edges, top)

    def surprising(self, top: int = 10, depth: int = 1) -> DataFrame:
        return G.surprising_connections(self.nodes, self.edges, depth, top)

    def community(self, node_id: str) -> DataFrame:
        """The nodes that share a macro cluster with a node."""
        own = self.nodes.where(F.col("node_id") == node_id).select("wiki_id", "macro_cluster")
        return self.nodes.join(F.broadcast(own), ["wiki_id", "macro_cluster"]).select("node_id", "symbol_name", "symbol_type", "rel_path")
