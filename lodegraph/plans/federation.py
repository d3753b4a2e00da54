"""Queries over folders, documents and repositories as graphs of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import scalars as X
from lodegraph.operators import clustering as C
from lodegraph.operators import enrichment as R
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.operators import traverse as P
from lodegraph.plans.context import page_links
from lodegraph.plans.linkage import CLASS_LINKS, SURFACES, cross_repository_edges
from lodegraph.plans.prelude import WITH, WITHR
from lodegraph.sources.bundles import pages_as_markdown
from lodegraph.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("folder_clusters")
def folder_clusters(s, d):
    """Communities of the folders of each repository by their weighted relations."""
    n, e = G.graph(s, d)
    folders = n.where("rel_path <> ''").select(F.col("wiki_id").alias("part"), X.dirname(F.col("rel_path")).alias("node")).distinct()
    links = G.dir_interactions(n, e).groupBy(F.col("wiki_id").alias("part"), F.least("from_dir", "to_dir").alias("a"), F.greatest("from_dir", "to_dir").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    return C.renumber(C.louvain(folders, links, 1.0, 1)).select(F.col("part").alias("wiki_id"), F.col("node").alias("dir"), "cluster")


@query("document_clusters")
def document_clusters(s, d):
    """Communities of documents over the targets they link: documents and targets are both nodes, so a target that many share costs a link each. Documents that share no target are left out."""
    links = page_links(s, d)
    shared = links.join(links.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("target"), "target", "left_semi")
    ends = shared.select(F.lit("docs").alias("part"), F.concat(F.lit("d:"), F.col("source").cast("string")).alias("a"), F.concat(F.lit("t:"), F.col("target")).alias("b"), F.lit(1.0).alias("w"))
    nodes = ends.select("part", F.explode(F.array("a", "b")).alias("node")).distinct()
    found = C.renumber(C.louvain(nodes, ends, 1.0, 1))
    return found.where("node like 'd:%'").select(F.substring("node", 3, 20).alias("doc_id"), "cluster")


@query("project_communities")
def project_communities(s, d):
    """Communities of repositories over the links between them."""
    e = cross_repository_edges(s, d).select(F.lit("project").alias("part"), F.col("wiki_a").alias("a"), F.col("wiki_b").alias("b"), (F.col("weight") * F.col("n_surfaces")).alias("w"))
    nodes = e.select("part", F.explode(F.array("a", "b")).alias("node")).distinct()
    return C.renumber(C.louvain(nodes, e, 1.0, 1)).select(F.col("node").alias("wiki_id"), "cluster")


@query(
    "call_tree",
    f"""{WITHR}, sd as (select min(node_id) as node_id from n where symbol_type = 'constructor'), g as (select source_id, target_id, rel_type from e where rel_type in ('calls', 'invokes')), r(node_id, hop) as (select node_id, 0 from sd union select g.target_id, hop + 1 from r join g on g.source_id = r.node_id where hop < 2)
select g.source_id, g.target_id, min(r.hop) + 1 as hop from g join r on r.node_id = g.source_id group by 1, 2""",
)
def call_tree(s, d):
    """What a constructor calls, three levels deep."""
    n, e = G.graph(s, d)
    seed = n.where("symbol_type = 'constructor'").agg(F.min("node_id").alias("node_id"))
    return P.relationships(e, seed, 3, "out", rel_types=["calls"]).groupBy("source_id", "target_id").agg(F.min("hop").cast("long").alias("hop"))


@query(
    "federated_traversal",
    f"""{WITHR}, sd as (select node_id from project_nodes), st as (select distinct target_id as h, source_id as t from e), r(seed, node_id, hop) as (select node_id, node_id, 0 from sd union select r.seed, st.t, hop + 1 from r join st on st.h = r.node_id where hop < 2)
select seed, count(distinct node_id) - 1 as n_reached from r group by 1""",
)
def federated_traversal(s, d):
    """How many nodes of all repositories lie within two references of each shared symbol."""
    e = G.edges_view(table(s, d, "repo_edges"))
    seeds = table(s, d, "project_nodes").select("node_id").distinct()
    got = P.reach(e, seeds, 2, "in").groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return seeds.select(F.col("node_id").alias("seed")).join(got, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n_reached"))


@query("hybrid_orphans")
def hybrid_orphans(s, d):
    return R.hybrid_orphans(*G.graph(s, d), table(s, d, "repo_vec"))


_PRIO = "case symbol_type " + " ".join(f"when '{k}' then {v}" for k, v in S.TYPE_PRIORITY.items()) + " else 0 end"


@query(
    "coverage_gaps",
    f"{WITH}, g as (select node_id, count(*) as degree from (select source_id as node_id from e union all select target_id from e) group by 1) select n.node_id, symbol_type, {_PRIO} as priority, coalesce(degree, 0) as degree from n left join g on g.node_id = n.node_id where is_architectural and not is_doc and n.node_id not in (select target_id from e where rel_type = 'references') order by 3 desc, 4 desc, 1 limit 20",
)
def coverage_gaps(s, d):
    n, e = G.graph(s, d)
    return R.coverage_gaps(n, e, e.where("rel_type = 'references'").select(F.col("target_id").alias("node_id")))


_LANG = "case lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in X.LANGUAGE_BY_EXTENSION.items()) + " end"


@query("language_by_path", f"{WITH} select coalesce({_LANG}, '') as by_path, language, count(*) as n_nodes from n group by 1, 2")
def language_by_path(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"))
    return n.groupBy(F.coalesce(X.language_by_path(F.col("rel_path")), F.lit("")).alias("by_path"), "language").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("project_node_ids", f"{WITH} select wiki_id || '::' || node_id as project_id, wiki_id, node_id from n")
def project_node_ids(s, d):
    """Federated ids, taken apart again."""
    n = G.nodes_view(table(s, d, "repo_nodes")).select(X.project_node_id(F.col("wiki_id"), F.col("node_id")).alias("project_id"))
    return n.select("project_id", X.split_project_node_id(F.col("project_id")).alias("p")).select("project_id", "p.wiki_id", "p.node_id")


@query("pages_markdown", "select doc_id as page_id, '---' || chr(10) || 'title: \"' || replace(coalesce(title, ''), '\"', '''') || '\"' || chr(10) || 'wiki: ' || coalesce(wiki_id, '') || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '') as markdown from documents")
def pages_markdown(s, d):
    t = table(s, d, "documents")
    return pages_as_markdown(t.select(F.col("doc_id").alias("page_id"), "title", "wiki_id", F.col("text").alias("content")))


@query("surface_links_all_languages", f"{WITH}, {SURFACES}, " + CLASS_LINKS.format(order="<=", distinct="a.node_id <> b.node_id"))
def surface_links_all_languages(s, d):
    return L.surface_links(L.name_surfaces(G.nodes_view(table(s, d, "repo_nodes"))), other_language=False).drop("kind").withColumn("weight", F.round("weight", 6))
