"""Queries of the stored index, search variants, pages and projects, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.functions.questions import EMPTY_WORDS
from lodegraph.operators import graph as G
from lodegraph.operators import pages as P
from lodegraph.operators import search_index as IX
from lodegraph.operators import text as T
from lodegraph.plans.linkage import page_tables
from lodegraph.plans.prelude import DIR, WITH, sql_list
from lodegraph.plans.search import _bm25_sql, _scored
from lodegraph.session import ensure_checkpoint_dir
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


def _n(s, d, *extra):
    return G.nodes_view(table(s, d, "repo_nodes"), *extra)


# --- Stored index ---------------------------------------------------------------------------------------------------
def stored_index(s, d) -> IX.Index:
    """The index of the documents of a folder, written to the shared folder of this session."""
    path = f"{ensure_checkpoint_dir(s)}/index-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    IX.write(table(s, d, "documents").select("doc_id", "title", "text"), "doc_id", ["title", "text"], path)
    return IX.read(s, path)


@query("index_search", "with " + _bm25_sql("documents", "doc_id", {"title": 10.0, "text": 1.0}, ["ledger", "vault"], "tf0 > 0 and tf1 > 0"))
def index_search(s, d):
    return _scored(IX.search(stored_index(s, d), {"title": 10.0, "text": 1.0}, T.all_terms("ledger vault")), "doc_id")


@query("index_phrase", "select doc_id from documents where contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') || ' ', ' by hand ')")
def index_phrase(s, d):
    return IX.search(stored_index(s, d), {"text": 1.0}, T.Phrase(("by", "hand"))).select("doc_id")


# --- Search variants ------------------------------------------------------------------------------------------------
@query("search_in_path", f"{WITH}, " + _bm25_sql("n", "node_id", T.SYMBOL_WEIGHTS, ["cache"], "tf0 > 0 and starts_with(rel_path, 'src/')", "rel_path"))
def search_in_path(s, d):
    n = _n(s, d, "signature", "docstring", "source_text")
    return _scored(T.search_in_path(n, T.Term("cache"), "src/"), "node_id").select("node_id", "rel_path", "score")


_NAMES = "list_filter(regexp_split_to_array(lower(coalesce(symbol_name, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query("search_by_name", f"{WITH} select node_id, symbol_name from n where is_architectural and contains(' ' || array_to_string({_NAMES}, ' ') || ' ', ' throttle ')")
def search_by_name(s, d):
    return T.search_by_name(_n(s, d), "throttle").select("node_id", "symbol_name")


@query("search_smart", f"{WITH}, " + _bm25_sql("n", "node_id", T.SYMBOL_WEIGHTS, ["cache", "queue"], "(tf0 > 0 or tf1 > 0) and symbol_type in ('function', 'method') and language = 'python'", "symbol_type, language"))
def search_smart(s, d):
    n = _n(s, d, "signature", "docstring", "source_text")
    got = T.search_smart(n, "how does the cache find its queue", "concept", types=["function", "method"], language="Python")
    return _scored(got, "node_id").select("node_id", "symbol_type", "language", "score")


@query("search_with_retry", "select doc_id from documents where len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'quarantin'))) > 0")
def search_with_retry(s, d):
    """No document has the word as written, so its prefix is searched."""
    return T.search_with_retry(table(s, d, "documents"), "doc_id", {"text": 1.0}, "quarantin").select("doc_id")


@query("low_value_names", f"{WITH} select node_id, length(lower(trim(coalesce(symbol_name, '')))) < 4 or lower(trim(coalesce(symbol_name, ''))) in ({sql_list(sorted(EMPTY_WORDS))}) as low_value from n")
def low_value_names(s, d):
    return _n(s, d).select("node_id", T.low_value(F.col("symbol_name")).alias("low_value"))


@query("search_docs", f"{WITH}, " + _bm25_sql("n", "node_id", {"source_text": 1.0}, ["cache"], "tf0 > 0 and is_doc", "is_doc"))
def search_docs(s, d):
    n = _n(s, d, "source_text")
    return _scored(T.bm25(n, "node_id", {"source_text": 1.0}, T.Term("cache"), ["is_doc"]).where("is_doc"), "node_id")


@query("vector_by_id", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as squared_norm from embeddings where vec_id in (0, 50, 100)")
def vector_by_id(s, d):
    v = table(s, d, "embeddings").where(F.col("vec_id").isin(0, 50, 100))
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))


@query("match_summary", "with f as (select * from documents where list_contains(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), 'ledger')) select d.wiki_id, count(f.doc_id) as n_matches, count(*) as n_documents, round(count(f.doc_id) / count(*), 6) as relevance from documents d left join f on f.doc_id = d.doc_id where d.wiki_id is not null group by 1")
def match_summary(s, d):
    docs = table(s, d, "documents")
    return P.match_summary(docs.where(T.matches(T.tokens(F.col("text")), T.Term("ledger"))), docs, "wiki_id")


@query("scan_truncation", f"{WITH} select 'nodes' as scan, count(*) as n_rows, 5000 as cap, count(*) > 5000 as truncated from n union all select 'edges', count(*), 500000, count(*) > 500000 from e")
def scan_truncation(s, d):
    n, e = G.graph(s, d)
    return P.scan_limits({"nodes": (n, 5000), "edges": (e, 500_000)})


# --- Pages ----------------------------------------------------------------------------------------------------------
@query("page_slugs_unique", f"with b as (select wiki_id, doc_id, case when slug = '' then 'page' else slug end as slug from (select wiki_id, doc_id, regexp_replace(regexp_replace(translate(lower(coalesce(title, '')), '{X._ACCENTED}', '{X._PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents)), r as (select *, row_number() over (partition by wiki_id, slug order by doc_id) as k from b) select wiki_id, doc_id, case when k = 1 then slug else slug || '-' || k end as slug from r")
def page_slugs_unique(s, d):
    return P.unique_slugs(table(s, d, "documents"), "wiki_id", "doc_id", "title")


@query("titles_normalised", "select doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) as title from documents")
def titles_normalised(s, d):
    return table(s, d, "documents").select("doc_id", P.normal_title(F.col("title")).alias("title"))


@query("relative_paths", f"{WITH} select distinct rel_path, case when {DIR} = '' then 'lib/x.md' else regexp_replace({DIR}, '(^|/)[^/]+$', '') || case when contains({DIR}, '/') then '/' else '' end || 'lib/x.md' end as resolved from n where rel_path is not null and not contains(rel_path, './') and not contains(rel_path, '//') and not starts_with(rel_path, '/')")
def relative_paths(s, d):
    """Where the link ../lib/./x.md leads from every file."""
    n = _n(s, d).where("rel_path is not null and not contains(rel_path, './') and not contains(rel_path, '//') and not startswith(rel_path, '/')")
    return n.select("rel_path", P.resolve_relative(F.col("rel_path"), F.lit("../lib/./x.md")).alias("resolved")).distinct()


_KEY = "substr(sha256(coalesce(wiki_id, '') || '|' || coalesce(rel_path, '')), 1, 16)"


@query("page_overlaps", f"{WITH}, m as (select {_KEY} as page_id, node_id from n where rel_path <> '' union select 'c:' || wiki_id || ':' || macro_cluster, node_id from n where macro_cluster is not null and wiki_id is not null), z as (select page_id, count(*) as size from m group by 1), c as (select a.page_id as page_a, b.page_id as page_b, count(*) as n_common from m a join m b on a.node_id = b.node_id and a.page_id < b.page_id group by 1, 2) select page_a, page_b, n_common from c join z x on x.page_id = page_a join z y on y.page_id = page_b where n_common > 0.5 * least(x.size, y.size)")
def page_overlaps(s, d):
    """File pages and cluster pages that hold mostly the same nodes."""
    n = _n(s, d)
    files = page_tables(s, d)[1].select("page_id", "node_id")
    clusters = n.where("macro_cluster is not null and wiki_id is not null").select(F.concat_ws(":", F.lit("c"), "wiki_id", F.col("macro_cluster").cast("string")).alias("page_id"), "node_id")
    return P.overlapping_pages(files.unionByName(clusters))


@query("page_symbols_upsert", f"{WITH}, ps as (select {_KEY} as page_id, node_id, case when symbol_type = 'module' then 'primary' else 'referenced' end as citation_kind, is_test from n where rel_path <> '') select distinct page_id, node_id, case when is_test then 'primary' else citation_kind end as citation_kind from ps")
def page_symbols_upsert(s, d):
    """Pages of tests are written again, now citing all their symbols as primary."""
    stored = page_tables(s, d)[1]
    tests = _n(s, d).where("rel_path <> '' and is_test").select(X.page_key(F.col("wiki_id"), F.col("rel_path")).alias("page_id"), "node_id", F.lit("primary").alias("citation_kind"))
    return P.upsert_page_symbols(stored, tests, tests)


@query("file_splits", f"{WITH}, r as (select wiki_id, rel_path, node_id, start_line, coalesce(parent_symbol, '') as scope from n where symbol_type <> 'module' and rel_path is not null), z as (select wiki_id, rel_path, count(distinct scope) as scopes from r group by 1, 2 having count(*) > 8) select r.wiki_id, r.rel_path, node_id, case when scopes > 1 then dense_rank() over (partition by r.wiki_id, r.rel_path order by scope) - 1 else (row_number() over (partition by r.wiki_id, r.rel_path order by start_line nulls last, node_id) - 1) // 8 end as part from r join z on z.wiki_id = r.wiki_id and z.rel_path = r.rel_path")
def file_splits(s, d):
    return P.split_files(_n(s, d), 8)


@query("page_expansion")
def page_expansion(s, d):
    """Pages of files widened by neighbours in their macro cluster, under a token budget."""
    n, e = G.graph(s, d, ("source_text",))
    home = n.where("rel_path <> ''").groupBy("wiki_id", "rel_path").agg(F.max("macro_cluster").alias("boundary"))
    members = n.where("rel_path <> ''").join(home, ["wiki_id", "rel_path"]).select(X.page_key(F.col("wiki_id"), F.col("rel_path")).alias("page_id"), "node_id", "boundary")
    return P.expand_pages(members, n, e)


# --- Paths by label, projects ----------------------------------------------------------------------------------------
_LABELS = ("__init__", "constructor", "web/src/planner/index_record_1y.js", "nosuchname")


@query("label_resolution", f"{WITH}, w as (select unnest([{sql_list(_LABELS)}]) as label), k as (select label, 1 as rank, 'name' as how, node_id from w join n on lower(symbol_name) = label union all select label, 2, 'path', node_id from w join n on lower(rel_path) = label), p as (select label, rank, how, count(*) as n_candidates, min(node_id) as node_id from k group by 1, 2, 3) select label, node_id, how, n_candidates from p qualify row_number() over (partition by label order by rank) = 1")
def label_resolution(s, d):
    return P.resolve_labels(_n(s, d), list(_LABELS))


@query("best_edges", f"{WITH}, r as (select least(source_id, target_id) as a, greatest(source_id, target_id) as b, id, rel_type, source_id, case when confidence is null or confidence = 'EXTRACTED' then 3 when confidence = 'INFERRED' then 2 else 1 end as sure from e where source_id <> target_id) select a, b, id as edge_id, rel_type, source_id = a as forward from r qualify row_number() over (partition by a, b order by sure desc, id) = 1")
def best_edges(s, d):
    return P.best_edges(G.edges_view(table(s, d, "repo_edges")))


@query("project_repositories", f"{WITH} select p.project_id, e.wiki_id, count(*) as n_edges from e join (select distinct project_id, node_id from project_nodes) p on p.node_id = e.target_id group by 1, 2")
def project_repositories(s, d):
    return P.project_repositories(G.edges_view(table(s, d, "repo_edges")), table(s, d, "project_nodes"))
