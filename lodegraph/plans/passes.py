"""Queries of the composed passes, with their SQL where SQL says it plainly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import scalars as X
from lodegraph.operators import enrichment as R
from lodegraph.operators import fusion as Z
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.plans.linkage import SAME_TESTS, SNAKE
from lodegraph.plans.prelude import COMPONENTS, DEGREE, WITH, WITHR
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


_PRIO = "case symbol_type " + " ".join(f"when '{k}' then {v}" for k, v in S.TYPE_PRIORITY.items()) + " else 0 end"
_INDEX = f"""ni as (select node_id as key, 'id' as kind, 1 as rk, node_id, {_PRIO} as p from n union all select concat_ws('::', rel_path, symbol_name), 'qualified', 2, node_id, {_PRIO} from n union all select symbol_name, 'name', 3, node_id, {_PRIO} from n
union all select regexp_extract(node_id, '([^.:]+)$', 1), 'suffix', 4, node_id, {_PRIO} from n), bi as (select key, node_id, kind from (select *, row_number() over (partition by key order by rk, p desc, node_id) as rn from ni where key <> '') where rn = 1)"""


@query("orphan_cascade")
def orphan_cascade(s, d):
    n, e = G.graph(s, d, ("source_text",))
    return R.orphan_cascade(n, e)


_LEAD = f"{COMPONENTS}, {DEGREE}, ld as (select wiki_id, component, count(*) as size, (array_agg(n.node_id order by coalesce(degree, 0) desc, n.node_id))[1] as node_id from n join cp on cp.node_id = n.node_id left join dg on dg.node_id = n.node_id group by 1, 2)"


@query("component_bridges", f"{WITHR}, {_LEAD}, mn as (select * from ld qualify row_number() over (partition by wiki_id order by size desc, component) = 1) select ld.node_id as source_id, mn.node_id as target_id, ld.wiki_id from ld join mn on mn.wiki_id = ld.wiki_id where ld.component <> mn.component")
def component_bridges(s, d):
    return R.bridges(*G.graph(s, d))


@query(
    "connectivity",
    f"""{WITHR}, {_LEAD}, lo as (select wiki_id, count(*) as k from n where node_id not in (select node_id from dg where node_id is not null) group by 1), pr as (select wiki_id, cast(sum(size) as bigint) as n_nodes, count(*) as n_components, max(size) as largest from ld group by 1)
select pr.wiki_id, n_nodes, coalesce(k, 0) as n_orphans, n_components, largest, round(largest / n_nodes, 6) as largest_share from pr left join lo on lo.wiki_id = pr.wiki_id""",
)
def connectivity(s, d):
    return R.connectivity(*G.graph(s, d))


@query("symbol_resolution", f"{WITH}, {_INDEX} select b.key, b.node_id, b.kind from bi b where key in (select distinct symbol_name from n)")
def symbol_resolution(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"))
    return R.resolve(n, n.select(F.col("symbol_name").alias("key")))


@query("edge_resolution", f"{WITH}, {_INDEX} select e.id, e.target_id, bi.node_id as resolved, bi.kind from e join bi on bi.key = e.target_id where e.target_id not in (select node_id from n) and e.target_id <> ''")
def edge_resolution(s, d):
    return R.resolve_edges(*G.graph(s, d))


_HTTP = "regexp_replace(lower(regexp_replace(regexp_replace(surface, '\\?.*$', ''), '\\{[^}]*\\}|<[^>]*>|:[A-Za-z_]\\w*', '{}', 'g')), '/+$', '')"
_SHOWN = " union all ".join(f"select node_id, '{kind}' as kind, unnest(list_distinct(regexp_extract_all(source_text, '{pattern.replace(chr(39), chr(39) * 2)}', 1))) as surface from n where source_text is not null" for kind, pattern, _ in R.SURFACES)


@query("text_surfaces", f"{WITH}, t as ({_SHOWN}) select node_id, kind, case when kind <> 'http' then surface when {_HTTP} = '' then '/' else {_HTTP} end as surface from t")
def text_surfaces(s, d):
    """Surfaces of all kinds that the texts of nodes show."""
    return R.text_surfaces(G.nodes_view(table(s, d, "repo_nodes"), "source_text")).select("node_id", "kind", "surface")


_FIELDS = "list_sort(list_distinct(list_transform(regexp_extract_all(source_text, '[{,]\\s*[\"'']?([A-Za-z_]\\w*)[\"'']?\\s*:', 1), lambda x: " + SNAKE.format(c="x") + ")))"


@query("object_shapes", f"{WITH}, o as (select node_id, {_FIELDS} as f from n where source_text is not null) select node_id, 'obj:' || array_to_string(f, ',') as surface from o where len(f) >= 2")
def object_shapes(s, d):
    return R.object_shapes(G.nodes_view(table(s, d, "repo_nodes"), "source_text"))


@query("citations", "select doc_id, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[\\[(]([\\w./-]+\\.\\w+):(\\d+)(?:-(\\d+))?[\\])]', 0)) as c from documents) group by 1")
def citations(s, d):
    return R.citations(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("wikilink_resolution")
def wikilink_resolution(s, d):
    docs = table(s, d, "documents")
    pages = docs.where("title is not null").select(X.slug(F.col("title")).alias("slug")).distinct().withColumn("page", F.col("slug"))
    return R.resolve_wikilinks(docs, "doc_id", "text", pages)


@query("middle_out", "select doc_id, case when length(text) <= 500 then text else substr(text, 1, 300) || chr(10) || '...' || chr(10) || right(text, 200) end as short from documents where text is not null")
def middle_out(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", R.middle_out(F.col("text"), 500).alias("short"))


@query("signature_view", f"{WITH} select node_id, concat_ws(chr(10), coalesce(case when signature <> '' then signature end, symbol_name), case when coalesce(docstring, '') <> '' then split_part(docstring, chr(10), 1) end) as view from n where symbol_type in ('function', 'method')")
def signature_view(s, d):
    return R.signature_view(G.nodes_view(table(s, d, "repo_nodes"), "signature", "docstring").where(F.col("symbol_type").isin("function", "method")))


@query("tiered_budget")
def tiered_budget(s, d):
    """Symbols of each repository in three tiers of detail, by degree."""
    n, e = G.graph(s, d, ("source_text",))
    f = G.with_degree(n.where("is_architectural"), e)
    return Z.tiered_budget(f.select("wiki_id", F.col("node_id").alias("id"), F.col("degree").cast("double").alias("score"), X.token_estimate(F.col("source_text")).alias("tokens")), "wiki_id")


@query("test_links", " union ".join(f"select * from ({SAME_TESTS[k]})" for k in sorted(SAME_TESTS)))
def test_links(s, d):
    return L.test_links(G.nodes_view(table(s, d, "repo_nodes")))


@query("module_analysis", f"{WITH} select wiki_id, coalesce(split_part(rel_path, '/', 1), '') as top, symbol_type, count(*) as n_symbols, count(distinct rel_path) as n_files from n group by 1, 2, 3")
def module_analysis(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"))
    return n.groupBy("wiki_id", F.coalesce(F.element_at(F.split("rel_path", "/"), 1), F.lit("")).alias("top"), "symbol_type").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_distinct("rel_path").alias("n_files"))


@query("name_matches_by_span", f"{WITH} select symbol_name, node_id, span from (select symbol_name, node_id, coalesce(end_line, 0) - coalesce(start_line, 0) as span, row_number() over (partition by symbol_name order by coalesce(end_line, 0) - coalesce(start_line, 0) desc, node_id) as rn from n where symbol_name <> '') where rn <= 3")
def name_matches_by_span(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes")).where("symbol_name <> ''")
    span = F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0))
    r = n.select("symbol_name", "node_id", span.alias("span"))
    return r.withColumn("rn", F.row_number().over(Window.partitionBy("symbol_name").orderBy(F.desc("span"), "node_id"))).where("rn <= 3").drop("rn")
