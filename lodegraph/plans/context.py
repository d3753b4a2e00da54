"""Queries of expansion, ranking, pages and markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import markdown as M
from lodegraph.functions import scalars as X
from lodegraph.operators import expansion as E
from lodegraph.operators import graph as G
from lodegraph.operators import text as T
from lodegraph.plans.prelude import DIR, WITH, sql_list
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


_RULES = "ru as (select * from (values " + ", ".join(f"('{t}', '{r}', '{d}', {n}, '{w}')" for ts, rs, d, n, w in E.RULES for t in ts for r in rs) + ") v(symbol_type, rel_type, direction, most, reason))"
_WAYS = "bw as (select node_id, other, direction, rel_type, max(coalesce(weight, 1)) as weight from (select source_id as node_id, target_id as other, 'out' as direction, rel_type, weight from e union all select target_id, source_id, 'in', rel_type, weight from e) group by 1, 2, 3, 4)"


@query(
    "typed_expansion",
    f"""{WITH}, {_RULES}, {_WAYS}, c as (select bw.node_id, bw.other, ru.reason, ru.most, bw.weight, bw.rel_type from bw join n on n.node_id = bw.node_id join ru on ru.symbol_type = n.symbol_type and ru.rel_type = bw.rel_type and ru.direction = bw.direction
join n o on o.node_id = bw.other and o.is_architectural and not o.is_test and o.symbol_type in ({sql_list(S.EXPANSION_TYPES)}) where bw.node_id <> bw.other),
f as (select * from (select *, row_number() over (partition by node_id, reason order by weight desc, other, rel_type) as rn from c) where rn <= most), u as (select node_id, other, weight, reason from (select *, row_number() over (partition by node_id, other order by weight desc, reason desc) as r2 from f) where r2 = 1)
select node_id as seed, other as node_id, reason, weight, position from (select *, row_number() over (partition by node_id order by weight desc, other) as position from u) where position <= 10""",
)
def typed_expansion(s, d):
    n, e = G.graph(s, d)
    return E.expand(n, e, n.select("node_id")).withColumn("position", F.col("position").cast("long"))


@query(
    "retrieval_expansion",
    f"""{WITH}, h as (select node_id from n where symbol_type = 'struct'), x as (select source_id as seed, target_id as node_id, case coalesce(confidence, 'EXTRACTED') when 'EXTRACTED' then 3 when 'INFERRED' then 2 else 1 end as r from e union all select target_id, source_id, case coalesce(confidence, 'EXTRACTED') when 'EXTRACTED' then 3 when 'INFERRED' then 2 else 1 end from e),
b as (select seed, node_id, max(r) as confidence_rank from x where seed in (select node_id from h) and node_id not in (select node_id from h) group by 1, 2)
select seed, node_id, confidence_rank from (select *, row_number() over (partition by seed order by confidence_rank desc, node_id) as rn from b) where rn <= 15 order by confidence_rank desc, seed, node_id limit 150""",
)
def retrieval_expansion(s, d):
    n, e = G.graph(s, d)
    return E.retrieval_expansion(e, n.where("symbol_type = 'struct'").select("node_id"))


@query("alias_chains")
def alias_chains(s, d):
    """Test data has no aliases; the operator is tested on a fixture."""
    return E.alias_targets(*G.graph(s, d))


@query(
    "two_hop_created_types",
    f"""{WITH} select node_id, target_id from (select distinct c.node_id, y.target_id, dense_rank() over (partition by c.node_id order by y.target_id) as rn from n c join e x on x.source_id = c.node_id and x.rel_type = 'defines' join n m on m.node_id = x.target_id and m.symbol_type = 'method'
join e y on y.source_id = m.node_id and y.rel_type in ('creates', 'instantiates') and y.target_id <> c.node_id where c.symbol_type in ('class', 'interface', 'struct', 'enum', 'trait')) where rn <= 4""",
)
def two_hop_created_types(s, d):
    n, e = G.graph(s, d)
    return E.two_hops(n, e, "created_types")


@query(
    "two_hop_called_functions",
    f"""{WITH} select node_id, target_id from (select distinct c.node_id, y.target_id, dense_rank() over (partition by c.node_id order by y.target_id) as rn from n c join e x on x.source_id = c.node_id and x.rel_type = 'defines' join n m on m.node_id = x.target_id and m.symbol_type = 'method'
join e y on y.source_id = m.node_id and y.rel_type = 'calls' and y.target_id <> c.node_id where c.symbol_type in ('class', 'interface', 'struct', 'enum', 'trait')) where rn <= 3""",
)
def two_hop_called_functions(s, d):
    n, e = G.graph(s, d)
    return E.two_hops(n, e, "called_functions")


@query("ranked_documents")
def ranked_documents(s, d):
    """Symbols of all repositories ranked around the most connected class."""
    from lodegraph.operators.traverse import reach

    n, e = G.graph(s, d, ("source_text",))
    topic = G.god_nodes(n.where("symbol_type = 'class'"), e, 1).first()
    seeds = n.where(F.col("node_id") == topic.node_id).select("node_id")
    return E.rank_documents(n, e, topic.node_id, [topic.rel_path.rsplit("/", 1)[0]], reach(e, seeds, 2)).orderBy(F.desc("score"), "node_id").limit(100)


# --- Pages: files that documents name are their link targets --------------------------------------------------------
_LINK = "lk as (select distinct doc_id as source, unnest(regexp_extract_all(text, '`([a-z_]+/[a-z_]+\\.[a-z]+)`', 1)) as target from documents where text is not null)"


def page_links(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"`([a-z_]+/[a-z_]+\.[a-z]+)`"), 1)).alias("target")).distinct()


@query("page_link_graph", f"with {_LINK} select source, target from lk")
def page_link_graph(s, d):
    return page_links(s, d)


@query("page_backlinks", f"with {_LINK} select target, count(*) as n_sources, min(source) as first_source from lk group by 1")
def page_backlinks(s, d):
    return page_links(s, d).groupBy("target").agg(F.count(F.lit(1)).alias("n_sources"), F.min("source").alias("first_source"))


@query(
    "page_cocitation",
    f"""with {_LINK}, k as (select target, count(*) - 1 as others from lk group by 1), p as (select source as page, count(*) as n_targets, cast(sum(others) as bigint) as n_shared, string_agg(lk.target, chr(10) order by lk.target) as targets from lk join k on k.target = lk.target group by 1)
select page, min(page) over (partition by targets) as class_id, n_targets, n_shared from p where n_shared > 0""",
)
def page_cocitation(s, d):
    """Pages that share link targets, with the class of pages of the same targets; `page_link_graph` has the targets of each."""
    return E.cocited(page_links(s, d))


@query("page_search")
def page_search(s, d):
    """Pages for a query by BM25 over title and text (weights 10 and 1), re-ranked by their links."""
    docs = table(s, d, "documents").where("text is not null")
    hits = T.top(T.bm25(docs, "doc_id", {"title": 10.0, "text": 1.0}, T.parse_query("ledger OR vault")), "doc_id", 50).select(F.col("doc_id").cast("string").alias("page"), F.col("score").alias("base"))
    links = page_links(s, d).select(F.col("source").cast("string").alias("source"), "target")
    ranked = E.rerank_pages(hits, links, docs.agg(F.count(F.lit(1)).alias("n")))
    return ranked.select("page", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "page").limit(10)


# --- Markdown -------------------------------------------------------------------------------------------------------
def _is_markdown():
    """Texts of Markdown sources, and those of any source that have a heading; all other texts are plain."""
    return F.coalesce(F.col("source").isin("readme", "wiki_page", "design_note"), F.lit(False)) | (F.size(M.headings(F.col("text"))) > 0)


@query("markdown_chunks")
def markdown_chunks(s, d):
    docs = table(s, d, "documents").where("text is not null").where(_is_markdown())
    return M.chunks(docs, "doc_id", "text")


@query("plain_chunks")
def plain_chunks(s, d):
    docs = table(s, d, "documents").where("text is not null").where(~_is_markdown())
    return M.chunks(docs, "doc_id", "text", plain=True)


_UNFENCED = "regexp_replace(text, '(?ms)^(?:```.*?^```[^\\n]*$|~~~.*?^~~~[^\\n]*$)', '', 'g')"


@query("markdown_headings", f"select doc_id, len(regexp_extract_all({_UNFENCED}, '(?m)^(#{{1,6}}[ \\t]+[^\\n]+?)[ \\t]*$', 1)) as n_headings from documents where text is not null")
def markdown_headings(s, d):
    """Headings of all texts outside of code fences."""
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(M.headings(F.col("text"))).cast("long").alias("n_headings"))


@query("markdown_links")
def markdown_links(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"), "source_text").where("is_doc and source_text is not null")
    rows = n.select("node_id", F.explode(F.concat(M.links(F.col("source_text")), F.transform(M.wikilinks(F.col("source_text")), lambda w: F.concat(F.lit("wiki:"), w)))).alias("target"))
    return rows.select("node_id", "target", F.when(F.col("target").startswith("wiki:"), "wikilink").otherwise(M.link_kind(F.col("target"))).alias("kind"))


@query("first_paragraphs")
def first_paragraphs(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", M.first_paragraph(F.col("text")).alias("lead"))


_SLUG = "regexp_replace(regexp_replace(translate(lower({c}), '" + X._ACCENTED + "', '" + X._PLAIN + "'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_BIGRAMS = "list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


@query(
    "slug_similarity",
    f"""with t as (select doc_id, {_SLUG.format(c="title")} as a, {_SLUG.format(c="regexp_extract(text, '(?m)^#{1,6}[ \t]+([^\n]+)', 1)".replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")} as b from documents where title is not null and text is not null),
g as (select doc_id, a, b, {_BIGRAMS.format(c="a")} as ga, {_BIGRAMS.format(c="b")} as gb from t)
select doc_id, a, b, round(case when a = b then 1.0 when len(list_distinct(list_concat(ga, gb))) > 0 then len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) else 0 end, 6) as similarity from g""",
)
def slug_similarity(s, d):
    """How alike a document's title and its first heading are, by their slugs."""
    t = table(s, d, "documents").where("title is not null and text is not null")
    rows = t.select("doc_id", X.slug(F.col("title")).alias("a"), X.slug(F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+([^\n]+)", 1)).alias("b"))
    return rows.select("doc_id", "a", "b", F.round(X.slug_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("file_line_slices", f"{WITH} select node_id, array_to_string(list_slice(regexp_split_to_array(source_text, '\\n'), 11, 20), chr(10)) as lines from n where is_doc and source_text is not null")
def file_line_slices(s, d):
    """Ten lines of every document from the eleventh."""
    n = G.nodes_view(table(s, d, "repo_nodes"), "source_text").where("is_doc and source_text is not null")
    return n.select("node_id", F.array_join(F.slice(F.split("source_text", "\n"), 11, 10), "\n").alias("lines"))


@query("page_checks", f"""{WITH}, p as (select wiki_id, macro_cluster, count(*) as size, avg(case when symbol_type in ({sql_list(S.IDENTITY_TYPES)}) then 1.0 else 0.0 end) as identity, avg(case when is_test then 1.0 else 0.0 end) as contamination, avg(case when coalesce(docstring, '') <> '' then 1.0 else 0.0 end) as grounding, count(distinct {DIR}) as dirs from n where macro_cluster is not null group by 1, 2)
select wiki_id, macro_cluster, identity >= 0.1 as identity_ok, contamination < 0.5 as coherent, grounding >= 0.2 as grounded, size between 2 and 60 as size_ok, dirs from p""")
def page_checks(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"), "docstring").where("macro_cluster is not null")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    p = n.groupBy("wiki_id", "macro_cluster").agg(
        F.count(F.lit(1)).alias("size"), share(F.col("symbol_type").isin(*S.IDENTITY_TYPES)).alias("identity"), share(F.col("is_test")).alias("contamination"),
        share(F.coalesce("docstring", F.lit("")) != "").alias("grounding"), F.count_distinct(X.dirname(F.col("rel_path"))).alias("dirs"),
    )
    return p.select("wiki_id", "macro_cluster", (F.col("identity") >= 0.1).alias("identity_ok"), (F.col("contamination") < 0.5).alias("coherent"), (F.col("grounding") >= 0.2).alias("grounded"), F.col("size").between(2, 60).alias("size_ok"), "dirs")
