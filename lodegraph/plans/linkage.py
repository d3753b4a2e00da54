"""Queries of the linking passes, federation, snapshots and the answer log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators import incremental as I
from lodegraph.operators import linking as L
from lodegraph.plans.prelude import DIR, WITH
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


def _docs(s, d):
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc_key"), "text")


# --- Linking passes -------------------------------------------------------------------------------------------------
_TICKS = "rf as (select distinct doc_key, ref from (select doc_id as doc_key, unnest(regexp_extract_all(text, '`([A-Za-z_][\\w.]*)`', 1)) as ref from documents where text is not null))"
_IDX = "ix as (select name, target_id from (select symbol_name as name, node_id as target_id, row_number() over (partition by symbol_name order by node_id) as rn from n where symbol_name <> '') where rn <= 2)"


@query(
    "link_backticks",
    f"""{WITH}, {_TICKS}, {_IDX} select doc_key, ref, target_id, 'exact' as how from rf join ix on ix.name = rf.ref union all
select doc_key, ref, target_id, 'last_part' from rf join ix on ix.name = regexp_extract(ref, '([^.]+)$', 1) where contains(ref, '.') and ref not in (select name from ix)""",
)
def link_backticks(s, d):
    return L.backtick_links(_docs(s, d), _n(s, d))


@query("link_paths")
def link_paths(s, d):
    return L.path_links(_docs(s, d), _n(s, d))


@query(
    "link_proximity",
    f"""{WITH}, q as (select *, {DIR} as dir from n), dc as (select wiki_id, node_id as source_id, regexp_replace(dir, '^(docs|doc|documentation)(/|$)', '') as topic from q where is_doc),
c as (select wiki_id, node_id as target_id, dir, row_number() over (partition by wiki_id, dir order by node_id) as rn from q where not is_doc and dir <> '')
select distinct source_id, target_id from dc join c on c.wiki_id = dc.wiki_id and (c.dir = topic or ends_with(c.dir, '/' || topic)) where topic <> '' and rn <= 5""",
)
def link_proximity(s, d):
    return L.proximity_links(_n(s, d))


_DEG = "dg as (select node_id, count(*) as degree from (select source_id as node_id from e union all select target_id from e) group by 1)"


@query(
    "link_directory_anchor",
    f"""{WITH}, {_DEG}, q as (select n.*, {DIR} as dir, coalesce(degree, 0) as degree from n left join dg on dg.node_id = n.node_id), b as (select wiki_id, dir, (array_agg(node_id order by degree desc, node_id))[1] as target_id from q where degree > 0 group by 1, 2),
o as (select q.node_id as source_id, b.target_id, b.dir, row_number() over (partition by q.node_id order by length(b.dir) desc) as rn from q join b on b.wiki_id = q.wiki_id and (b.dir = '' or b.dir = q.dir or starts_with(q.dir, b.dir || '/')) where q.degree = 0 and q.rel_path <> '')
select source_id, target_id, dir from o where rn = 1""",
)
def link_directory_anchor(s, d):
    return L.directory_anchors(*G.graph(s, d)).select("source_id", "target_id", "dir")


@query("link_lexical_tiers")
def link_lexical_tiers(s, d):
    """Orphans linked to symbols of like names."""
    n, e = G.graph(s, d)
    return L.lexical_tiers(n, G.orphans(n, e).select("node_id"))


_T = "(is_test or regexp_matches(lower(coalesce(file_name, '')), '^tests?[_.\\-]|[_.\\-](tests?|spec)$'))"


@query(
    "link_tests_same_stem",
    f"""{WITH}, f as (select *, {_T} as t from n where symbol_type in ('module', 'module_doc', 'file_doc') and coalesce(file_name, '') <> '')
select a.node_id as source_id, b.node_id as target_id, 'test_link_same_stem' as rel_type, 0.5 as weight from f a join f b on a.wiki_id = b.wiki_id and a.language = b.language and lower(b.file_name) = regexp_replace(regexp_replace(lower(a.file_name), '^(tests?[_.\\-])', ''), '([_.\\-](tests?|spec))$', '') where a.t and not b.t""",
)
def link_tests_same_stem(s, d):
    return L.same_stem_tests(_n(s, d))


@query(
    "link_tests_class",
    f"""{WITH}, c as (select *, is_test and regexp_matches(symbol_name, '^Test|Tests?$') as t from n where symbol_type = 'class' and symbol_name <> '')
select a.node_id as source_id, b.node_id as target_id, 'test_link_class_proxy' as rel_type, 0.5 as weight from c a join c b on a.wiki_id = b.wiki_id and a.language = b.language and b.symbol_name = case when starts_with(a.symbol_name, 'Test') then substr(a.symbol_name, 5) else regexp_replace(a.symbol_name, 'Tests?$', '') end where a.t and not b.t""",
)
def link_tests_class(s, d):
    return L.class_proxy_tests(_n(s, d))


#: SQL of the two sorts of test links.
SAME_TESTS = {k: SQL[k] for k in ("link_tests_same_stem", "link_tests_class")}
_SNAKE = "array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), '_')"
SNAKE = _SNAKE
_SURF = "sf as (select * from (select node_id, wiki_id, language, rel_path, 'name' as kind, " + _SNAKE.format(c="symbol_name") + " as surface from n where is_architectural and symbol_name <> '') where surface <> '')"
_PART = "split_part({p}, '/', 1)"


@query("surface_specificity", f"{WITH}, {_SURF} select kind, surface, count(*) as n_nodes, count(distinct language) as n_languages, count(distinct wiki_id) as n_repositories, round(1 / ln(1 + count(*)), 6) as specificity from sf group by 1, 2")
def surface_specificity(s, d):
    return L.shared_surfaces(L.name_surfaces(_n(s, d))).withColumn("specificity", F.round("specificity", 6))


SURFACES = _SURF
_LOCAL = f"case when coalesce(a.rel_path, '') = '' or coalesce(b.rel_path, '') = '' then 0.5 when {_PART.format(p='a.rel_path')} = {_PART.format(p='b.rel_path')} then 1.0 else 0.7 end"
_WEIGHT = f"least(0.8, greatest(0.3, 0.7 * 0.3 * ({_LOCAL}) / ln(1.0 + k)))"
_COUNT = "ct as (select kind, surface, count(*) as k from sf group by 1, 2 having count(*) > 1)"
#: All pairs of nodes of a surface, counted for each pair of languages.
CLASS_LINKS = _COUNT + f""", pr as (select a.surface, a.language as language_a, b.language as language_b, a.node_id as na, b.node_id as nb, {_WEIGHT} as weight from sf a join sf b on a.kind = b.kind and a.surface = b.surface and a.language {{order}} b.language and {{distinct}} join ct on ct.kind = a.kind and ct.surface = a.surface)
select surface, language_a, language_b, min(na) as source_id, case when language_a = language_b then max(nb) else min(nb) end as target_id, case when language_a = language_b then count(*) // 2 else count(*) end as n_links, round(max(weight), 6) as weight from pr group by 1, 2, 3"""


@query("link_cross_language", f"{WITH}, {_SURF}, " + CLASS_LINKS.format(order="<", distinct="true"))
def link_cross_language(s, d):
    """Links across languages, a row a pair of language classes of a surface; `surface_members` has the nodes."""
    return L.surface_links(L.name_surfaces(_n(s, d))).drop("kind").withColumn("weight", F.round("weight", 6))


@query(
    "surface_members",
    f"{WITH}, {_SURF} select a.node_id, a.kind, a.surface, a.language, a.wiki_id, count(case when b.language <> a.language then 1 end) as n_other_language, count(case when b.wiki_id <> a.wiki_id then 1 end) as n_other_repository from sf a join sf b on a.kind = b.kind and a.surface = b.surface group by 1, 2, 3, 4, 5 having count(*) > 1",
)
def surface_members(s, d):
    return L.surface_members(L.name_surfaces(_n(s, d)))


_MEMBERS = "sf as (select * from (select node_id, wiki_id, language, rel_path, 'member' as kind, " + _SNAKE.format(c="regexp_extract(parent_symbol, '([^.:]*)$', 1)") + " || '.' || " + _SNAKE.format(c="symbol_name") + " as surface from n where parent_symbol <> '' and symbol_name <> '') where not starts_with(surface, '.') and not ends_with(surface, '.'))"


@query("link_members", f"{WITH}, {_MEMBERS}, " + CLASS_LINKS.format(order="<", distinct="true"))
def link_members(s, d):
    """Members of the same name under parents of the same name, across languages."""
    return L.surface_links(L.member_surfaces(_n(s, d))).drop("kind").withColumn("weight", F.round("weight", 6))


@query("api_rest_surfaces")
def api_rest_surfaces(s, d):
    return L.rest_surfaces(_n(s, d, "source_text"))


# --- Federation -----------------------------------------------------------------------------------------------------
_FEAT = f"""nm as (select wiki_id, list(symbol_name) as names from (select wiki_id, symbol_name, row_number() over (partition by wiki_id order by count(*) desc, symbol_name) as rn from n where symbol_name <> '' group by 1, 2) where rn <= 200 group by 1),
dp as (select wiki_id, array_to_string(list_slice(string_split(rel_path, '/'), 1, least(2, len(string_split(rel_path, '/')) - 1)), '/') as dep, language, case when symbol_type = 'struct' then {_SNAKE.format(c='symbol_name')} end as api from n),
ft as (select dp.wiki_id, list(distinct language) filter (language <> '') as languages, list(distinct dep) filter (dep is not null) as deps, list(distinct api) filter (api is not null) as apis, any_value(names) as names from dp left join nm on nm.wiki_id = dp.wiki_id group by 1)"""
_J = "case when len(list_distinct(list_concat(coalesce(a.{c}, []), coalesce(b.{c}, [])))) > 0 then len(list_intersect(coalesce(a.{c}, []), coalesce(b.{c}, []))) / len(list_distinct(list_concat(coalesce(a.{c}, []), coalesce(b.{c}, [])))) else 0 end"
_REL = f"""rl as (select a.wiki_id as wiki_a, b.wiki_id as wiki_b, {_J.format(c='languages')} as lang, {_J.format(c='deps')} as dep,
case when least(len(coalesce(a.apis, [])), len(coalesce(b.apis, []))) > 0 then len(list_intersect(a.apis, b.apis)) / least(len(a.apis), len(b.apis)) else 0 end as api, {_J.format(c='names')} as naming,
len(list_intersect(coalesce(a.languages, []), coalesce(b.languages, []))) > 0 or len(list_intersect(coalesce(a.apis, []), coalesce(b.apis, []))) > 0 as overlap
from ft a join ft b on a.wiki_id < b.wiki_id),
sc as (select wiki_a, wiki_b, round(case when overlap then least(1.0, 0.30 * lang + 0.20 * dep + 0.30 * api + 0.20 * naming) else 0 end, 6) as score, round(lang, 6) as lang, round(dep, 6) as dep, round(api, 6) as api, round(naming, 6) as naming from rl)"""


@query("repository_relatedness", f"{WITH}, {_FEAT}, {_REL} select * from sc")
def repository_relatedness(s, d):
    """Scores of all repository pairs."""
    f = L.repository_features(_n(s, d))
    return L.relatedness(f, L.repository_pairs(f))


@query(
    "cross_repository_edges",
    f"""{WITH}, {_SURF}, {_COUNT}, {_FEAT}, {_REL}, lk as (select a.wiki_id as wiki_a, b.wiki_id as wiki_b, a.surface, {_WEIGHT} as weight from sf a join sf b on a.kind = b.kind and a.surface = b.surface and a.wiki_id < b.wiki_id join ct on ct.kind = a.kind and ct.surface = a.surface)
select lk.wiki_a, lk.wiki_b, count(distinct surface) as n_surfaces, count(*) as n_links, round(max(greatest(0.0, least(1.0, weight * 0.7 * score))), 6) as weight, 'cross_repo' as edge_class from lk join sc on sc.wiki_a = lk.wiki_a and sc.wiki_b = lk.wiki_b where score >= 0.15 group by 1, 2""",
)
def cross_repository_edges(s, d):
    """Links between all related repositories, a row a pair of repositories; `surface_members` has the nodes."""
    n = _n(s, d)
    links = L.repository_links(L.name_surfaces(n))
    return L.cross_repository(links, L.relatedness(L.repository_features(n), links))


@query("project_references", f"{WITH} select p.project_id, p.node_id, count(distinct e.id) as n_edges, count(distinct e.wiki_id) as n_repositories from project_nodes p left join e on e.target_id = p.node_id group by 1, 2")
def project_references(s, d):
    p = table(s, d, "project_nodes").select("project_id", "node_id")
    e = G.edges_view(table(s, d, "repo_edges")).select(F.col("target_id").alias("node_id"), "id", "wiki_id")
    return p.join(e, "node_id", "left").groupBy("project_id", "node_id").agg(F.count_distinct("id").alias("n_edges"), F.count_distinct("wiki_id").alias("n_repositories"))


@query(
    "federated_merge",
    f"""{WITH}, {_DEG}, r as (select n.symbol_name, n.wiki_id, n.node_id, coalesce(degree, 0) as degree, row_number() over (partition by n.symbol_name order by n.wiki_id, n.node_id) as rn from n left join dg on dg.node_id = n.node_id where symbol_type = 'function' and symbol_name <> '')
select symbol_name, wiki_id, degree from r where rn = 1""",
)
def federated_merge(s, d):
    """One row a symbol name over all repositories: the first repository wins."""
    n, e = G.graph(s, d)
    f = G.with_degree(n.where("symbol_type = 'function' and symbol_name <> ''"), e)
    first = f.groupBy("symbol_name").agg(F.min(F.struct("wiki_id", "node_id", "degree")).alias("r"))
    return first.select("symbol_name", "r.wiki_id", "r.degree")


# --- Snapshots ------------------------------------------------------------------------------------------------------
#: The old snapshot is what was indexed first, the new one applies the last recorded change of each node.
_LAST = "lc as (select node_id, change_kind, content_hash, rel_path from (select *, row_number() over (partition by node_id order by changed_at desc, change_id desc) as rn from node_changes) where rn = 1)"
_SNAP = f"""{_LAST}, od as (select n.node_id, n.content_hash, n.rel_path from n left join lc on lc.node_id = n.node_id where coalesce(lc.change_kind, '') <> 'added'),
nw as (select n.node_id, coalesce(lc.content_hash, n.content_hash) as content_hash, coalesce(lc.rel_path, n.rel_path) as rel_path from n left join lc on lc.node_id = n.node_id where coalesce(lc.change_kind, '') <> 'deleted'),
ch as (select coalesce(od.node_id, nw.node_id) as node_id, case when od.node_id is null then 'added' when nw.node_id is null then 'deleted' when od.content_hash is null or od.content_hash is distinct from nw.content_hash then 'modified' when coalesce(od.rel_path, '') <> coalesce(nw.rel_path, '') then 'moved' end as kind
 from od full join nw on od.node_id = nw.node_id), cc as (select * from ch where kind is not null)"""


def snapshots(s, d):
    n = _n(s, d, "content_hash").select("node_id", "content_hash", "rel_path", "wiki_id", "is_doc", "symbol_type")
    c = table(s, d, "node_changes")
    last = c.groupBy("node_id").agg(F.max(F.struct("changed_at", "change_id", "change_kind", "content_hash", "rel_path")).alias("r")).select("node_id", F.col("r.change_kind").alias("k"), F.col("r.content_hash").alias("h"), F.col("r.rel_path").alias("p"))
    j = n.join(last, "node_id", "left")
    k = F.coalesce("k", F.lit(""))
    old = j.where(k != "added").select("node_id", "content_hash", "rel_path")
    new = j.where(k != "deleted").select("node_id", F.coalesce("h", "content_hash").alias("content_hash"), F.coalesce("p", "rel_path").alias("rel_path"))
    return old, new


def page_tables(s, d):
    """A page for each file: it cites the file's symbols, its module is the primary one."""
    n = _n(s, d)
    key = X.page_key(F.col("wiki_id"), F.col("rel_path"))
    symbols = n.where("rel_path <> ''").select(key.alias("page_id"), "node_id", F.when(F.col("symbol_type") == "module", "primary").otherwise("referenced").alias("citation_kind"))
    pages = n.where("rel_path <> ''").groupBy(key.alias("page_id")).agg(F.min(F.when(F.col("symbol_type") == "module", F.col("node_id"))).alias("primary_symbol_id"))
    return pages, symbols


_KEY = "substr(sha256(coalesce(wiki_id, '') || '|' || coalesce(rel_path, '')), 1, 16)"
_PAGES = f"ps as (select {_KEY} as page_id, node_id from n where rel_path <> ''), pg as (select {_KEY} as page_id, min(case when symbol_type = 'module' then node_id end) as primary_symbol_id from n where rel_path <> '' group by 1)"


@query("change_detection", f"{WITH}, {_SNAP} select node_id, kind from cc")
def change_detection(s, d):
    return I.detect_changes(*snapshots(s, d)).select("node_id", "kind")


@query(
    "affected_pages",
    f"{WITH}, {_SNAP}, {_PAGES} select page_id, count(*) as n_changes, (array_agg(kind order by case kind when 'deleted' then 4 when 'added' then 3 when 'modified' then 2 else 1 end desc))[1] as worst from ps join cc on cc.node_id = ps.node_id group by 1",
)
def affected_pages(s, d):
    return I.affected_pages(I.detect_changes(*snapshots(s, d)), page_tables(s, d)[1])


@query(
    "regeneration_regimes",
    f"""{WITH}, {_SNAP}, {_PAGES}, ci as (select ps.page_id, count(kind) as k, bool_and(coalesce(kind = 'deleted', false)) as all_gone, bool_or(coalesce(kind in ('added', 'deleted'), false)) as topology, bool_or(coalesce(kind = 'modified', false)) as modified from ps left join cc on cc.node_id = ps.node_id group by 1)
select ci.page_id, case when all_gone then 'deleted' when pg.primary_symbol_id in (select node_id from cc where kind = 'deleted') or topology then 'structural' when modified then 'edit' else 'trivial' end as regime, k as n_changes from ci left join pg on pg.page_id = ci.page_id where k > 0""",
)
def regeneration_regimes(s, d):
    pages, symbols = page_tables(s, d)
    return I.regimes(I.detect_changes(*snapshots(s, d)), symbols, pages)


@query("pages_citing_node", f"{WITH}, {_PAGES} select distinct page_id from ps where node_id in (select target_id from e where rel_type = 'inheritance')")
def pages_citing_node(s, d):
    cited = G.edges_view(table(s, d, "repo_edges")).where("rel_type = 'inheritance'").select(F.col("target_id").alias("node_id"))
    return page_tables(s, d)[1].join(cited, "node_id", "left_semi").select("page_id").distinct()


@query("page_registry", f"{WITH} select wiki_id, {_KEY} as page_id, rel_path, row_number() over (partition by wiki_id order by rel_path) as page_index from (select distinct wiki_id, rel_path from n where is_doc)")
def page_registry(s, d):
    from pyspark.sql import Window

    p = _n(s, d).where("is_doc").select("wiki_id", "rel_path").distinct()
    return p.select("wiki_id", X.page_key(F.col("wiki_id"), F.col("rel_path")).alias("page_id"), "rel_path", F.row_number().over(Window.partitionBy("wiki_id").orderBy("rel_path")).cast("long").alias("page_index"))


# --- Answer log: the answers among the documents stand for the log ---------------------------------------------------
def answer_log(s, d):
    t = table(s, d, "documents").where("source = 'qa_answer'")
    status = F.element_at(F.array(*map(F.lit, ("pending", "validated", "rejected", "enriched"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return t.select(
        F.col("doc_id").alias("id"), F.coalesce("wiki_id", F.lit("")).alias("wiki_id"), F.coalesce("title", F.lit("")).alias("question"), I.question_hash(F.coalesce("title", F.lit(""))).alias("question_hash"), status.alias("status"),
        (F.pmod("doc_id", F.lit(3)) == 0).cast("int").alias("is_cache_hit"), (F.pmod("doc_id", F.lit(5)) == 0).cast("int").alias("has_context"), F.concat(F.lit("c"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("source_commit_hash"), "created_at",
    )


_LOG = "lg as (select doc_id as id, coalesce(wiki_id, '') as wiki_id, sha256(lower(trim(coalesce(title, '')))) as question_hash, ['pending', 'validated', 'rejected', 'enriched'][cast(doc_id % 4 + 1 as int)] as status, case when doc_id % 3 = 0 then 1 else 0 end as is_cache_hit, case when doc_id % 5 = 0 then 1 else 0 end as has_context, 'c' || cast(doc_id % 2 as varchar) as source_commit_hash, created_at from documents where source = 'qa_answer')"


@query("answer_stats", f"with {_LOG} select wiki_id, count(*) as total, cast(sum(is_cache_hit) as bigint) as cache_hits, cast(sum(case when status = 'validated' then 1 else 0 end) as bigint) as validated, cast(sum(case when status = 'rejected' then 1 else 0 end) as bigint) as rejected, round(sum(is_cache_hit) / count(*), 6) as hit_rate from lg group by 1")
def answer_stats(s, d):
    return I.answer_stats(answer_log(s, d))


@query("answer_invalidate", f"with {_LOG} select id, case when status = 'pending' and source_commit_hash is distinct from 'c1' then 'stale' else status end as status from lg")
def answer_invalidate(s, d):
    return I.invalidate(answer_log(s, d), "c1").select("id", "status")


@query("answer_reusable", f"with {_LOG} select question_hash, wiki_id, id from (select *, row_number() over (partition by wiki_id, question_hash order by created_at desc nulls last, id) as rn from lg where status in ('pending', 'validated', 'enriched') and has_context = 0 and source_commit_hash = 'c1') where rn = 1")
def answer_reusable(s, d):
    """The newest reusable answer of every question at commit c1."""
    from pyspark.sql import Window

    ok = answer_log(s, d).where(F.col("status").isin(*I.REUSABLE) & (F.col("has_context") == 0) & (F.col("source_commit_hash") == "c1"))
    rank = F.row_number().over(Window.partitionBy("wiki_id", "question_hash").orderBy(F.desc_nulls_last("created_at"), "id"))
    return ok.withColumn("rn", rank).where("rn = 1").select("question_hash", "wiki_id", "id")


# --- Scalar functions over whole tables -------------------------------------------------------------------------------
@query("content_hashes", "select doc_id, case when text is null or regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^\\n+', ''), '\\n+$', '') = '' then '' else sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '^\\n+', ''), '\\n+$', '')) end as hash from documents")
def content_hashes(s, d):
    return table(s, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("page_slugs", f"select doc_id, regexp_replace(regexp_replace(translate(lower(coalesce(title, '')), '{X._ACCENTED}', '{X._PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents")
def page_slugs(s, d):
    return table(s, d, "documents").select("doc_id", X.slug(F.coalesce("title", F.lit(""))).alias("slug"))


@query("name_tokens", f"{WITH} select node_id, {_SNAKE.format(c='symbol_name')} as words from n where symbol_name is not null")
def name_tokens(s, d):
    return _n(s, d).where("symbol_name is not null").select("node_id", X.snake_case(F.col("symbol_name")).alias("words"))


@query("path_parts", f"{WITH} select distinct rel_path, {DIR} as dir, lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) as ext, regexp_replace(regexp_extract(rel_path, '([^/]+)$', 1), '\\.[^.]*$', '') as stem from n where rel_path is not null")
def path_parts(s, d):
    p = F.col("rel_path")
    return _n(s, d).where("rel_path is not null").select("rel_path", X.dirname(p).alias("dir"), X.extension(p).alias("ext"), X.stem(p).alias("stem")).distinct()


@query("effective_depth", f"{WITH}, p as (select wiki_id, rel_path, len(string_split(rel_path, '/')) - 1 as depth from n where symbol_type = 'module' group by 1, 2, 3) select wiki_id, least(8, greatest(5, quantile_disc(depth, 0.9) + 1)) as depth from p group by 1")
def effective_depth(s, d):
    """90th percentile of folder depth and one, held to 5..8."""
    p = _n(s, d).where("symbol_type = 'module'").select("wiki_id", "rel_path", (F.size(F.split("rel_path", "/")) - 1).alias("depth")).distinct()
    return p.groupBy("wiki_id").agg(F.expr("percentile_disc(0.9) within group (order by depth)").alias("q")).select("wiki_id", F.least(F.lit(8), F.greatest(F.lit(5), F.col("q") + 1)).cast("long").alias("depth"))


@query("strip_nul", "select doc_id, length(replace(coalesce(text, ''), chr(0), '')) as n from documents")
def strip_nul(s, d):
    return table(s, d, "documents").select("doc_id", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "\u0000", "")).cast("long").alias("n"))


@query("staleness", f"with {_LAST}, b as (select wiki_id, max(indexed_at) as built from repo_nodes group by 1) select b.wiki_id, coalesce(max(c.changed_at) > any_value(b.built), false) as is_stale from b left join node_changes c on c.wiki_id = b.wiki_id group by 1")
def staleness(s, d):
    b = table(s, d, "repo_nodes").groupBy("wiki_id").agg(F.max("indexed_at").alias("built"))
    c = table(s, d, "node_changes").groupBy("wiki_id").agg(F.max("changed_at").alias("changed"))
    return b.join(c, "wiki_id", "left").select("wiki_id", F.coalesce(F.col("changed") > F.col("built"), F.lit(False)).alias("is_stale"))

