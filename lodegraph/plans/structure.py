"""Queries over the graph view: scans, predicates, joins, aggregates, weights, hubs and clusters, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators import tables as W
from lodegraph.plans.prelude import DIR, WITH, sql_list
from lodegraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _n(s, d, *extra):
    return G.nodes_view(table(s, d, "repo_nodes"), *extra)


def _g(s, d):
    return G.graph(s, d)


# --- Scans ----------------------------------------------------------------------------------------------------------
@query("scan_point_lookup", f"{WITH} select node_id, symbol_name, symbol_type, rel_path from n where node_id = (select min(node_id) from n)")
def scan_point_lookup(s, d):
    n = _n(s, d)
    first = table(s, d, "repo_nodes").agg(F.min("node_id").alias("node_id"))
    return n.join(F.broadcast(first), "node_id", "left_semi").select("node_id", "symbol_name", "symbol_type", "rel_path")


@query("scan_batch_lookup", f"{WITH} select node_id, symbol_name, rel_path from n where node_id in (select target_id from e where rel_type = 'inheritance')")
def scan_batch_lookup(s, d):
    n, e = _g(s, d)
    return n.join(e.where("rel_type = 'inheritance'").select(F.col("target_id").alias("node_id")), "node_id", "left_semi").select("node_id", "symbol_name", "rel_path")


@query("scan_path_prefix", f"{WITH} select node_id, rel_path from n where rel_path like 'web/src/%'")
def scan_path_prefix(s, d):
    return G.under_path(_n(s, d), "web/src").select("node_id", "rel_path")


@query("scan_cluster", f"{WITH} select node_id, macro_cluster, micro_cluster from n where macro_cluster = 3 and micro_cluster = 1")
def scan_cluster(s, d):
    return G.in_cluster(_n(s, d), 3, 1).select("node_id", "macro_cluster", "micro_cluster")


@query("scan_architectural", f"{WITH} select node_id, symbol_type, language from n where is_architectural")
def scan_architectural(s, d):
    return _n(s, d).where("is_architectural").select("node_id", "symbol_type", "language")


@query("scan_clustered_architectural", f"{WITH} select node_id, macro_cluster, micro_cluster from n where is_architectural and macro_cluster is not null")
def scan_clustered_architectural(s, d):
    return _n(s, d).where("is_architectural and macro_cluster is not null").select("node_id", "macro_cluster", "micro_cluster")


@query("scan_hub_ids", f"{WITH} select node_id from n where is_hub = 1")
def scan_hub_ids(s, d):
    return _n(s, d).where("is_hub = 1").select("node_id")


@query("scan_cluster_docs", f"{WITH} select wiki_id, macro_cluster, rel_path, node_id from n where is_doc and macro_cluster is not null")
def scan_cluster_docs(s, d):
    return _n(s, d).where("is_doc and macro_cluster is not null").select("wiki_id", "macro_cluster", "rel_path", "node_id").orderBy("wiki_id", "macro_cluster", "rel_path", "node_id")


@query("scan_snapshot_meta", f"{WITH} select node_id, content_hash, rel_path from n")
def scan_snapshot_meta(s, d):
    return _n(s, d, "content_hash").select("node_id", "content_hash", "rel_path")


@query("scan_edges_from", f"{WITH} select e.id, e.source_id, e.target_id, e.rel_type from e join n on n.node_id = e.source_id where n.symbol_type = 'class' and e.rel_type in ('inheritance', 'defines')")
def scan_edges_from(s, d):
    n, e = _g(s, d)
    return e.where(F.col("rel_type").isin("inheritance", "defines")).join(n.where("symbol_type = 'class'").select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select("id", "source_id", "target_id", "rel_type")


@query("scan_edge_targets", f"{WITH} select source_id, target_id, rel_type, weight from e")
def scan_edge_targets(s, d):
    return G.edges_view(table(s, d, "repo_edges")).select("source_id", "target_id", "rel_type", "weight")


@query("scan_clusters_nested", f"{WITH} select macro_cluster, coalesce(micro_cluster, 0) as micro, count(*) as n_nodes, min(node_id) as first_node from n where macro_cluster is not null group by 1, 2")
def scan_clusters_nested(s, d):
    return G.clusters_nested(_n(s, d))


@query(
    "source_preview",
    f"{WITH} select wiki_id, split_part(rel_path, '/', 1) as top_path, count(distinct rel_path) as n_files, cast(sum(length(source_text)) as bigint) as n_chars from n where symbol_type = 'module' group by 1, 2",
)
def source_preview(s, d):
    files = _n(s, d, "source_text").where("symbol_type = 'module'")
    return files.groupBy("wiki_id", F.element_at(F.split("rel_path", "/"), 1).alias("top_path")).agg(F.count_distinct("rel_path").alias("n_files"), F.sum(F.length("source_text")).alias("n_chars"))


@query(
    "source_file_filters",
    f"{WITH} select wiki_id, rel_path, language from n where symbol_type = 'module' and octet_length(encode(coalesce(source_text, ''))) <= 10485760 and regexp_matches(lower(rel_path), '\\.(py|js|ts|java|go)$') and not regexp_matches(rel_path, '(^|/)(node_modules|build|dist|target|\\.git|__pycache__)/')",
)
def source_file_filters(s, d):
    from lodegraph.sources.files import keep_file

    return _n(s, d, "source_text").where("symbol_type = 'module'").where(keep_file(F.col("rel_path"), F.octet_length(F.coalesce("source_text", F.lit(""))))).select("wiki_id", "rel_path", "language")


# --- Writes (their results) -----------------------------------------------------------------------------------------
@query(
    "write_node_upsert",
    f"""{WITH}, lc as (select node_id, rel_path as new_path from (select *, row_number() over (partition by node_id order by changed_at desc nulls last, change_id desc) as rn from node_changes where node_id is not null and change_kind <> 'deleted') where rn = 1)
select lc.node_id, coalesce(new_path, n.rel_path) as rel_path, n.symbol_name from lc left join n on n.node_id = lc.node_id union all select node_id, rel_path, symbol_name from n where node_id not in (select node_id from lc)""",
)
def write_node_upsert(s, d):
    """All nodes, with the newest change of each that isn't a deletion written over them."""
    old = _n(s, d).select("node_id", "rel_path", "symbol_name")
    changes = table(s, d, "node_changes").where("node_id is not null and change_kind <> 'deleted'")
    last = W.last_wins(changes.withColumn("at", F.struct("changed_at", "change_id")), ["node_id"], "at").select("node_id", F.col("rel_path").alias("new_path"))
    new = last.join(old, "node_id", "left").select("node_id", F.coalesce("new_path", "rel_path").alias("rel_path"), "symbol_name")
    return W.upsert(old, new, ["node_id"])


@query(
    "write_edge_dedup",
    f"{WITH} select source_id, target_id, rel_type, cast(sum(cast(coalesce(weight, 1) as decimal(18,6))) as double) as weight, arg_min(confidence, id) filter (confidence is not null) as confidence, min(id) as first_id from e group by 1, 2, 3".replace("arg_min(confidence, id) filter (confidence is not null)", "(array_agg(confidence order by id))[1]"),
)
def write_edge_dedup(s, d):
    return W.merge_parallel(G.edges_view(table(s, d, "repo_edges"))).select("source_id", "target_id", "rel_type", "weight", "confidence", "first_id")


@query("write_weight_update", f"{WITH} select id, case when rel_type = 'calls' then coalesce(weight * 2, weight) else weight end as weight from e")
def write_weight_update(s, d):
    e = G.edges_view(table(s, d, "repo_edges"))
    new = e.where("rel_type = 'calls'").select("id", (F.col("weight") * 2).alias("weight"))
    return W.update_column(e.select("id", "weight"), new, ["id"], "weight")


@query("write_reset_clusters", f"{WITH} select node_id, cast(null as int) as macro_cluster, cast(null as int) as micro_cluster, 0 as is_hub from n")
def write_reset_clusters(s, d):
    return W.reset_clusters(_n(s, d)).select("node_id", "macro_cluster", "micro_cluster", "is_hub")


@query(
    "write_stale_cleanup",
    f"{WITH}, gone as (select distinct node_id from node_changes where change_kind = 'deleted') select id, source_id, target_id from e where source_id not in (select node_id from gone) and target_id not in (select node_id from gone)",
)
def write_stale_cleanup(s, d):
    gone = table(s, d, "node_changes").where("change_kind = 'deleted'").select("node_id")
    return W.without_nodes(G.edges_view(table(s, d, "repo_edges")), gone).select("id", "source_id", "target_id")


@query("embedding_pending", f"{WITH} select node_id from n where is_architectural and content_hash is distinct from embedding_content_hash")
def embedding_pending(s, d):
    return W.embedding_pending(_n(s, d, "content_hash", "embedding_content_hash").where("is_architectural")).select("node_id")


_TEXT = " or ".join(f"trim({c}) <> ''" for c in ("source_text", "docstring", "symbol_name"))


@query("embedding_sink", f"{WITH}, p as (select node_id from n where content_hash is distinct from embedding_content_hash and ({_TEXT})), v as (select node_id, coalesce(max(len(embedding)), 0) as n from repo_vec group by 1) select node_id, 1 as n from p union all select node_id, n from v where node_id not in (select node_id from p)")
def embedding_sink(s, d):
    """Lengths of stored vectors after the pending nodes were embedded again by a model of one number, the length of the text."""
    v = table(s, d, "repo_vec").select("node_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("n"))
    stored = v.groupBy("node_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    pending = _n(s, d, "content_hash", "embedding_content_hash", "source_text", "docstring")
    fresh = W.embed(pending, lambda texts: [[len(t)] for t in texts]).select("node_id", F.size("embedding").cast("long").alias("n"))
    return W.upsert(stored, fresh, ["node_id"])


# --- Predicates -----------------------------------------------------------------------------------------------------
_LOW = "lower(coalesce(symbol_name, ''))"
_PARTS = "string_split(lower(coalesce(rel_path, '')), '/')"
LAYER_SQL = f"""case when symbol_type in ('constant', 'macro') then 'constant' when symbol_type in ('struct', 'enum', 'type_alias') then 'core_type'
when symbol_type = 'function' and ({_LOW} in ({sql_list(S.ENTRY_NAMES)}) or regexp_matches({_LOW}, '^({"|".join(S.ENTRY_NAMES)})_') or regexp_matches({_LOW}, '_({"|".join(S.ENTRY_NAMES)})$')) then 'entry_point'
when list_has_any({_PARTS}, [{sql_list(S.INFRA_SEGMENTS)}]) then 'infrastructure' when coalesce(parent_symbol, '') <> '' then 'internal'
when list_has_any({_PARTS}, [{sql_list(S.INTERNAL_SEGMENTS)}]) then 'internal' else 'public_api' end"""


@query("layers", f"{WITH} select node_id, {LAYER_SQL} as layer from n")
def layers(s, d):
    return _n(s, d).select("node_id", X.layer(F.col("symbol_type"), F.coalesce("symbol_name", F.lit("")), F.col("parent_symbol"), F.col("rel_path")).alias("layer"))


@query("test_paths", f"{WITH} select distinct wiki_id, rel_path from n where is_test")
def test_paths(s, d):
    return _n(s, d).where("is_test").select("wiki_id", "rel_path").distinct()


@query("doc_symbols", f"{WITH} select node_id, rel_path from n where is_doc")
def doc_symbols(s, d):
    return _n(s, d).where("is_doc").select("node_id", "rel_path")


@query("vendored_demotion", f"{WITH} select node_id, rel_path from n where is_architectural and (" + " or ".join(f"rel_path ilike '{p}'" for p in S.VENDORED_LIKE) + ")")
def vendored_demotion(s, d):
    return G.vendored_nodes(_n(s, d)).select("node_id", "rel_path")


@query("confidence_floor", f"{WITH} select id, confidence from e where coalesce(confidence, 'EXTRACTED') in ('EXTRACTED', 'INFERRED')")
def confidence_floor(s, d):
    return G.min_confidence(G.edges_view(table(s, d, "repo_edges")), "INFERRED").select("id", "confidence")


@query("has_relation", f"{WITH} select node_id, symbol_name from n where node_id in (select source_id from e where rel_type in ('inheritance', 'inherits', 'extends') union select target_id from e where rel_type in ('inheritance', 'inherits', 'extends'))")
def has_relation(s, d):
    n, e = _g(s, d)
    return G.has_relation(n, e, "inherits").select("node_id", "symbol_name")


@query("graph_subset_language", f"{WITH} select e.id, e.source_id, e.target_id from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.language = 'python' and b.language = 'python'")
def graph_subset_language(s, d):
    n, e = _g(s, d)
    py = n.where("language = 'python'").select("node_id")
    return e.join(py.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(py.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi").select("id", "source_id", "target_id")


@query("distinct_files_languages", f"{WITH} select wiki_id, count(distinct rel_path) as n_files, count(distinct language) as n_languages from n group by 1")
def distinct_files_languages(s, d):
    return _n(s, d).groupBy("wiki_id").agg(F.count_distinct("rel_path").alias("n_files"), F.count_distinct("language").alias("n_languages"))


@query("repository_registry", f"{WITH} select wiki_id, split_part(wiki_id, '--', 1) as owner, split_part(wiki_id, '--', 2) as repo, split_part(wiki_id, '--', 3) as branch, count(*) as n_nodes, max(indexed_at) as last_indexed from n where contains(lower(wiki_id), 'graph') group by 1, 2, 3, 4")
def repository_registry(s, d):
    part = lambda i: F.split_part(F.col("wiki_id"), F.lit("--"), F.lit(i))
    rows = _n(s, d, "indexed_at").where(F.contains(F.lower("wiki_id"), F.lit("graph")))
    return rows.groupBy("wiki_id", part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch")).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("indexed_at").alias("last_indexed"))


# --- Joins ----------------------------------------------------------------------------------------------------------
@query(
    "related_nodes_out",
    f"""{WITH}, p as (select distinct e.source_id as node_id, e.target_id as other from e where e.rel_type in ('calls', 'references')),
r as (select p.node_id, p.other, t.rel_path, t.start_line, t.symbol_type, row_number() over (partition by p.node_id order by t.rel_path nulls last, t.start_line nulls last, p.other) as position from p join n t on t.node_id = p.other)
select node_id, other, rel_path, coalesce(start_line, -1) as start_line, symbol_type, position from r where position <= 15""",
)
def related_nodes_out(s, d):
    n, e = _g(s, d)
    return G.related_nodes(n, e, "out", ["calls", "references"]).select("node_id", "other", "rel_path", F.coalesce("start_line", F.lit(-1)).alias("start_line"), "symbol_type", F.col("position").cast("long").alias("position"))


@query(
    "member_promotion",
    f"""{WITH} select c.node_id as source_id, t.node_id as target_id, 'member_uses' as rel_type, 'INFERRED' as confidence, cast(count(*) as double) as weight
from n c join e x on x.source_id = c.node_id and x.rel_type = 'defines' join n m on m.node_id = x.target_id and m.symbol_type in ('method', 'field', 'property', 'constructor')
join e r on r.source_id = m.node_id and r.rel_type in ('references', 'calls', 'creates', 'instantiates') join n t on t.node_id = r.target_id and t.rel_path <> c.rel_path
where c.symbol_type in ('class', 'struct', 'interface', 'trait') and c.is_architectural and t.node_id <> c.node_id
and not exists (select 1 from e z where z.source_id = c.node_id and z.target_id = t.node_id and z.rel_type <> 'defines') group by 1, 2""",
)
def member_promotion(s, d):
    return G.member_promotion(*_g(s, d))


#: Test data has no constants; functions stand for them, so the rule runs on rows.
@query(
    "local_symbols",
    f"""{WITH} select t.node_id, t.rel_path from n t join e on e.target_id = t.node_id join n f on f.node_id = e.source_id where t.symbol_type = 'function'
group by 1, 2 having count(distinct f.rel_path) = 1 and max(f.rel_path) = t.rel_path""",
)
def local_symbols(s, d):
    n, e = _g(s, d)
    as_constant = n.withColumn("symbol_type", F.when(F.col("symbol_type") == "function", "constant").otherwise(F.when(F.col("symbol_type") == "constant", "function").otherwise(F.col("symbol_type"))))
    return G.local_constants(as_constant, e)


@query(
    "exact_lookup",
    f"""{WITH}, k as (select distinct symbol_name, rel_path, language from n where symbol_type = 'class')
select symbol_name, rel_path, language, node_id from (select n.symbol_name, n.rel_path, n.language, n.node_id, row_number() over (partition by n.symbol_name, n.rel_path, n.language
order by case n.symbol_type {" ".join(f"when '{k}' then {v}" for k, v in S.TYPE_PRIORITY.items())} else 0 end desc, n.node_id) as rn from n join k using (symbol_name, rel_path, language)) where rn = 1""",
)
def exact_lookup(s, d):
    n = _n(s, d)
    return G.exact_lookup(n, n.where("symbol_type = 'class'"))


# --- Aggregates -----------------------------------------------------------------------------------------------------
@query(
    "graph_stats",
    f"""{WITH} select 'nodes' as metric, '' as label, count(*) as n from n union all select 'edges', '', count(*) from e union all select 'macro_clusters', '', count(distinct macro_cluster) from n
union all select 'hubs', '', cast(coalesce(sum(case when is_hub = 1 then 1 else 0 end), 0) as bigint) from n union all select 'language', language, count(*) from n group by 2 union all select 'symbol_type', symbol_type, count(*) from n group by 2
union all select 'rel_type', rel_type, count(*) from e group by 2 union all select 'confidence', b.label, (select count(*) from e where coalesce(confidence, 'EXTRACTED') = b.label) from (values ('EXTRACTED'), ('INFERRED'), ('AMBIGUOUS')) b(label)""",
)
def graph_stats(s, d):
    return G.stats(*_g(s, d))


@query(
    "dominant_language",
    f"{WITH} select wiki_id, language, n from (select wiki_id, language, count(*) as n, row_number() over (partition by wiki_id order by count(*) desc, language) as rn from n where language <> '' group by 1, 2) where rn = 1",
)
def dominant_language(s, d):
    return G.dominant_language(_n(s, d), "wiki_id")


_DEG = "d as (select node_id, count(*) as degree from (select source_id as node_id from e union all select target_id from e) group by 1)"


@query("god_nodes", f"{WITH}, {_DEG} select n.node_id, symbol_name, symbol_type, rel_path, coalesce(degree, 0) as degree from n left join d on d.node_id = n.node_id where is_architectural order by 5 desc, 1 limit 20")
def god_nodes(s, d):
    return G.god_nodes(*_g(s, d), 20)


@query(
    "god_files",
    f"{WITH} select s.rel_path, cast(sum(case when s.is_architectural then 1 else 0 end) as bigint) as internal_arch, count(*) as external_edges from e join n s on s.node_id = e.source_id join n t on t.node_id = e.target_id where t.rel_path <> s.rel_path group by 1 order by 3 desc, 1 limit 20",
)
def god_files(s, d):
    return G.god_files(*_g(s, d), 20)


_IN = "si as (select target_id, count(*) as in_degree from e where coalesce(edge_class, 'structural') not in (" + sql_list(S.SYNTHETIC_CLASSES) + ") group by 1)"
_WEIGHT = f"""w as (select e.*, case when coalesce(edge_class, 'structural') in ({sql_list(S.CALIBRATED_CLASSES)}) and weight is not null then weight when coalesce(edge_class, 'structural') in ({sql_list(S.SYNTHETIC_CLASSES)})
then greatest(1 / ln(coalesce(in_degree, 0) + 2), {S.SYNTHETIC_FLOOR}) else 1 / ln(coalesce(in_degree, 0) + 2) end as new_weight from e left join si on si.target_id = e.target_id)"""


@query("edge_weights", f"{WITH}, {_IN}, {_WEIGHT} select id, round(new_weight, 6) as new_weight from w")
def edge_weights(s, d):
    return G.edge_weights(G.edges_view(table(s, d, "repo_edges"))).select("id", F.round("new_weight", 6).alias("new_weight"))


@query(
    "edge_weight_summary",
    f"{WITH}, {_IN}, {_WEIGHT} select count(*) as edges_weighted, cast(sum(case when coalesce(edge_class, 'structural') in ({sql_list(S.SYNTHETIC_CLASSES)}) then 1 else 0 end) as bigint) as synthetic, round(min(new_weight), 4) as min_weight, round(max(new_weight), 4) as max_weight, round(avg(new_weight), 4) as mean_weight from w",
)
def edge_weight_summary(s, d):
    return G.weight_summary(G.edge_weights(G.edges_view(table(s, d, "repo_edges"))))


@query(
    "hubs",
    f"""{WITH}, i as (select n.node_id, coalesce(c, 0) as in_degree from n left join (select target_id, count(*) as c from e group by 1) t on t.target_id = n.node_id), m as (select avg(in_degree) as mean, stddev_pop(in_degree) as std, count(*) as k from i)
select node_id, in_degree, round((in_degree - mean) / std, 6) as z_score from i, m where k >= 3 and std > 0 and (in_degree - mean) / std > 3""",
)
def hubs(s, d):
    return G.hubs(*_g(s, d)).withColumn("z_score", F.round("z_score", 6))


@query("orphans", f"{WITH} select node_id, symbol_type from n where node_id not in (select source_id from e) and node_id not in (select target_id from e)")
def orphans(s, d):
    return G.orphans(*_g(s, d)).select("node_id", "symbol_type")


_PAIRS = "pr as (select least(a.macro_cluster, b.macro_cluster) as cluster_a, greatest(a.macro_cluster, b.macro_cluster) as cluster_b, count(*) as edge_count from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.macro_cluster <> b.macro_cluster group by 1, 2)"
_CTX = "cx as (select macro_cluster, list(distinct split_part(rel_path, '/', 1)) as ctx from n where macro_cluster is not null and contains(rel_path, '/') group by 1)"


@query(
    "surprising_connections",
    f"""{WITH}, {_PAIRS}, {_CTX} select cluster_a, cluster_b, edge_count, round(1 - len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))), 6) as jaccard_distance
from (select pr.*, coalesce(a.ctx, []) as ca, coalesce(b.ctx, []) as cb from pr left join cx a on a.macro_cluster = cluster_a left join cx b on b.macro_cluster = cluster_b) where len(list_concat(ca, cb)) > 0""",
)
def surprising_connections(s, d):
    return G.surprising_connections(*_g(s, d)).withColumn("jaccard_distance", F.round("jaccard_distance", 6))


@query(
    "cluster_pair_samples",
    f"""{WITH} select cluster_a, cluster_b, position, id, source_id, target_id, rel_type, confidence from (select least(a.macro_cluster, b.macro_cluster) as cluster_a, greatest(a.macro_cluster, b.macro_cluster) as cluster_b, e.id, source_id, target_id, rel_type, confidence,
row_number() over (partition by least(a.macro_cluster, b.macro_cluster), greatest(a.macro_cluster, b.macro_cluster) order by case confidence when 'EXTRACTED' then 0 when 'INFERRED' then 1 else 2 end, source_id, target_id, e.id) as position
from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.macro_cluster <> b.macro_cluster) where position <= 3""",
)
def cluster_pair_samples(s, d):
    return G.sample_edges(*_g(s, d)).withColumn("position", F.col("position").cast("long"))


@query("undirected_weights", f"{WITH} select least(source_id, target_id) as a, greatest(source_id, target_id) as b, cast(sum(cast(coalesce(weight, 1) as decimal(18,6))) as double) as weight, count(*) as n_edges from e where source_id <> target_id group by 1, 2")
def undirected_weights(s, d):
    return G.undirected(G.edges_view(table(s, d, "repo_edges")))


@query(
    "file_graph",
    f"{WITH} select a.wiki_id, a.rel_path as from_path, b.rel_path as to_path, cast(sum(cast(coalesce(weight, 1) as decimal(18,6))) as double) as weight, count(*) as n_edges from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.wiki_id = b.wiki_id and a.rel_path <> b.rel_path group by 1, 2, 3",
)
def file_graph(s, d):
    return G.file_graph(*_g(s, d))


@query(
    "dir_interactions",
    f"""{WITH}, q as (select *, {DIR} as dir from n) select a.wiki_id, a.dir as from_dir, b.dir as to_dir, cast(sum(case rel_type {" ".join(f"when '{k}' then {v}" for k, v in G.RELATION_WEIGHT.items())} else 1 end) as bigint) as weight
from e join q a on a.node_id = e.source_id join q b on b.node_id = e.target_id where a.wiki_id = b.wiki_id and a.dir <> b.dir group by 1, 2, 3""",
)
def dir_interactions(s, d):
    return G.dir_interactions(*_g(s, d))


@query(
    "dir_symbols",
    f"""{WITH}, q as (select wiki_id, {DIR} as dir, symbol_type, symbol_name, case symbol_type {" ".join(f"when '{k}' then {v}" for k, v in S.TYPE_PRIORITY.items())} else 0 end as prio from n where is_architectural and not is_doc)
select wiki_id, dir, count(*) as n_symbols, count(distinct symbol_type) as n_types, (array_agg(symbol_name order by prio desc, symbol_name))[1] as lead_symbol from q group by 1, 2""",
)
def dir_symbols(s, d):
    return G.dir_symbols(_n(s, d))


@query("doc_clusters", f"{WITH} select wiki_id, macro_cluster, round(avg(case when is_doc then 1.0 else 0.0 end), 6) as doc_ratio, count(*) as n_nodes from n where macro_cluster is not null group by 1, 2 having avg(case when is_doc then 1.0 else 0.0 end) > 0.05")
def doc_clusters(s, d):
    return G.doc_clusters(_n(s, d), 0.05).withColumn("doc_ratio", F.round("doc_ratio", 6))


@query(
    "dir_histogram_similarity",
    f"""{WITH}, r as (select wiki_id, macro_cluster, {DIR} as dir from n where macro_cluster is not null), h as (select wiki_id, macro_cluster, dir, count(*) as n from r group by 1, 2, 3), z as (select wiki_id, macro_cluster, count(*) as size from r group by 1, 2)
select wiki_id, cluster_a, cluster_b, shared, round(shared / least(za.size, zb.size), 6) as similarity from (select a.wiki_id, a.macro_cluster as cluster_a, b.macro_cluster as cluster_b, cast(sum(least(a.n, b.n)) as bigint) as shared from h a join h b on a.wiki_id = b.wiki_id and a.dir = b.dir and a.macro_cluster < b.macro_cluster group by 1, 2, 3) p
join z za on za.wiki_id = p.wiki_id and za.macro_cluster = cluster_a join z zb on zb.wiki_id = p.wiki_id and zb.macro_cluster = cluster_b""".replace("select wiki_id, cluster_a, cluster_b, shared, round", "select p.wiki_id, cluster_a, cluster_b, shared, round"),
)
def dir_histogram_similarity(s, d):
    return G.dir_histogram_similarity(_n(s, d))


@query(
    "repository_summary",
    f"""{WITH}, x as (select e.* from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.wiki_id = b.wiki_id), g as (select node_id, count(*) as degree from (select source_id as node_id from x union all select target_id from x) group by 1),
p as (select n.wiki_id, coalesce(degree, 0) as degree from n left join g on g.node_id = n.node_id)
select wiki_id, count(*) as n_nodes, cast(sum(degree) / 2 as bigint) as n_edges, round(case when count(*) > 1 then (sum(degree) / 2) / (count(*) * (count(*) - 1)) else 0 end, 9) as density, round(avg(degree), 6) as avg_degree, max(degree) as max_degree, min(degree) as min_degree from p group by 1""",
)
def repository_summary(s, d):
    return G.summary(*_g(s, d))


_FIRST = "f as (select wiki_id, rel_path, symbol_name, min(node_id) as parent_id from n where is_architectural group by 1, 2, 3)"
_MAP = "mp as (select node_id, node_id as stands_for from n where is_architectural union all select n.node_id, f.parent_id from n join f on f.wiki_id = n.wiki_id and f.rel_path = n.rel_path and f.symbol_name = n.parent_symbol where not n.is_architectural and n.parent_symbol is not null)"


@query(
    "architectural_projection",
    f"{WITH}, {_FIRST}, {_MAP} select e.id, a.stands_for as source_id, b.stands_for as target_id, e.rel_type, e.weight from e join mp a on a.node_id = e.source_id join mp b on b.node_id = e.target_id where a.stands_for <> b.stands_for and coalesce(e.edge_class, 'structural') not in ('directory', 'bridge')",
)
def architectural_projection(s, d):
    return G.projection(*_g(s, d))


@query(
    "coverage_report",
    f"""{WITH}, c as (select distinct target_id as node_id from e where rel_type = 'references'), r as (select n.wiki_id, {DIR} as dir, case when c.node_id is null then 0 else 1 end as hit from n left join c on c.node_id = n.node_id where is_architectural)
select wiki_id, count(*) as n_symbols, cast(sum(hit) as bigint) as n_covered, round(avg(hit), 6) as ratio, count(distinct dir) as n_dirs, count(distinct case when hit = 1 then dir end) as n_dirs_covered from r group by 1""",
)
def coverage_report(s, d):
    n, e = _g(s, d)
    return G.coverage(n, e.where("rel_type = 'references'").select(F.col("target_id").alias("node_id")))
