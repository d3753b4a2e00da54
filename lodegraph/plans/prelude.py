"""SQL of the graph view: the same rows as operators.graph.nodes_view / edges_view, as common table expressions n and e."""

from __future__ import annotations

from lodegraph import schema as S


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_ORDER = "indexed_at desc nulls last, wiki_id desc, rel_path desc, file_name desc, language desc, start_line desc, end_line desc, symbol_name desc, symbol_type desc"
NODES = f"""n0 as (select * from (select *, row_number() over (partition by node_id order by {_ORDER}) as rn0 from repo_nodes where node_id is not null) where rn0 = 1),
n as (select wiki_id, node_id, rel_path, file_name, lower(coalesce(language, '')) as language, start_line, end_line, symbol_name, lower(coalesce(symbol_type, '')) as symbol_type, parent_symbol,
 macro_cluster, micro_cluster, is_hub, source_text, docstring, signature, content_hash, embedding_content_hash, chunk_type, api_surface, indexed_at,
 lower(coalesce(symbol_type, '')) in ({sql_list(S.ARCHITECTURAL_TYPES)}) as is_architectural,
 (lower(coalesce(symbol_type, '')) in ({sql_list(S.DOC_TYPES)}) or regexp_matches(lower(coalesce(symbol_type, '')), '_(document|section|chunk)$')) as is_doc,
 coalesce(regexp_matches(rel_path, '(?i){"|".join(S.TEST_PATHS)}'), false) as is_test from n0)"""
EDGES = "e as (select distinct id, wiki_id, source_id, target_id, rel_type, edge_class, confidence, weight, source_file, target_file, created_by, recorded_at from repo_edges where id is not null)"
WITH = f"with {NODES}, {EDGES}"
WITHR = f"with recursive {NODES}, {EDGES}"
DIR = "regexp_extract(rel_path, '^(.*)/[^/]*$', 1)"
#: Weakly connected components (after WITHR): cp has node_id and component, the smallest id that reaches it.
COMPONENTS = """cl as (select source_id as a, target_id as b from e where source_id <> target_id and source_id in (select node_id from n) and target_id in (select node_id from n) union select target_id, source_id from e where source_id <> target_id and source_id in (select node_id from n) and target_id in (select node_id from n)),
cr(seed, node_id) as (select node_id, node_id from n union select cr.seed, cl.b from cr join cl on cl.a = cr.node_id), cp as (select node_id, min(seed) as component from cr group by 1)"""
DEGREE = "dg as (select node_id, count(*) as degree from (select source_id as node_id from e union all select target_id from e) group by 1)"
