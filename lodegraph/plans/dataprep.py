"""Queries of the general data-preparation problems (2 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.balance import key_stats
from lodegraph.operators.dangling import dangling_edges, dangling_report
from lodegraph.sources.tables import table

#: Share of all rows from which a key counts as one of the few that hold most.
HOT_SHARE = 0.02


def _stats(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    return key_stats(table(spark, d, "repo_edges"), table(spark, d, "repo_nodes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    stats, total = _stats(spark, d)
    return stats.where((F.col("n_rows") >= HOT_SHARE * total) & (F.lit(total) > 0)).select("side", "node_id")


def p2_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)[0].drop("n_rows")


def _misses(spark: SparkSession, d: str) -> DataFrame:
    return dangling_edges(*(table(spark, d, t) for t in ("repo_edges", "repo_nodes", "project_nodes", "node_changes")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _misses(spark, d).select("edge_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return dangling_report(_misses(spark, d), "repo_edges")


QUERIES = {"p2_found": p2_found, "p2_key_stats": p2_key_stats, "p7_found": p7_found, "p7_report": p7_report}

_ENDS = "select 'target' as side, target_id as node_id, source_id as other, id, weight from repo_edges where target_id is not null union all select 'source', source_id, target_id, id, weight from repo_edges where source_id is not null"
_MISS = """with n as (select node_id, case when count(*) > count(indexed_at) then null else min(indexed_at) end as seen from repo_nodes group by 1),
e as (select distinct id, target_id, recorded_at, target_file, confidence from repo_edges where target_id is not null),
h as (select id, change_kind from (select e.id, c.change_kind, row_number() over (partition by e.id order by c.changed_at desc, c.change_id desc) as rn
  from e join node_changes c on c.node_id = e.target_id and c.changed_at <= e.recorded_at where c.change_kind in ('added', 'deleted')) where rn = 1),
m as (select e.*, case when n.node_id is null and p.node_id is null then 'missing' when n.node_id is not null and n.seen > e.recorded_at then 'not_yet_indexed'
  when n.node_id is not null and h.change_kind = 'deleted' then 'deleted' end as reason
  from e left join n on n.node_id = e.target_id left join (select distinct node_id from project_nodes) p on p.node_id = e.target_id left join h on h.id = e.id)
"""
SQL = {
    "p2_found": f"select side, node_id from ({_ENDS}) group by 1, 2 having count(*) >= {HOT_SHARE} * (select count(*) from repo_edges)",
    "p2_key_stats": f"""select side, node_id, count(*) as degree, cast(sum(cast(w as decimal(18,6))) as double) as weight_sum, count(distinct other) as n_neighbours, max(st) as symbol_type
from (select side, node_id, other, id, max(weight) as w from ({_ENDS}) group by 1, 2, 3, 4)
left join (select node_id, min(lower(symbol_type)) as st from repo_nodes group by 1) using (node_id) group by 1, 2""",
    "p7_found": _MISS + "select distinct id as edge_id from m where reason is not null",
    "p7_report": _MISS + "select 'repo_edges' as ref_table, strftime(recorded_at, '%Y-%m') as month, target_file, confidence, reason, count(*) as n_edges from m where reason is not null group by 1, 2, 3, 4, 5",
}
