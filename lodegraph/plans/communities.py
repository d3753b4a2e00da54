"""Queries of community detection and of what is done with clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.operators import clustering as C
from lodegraph.operators import graph as G
from lodegraph.plans.prelude import WITH
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


def _assigned(n):
    """The stored macro clusters as an assignment."""
    return n.where("macro_cluster is not null").select("wiki_id", "node_id", F.col("macro_cluster").alias("cluster"))


@query("macro_clusters")
def macro_clusters(s, d):
    return C.macro_clusters(*G.graph(s, d))


@query("hierarchical_clusters")
def hierarchical_clusters(s, d):
    return C.hierarchical(*G.graph(s, d))


@query("cluster_renumber", f"{WITH} select wiki_id, node_id, k as cluster from (select wiki_id, macro_cluster, row_number() over (partition by wiki_id order by count(*) desc, macro_cluster) - 1 as k from n where macro_cluster is not null group by 1, 2) z join n using (wiki_id, macro_cluster)")
def cluster_renumber(s, d):
    a = _assigned(G.nodes_view(table(s, d, "repo_nodes"))).select(F.col("wiki_id").alias("part"), F.col("node_id").alias("node"), F.col("cluster").alias("community"))
    return C.renumber(a).select(F.col("part").alias("wiki_id"), F.col("node").alias("node_id"), F.col("cluster").cast("long").alias("cluster"))


@query(
    "cluster_affinities",
    f"{WITH} select a.wiki_id, least(a.macro_cluster, b.macro_cluster) as a, greatest(a.macro_cluster, b.macro_cluster) as b, cast(sum(cast(coalesce(weight, 1) as decimal(18,6))) as double) as w from e join n a on a.node_id = e.source_id join n b on b.node_id = e.target_id where a.wiki_id = b.wiki_id and a.macro_cluster <> b.macro_cluster group by 1, 2, 3",
)
def cluster_affinities(s, d):
    n, e = G.graph(s, d)
    return C.affinities(_assigned(n), e)


@query("clusters_capped")
def clusters_capped(s, d):
    n, e = G.graph(s, d)
    return C.capped(_assigned(n), e)


@query("pages_sized", f"{WITH} select wiki_id, node_id, macro_cluster as cluster, cast(floor((row_number() over (partition by wiki_id, macro_cluster order by rel_path, start_line nulls first, node_id) - 1) / 25.0) as int) as page from n where macro_cluster is not null".replace("start_line nulls first", "start_line nulls last"))
def pages_sized(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"))
    return C.sized_pages(_assigned(n), n)


@query(
    "hub_reintegration",
    f"""{WITH}, h as (select target_id as node_id from e join n on n.node_id = e.target_id group by 1 having count(*) > 20), r as (select * from n where macro_cluster is not null and node_id not in (select node_id from h)),
x as (select source_id as node_id, target_id as other from e union all select target_id, source_id from e), v as (select x.node_id, r.macro_cluster as cluster, count(*) as k from x join r on r.node_id = x.other where x.node_id in (select node_id from h) group by 1, 2)
select h.node_id, coalesce((select cluster from v where v.node_id = h.node_id order by k desc, cluster limit 1), (select macro_cluster from r group by 1 order by count(*) desc, 1 limit 1)) as cluster from h""",
)
def hub_reintegration(s, d):
    n, e = G.graph(s, d)
    hubs = e.groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("c")).where("c > 20").join(n.select("node_id"), "node_id", "left_semi").select("node_id")
    return C.reintegrate(hubs, _assigned(n), e)


@query("cluster_stability")
def cluster_stability(s, d):
    """The stored partition against the same with a tenth of the nodes moved to a neighbouring cluster."""
    a = _assigned(G.nodes_view(table(s, d, "repo_nodes")))
    moved = F.when(F.pmod(F.xxhash64("node_id"), F.lit(10)) == 0, F.col("cluster") + 1).otherwise(F.col("cluster"))
    return C.stable_ids(a, a.withColumn("cluster", moved + 100))


_PRIO = "case symbol_type " + " ".join(f"when '{k}' then {v}" for k, v in S.TYPE_PRIORITY.items()) + " else 0 end"


@query(
    "page_centroids",
    f"""{WITH}, g as (select node_id, count(*) as degree from (select source_id as node_id from e union all select target_id from e) group by 1),
r as (select n.wiki_id, macro_cluster as cluster, n.node_id, coalesce(degree, 0) as degree, {_PRIO} as prio from n left join g on g.node_id = n.node_id where macro_cluster is not null),
z as (select *, round(0.6 * degree / greatest(max(degree) over w, 1) + 0.4 * prio / greatest(max(prio) over w, 1), 9) as raw, count(*) over w as k, max(case when prio >= 5 then 1 else 0 end) over w as lead from r window w as (partition by wiki_id, cluster)),
p as (select *, row_number() over (partition by wiki_id, cluster order by raw desc, node_id) as position, max(raw) over (partition by wiki_id, cluster) as top from z where lead = 0 or prio >= 5)
select wiki_id, cluster, node_id, round(case when top > 0 then raw / top else 0 end, 4) as score, position from p where position <= least(10, greatest(1, cast(round_even(sqrt(k), 0) as int)))""",
)
def page_centroids(s, d):
    n, e = G.graph(s, d)
    return C.centroids(n, e, _assigned(n)).withColumn("position", F.col("position").cast("long"))


@query("central_symbols")
def central_symbols(s, d):
    """The five symbols of the highest PageRank in each stored macro cluster, over edges within clusters."""
    from lodegraph.operators.traverse import pagerank

    n, e = G.graph(s, d)
    a = _assigned(n)
    side = lambda k, c: a.select(F.col("node_id").alias(k), F.concat_ws("|", "wiki_id", F.col("cluster").cast("string")).alias(c))
    inner = e.select("source_id", "target_id", "weight").join(side("source_id", "x"), "source_id").join(side("target_id", "y"), "target_id").where("x = y")
    ranks = pagerank(inner)
    rows = a.join(ranks, "node_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("wiki_id", "cluster").orderBy(F.desc(F.round("rank", 9)), "node_id"))).where("position <= 5").select("wiki_id", "cluster", "node_id", "position")


@query("size_targets", f"{WITH} select wiki_id, count(*) as n_nodes, least(200, greatest(8, cast(ceil(sqrt(count(*) / 7.0)) as bigint))) as pages, case when count(*) >= 5000 then 60 when count(*) >= 2000 then 45 when count(*) >= 500 then 35 else 25 end as page_size from n group by 1")
def size_targets(s, d):
    k = F.count(F.lit(1))
    return G.nodes_view(table(s, d, "repo_nodes")).groupBy("wiki_id").agg(
        k.alias("n_nodes"), F.least(F.lit(200), F.greatest(F.lit(8), F.ceil(F.sqrt(k / 7)))).cast("long").alias("pages"), F.when(k >= 5000, 60).when(k >= 2000, 45).when(k >= 500, 35).otherwise(25).alias("page_size"),
    )
