"""The graph view of stored tables, scans, predicates, joins and aggregates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import scalars as X
from lodegraph.sources.tables import table

NODE_COLUMNS = ("wiki_id", "node_id", "rel_path", "file_name", "language", "start_line", "end_line", "symbol_name", "symbol_type", "parent_symbol", "macro_cluster", "micro_cluster", "is_hub")


def nodes_view(raw: DataFrame, *extra: str) -> DataFrame:
    """One row a node id: of several deliveries the latest (null `indexed_at` first, then the larger content).

    Types and languages are lower case; the flags is_architectural, is_doc and is_test are derived, never trusted.
    Only the columns asked for travel, so texts stay in the scan unless named in `extra`.
    """
    cols = [*NODE_COLUMNS, *extra]
    kept = raw.where("node_id is not null").select(*dict.fromkeys([*cols, "indexed_at"]))
    rest = [c for c in cols if c not in ("node_id", "indexed_at")]
    one = kept.groupBy("node_id").agg(F.max(F.struct("indexed_at", *rest)).alias("r")).select("node_id", *[F.col(f"r.{c}").alias(c) for c in cols if c != "node_id"])
    kind = F.lower(F.coalesce("symbol_type", F.lit("")))
    return (
        one.withColumn("symbol_type", kind)
        .withColumn("language", F.lower(F.coalesce("language", F.lit(""))))
        .withColumn("is_architectural", X.is_architectural_type(F.col("symbol_type")))
        .withColumn("is_doc", X.is_doc_type(F.col("symbol_type")))
        .withColumn("is_test", X.is_test_path(F.col("rel_path")))
    )


EDGE_COLUMNS = ("id", "wiki_id", "source_id", "target_id", "rel_type", "edge_class", "confidence", "weight")


def edges_view(raw: DataFrame, *extra: str) -> DataFrame:
    """One row an edge id (deliveries are alike); parallel edges stay."""
    cols = [*EDGE_COLUMNS, *extra]
    rest = [c for c in cols if c != "id"]
    return raw.where("id is not null").groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", "r.*")


def graph(spark: SparkSession, folder: str, node_extra: tuple = (), edge_extra: tuple = ()) -> tuple[DataFrame, DataFrame]:
    return nodes_view(table(spark, folder, "repo_nodes"), *node_extra), edges_view(table(spark, folder, "repo_edges"), *edge_extra)


# --- Scans and predicates -------------------------------------------------------------------------------------------
def by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.where(F.col("node_id").isin(ids))


def under_path(nodes: DataFrame, prefix: str, mode: str = "dir") -> DataFrame:
    """Nodes below a folder (mode 'dir') or whose path begins with the text (mode 'loose')."""
    return nodes.where(F.col("rel_path").startswith(prefix.rstrip("/") + "/" if mode == "dir" else prefix))


def in_cluster(nodes: DataFrame, macro: int, micro: int | None = None) -> DataFrame:
    got = nodes.where(F.col("macro_cluster") == macro)
    return got if micro is None else got.where(F.col("micro_cluster") == micro)


def clusters_nested(nodes: DataFrame) -> DataFrame:
    """macro, micro (null counts as 0), number of nodes and smallest node id."""
    return nodes.where("macro_cluster is not null").groupBy("macro_cluster", F.coalesce("micro_cluster", F.lit(0)).alias("micro")).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min("node_id").alias("first_node")
    )


def min_confidence(edges: DataFrame, least: str) -> DataFrame:
    return edges.where(X.confidence_rank(F.col("confidence")) >= S.CONFIDENCE_RANK[least])


def edge_types(names: list[str]) -> list[str]:
    """Edge types meant by names: each with what it stands for, and all that stand for it."""
    out: list[str] = []
    for n in names:
        canonical = S.EDGE_ALIASES.get(n, n)
        out += [n, canonical, *(a for a, c in S.EDGE_ALIASES.items() if c == canonical)]
    return sorted(set(out))


def endpoints(edges: DataFrame) -> DataFrame:
    """(node_id, rel_type) of both ends of every edge."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id"), "rel_type")


def has_relation(nodes: DataFrame, edges: DataFrame, *rels: str) -> DataFrame:
    """Nodes at which an edge of any of the types begins or ends."""
    ends = endpoints(edges.where(F.col("rel_type").isin(edge_types(list(rels)))))
    return nodes.join(ends.select("node_id"), "node_id", "left_semi")


# --- Degree and statistics ------------------------------------------------------------------------------------------
def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every endpoint; parallel edges count, a loop counts twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("n"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("n"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.n").alias("node_id")).agg(
        F.sum("x.o").alias("out_degree"), F.sum(1 - F.col("x.o")).alias("in_degree"), F.count(F.lit(1)).alias("degree")
    )


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).select("node_id", "degree"), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, label, n): totals, counts by language, type, relation and confidence (three buckets, zero-filled).

    One aggregate a table: totals and counts by each column are grouping sets of the same scan.
    """

    def counted(df: DataFrame, total: str, columns: list[str], **others: Column) -> DataFrame:
        """Rows of all of `df`, rows by each column, and further totals by name."""
        sets = df.groupingSets([*[[F.col(c)] for c in columns], []], *columns)
        got = sets.agg(F.count(F.lit(1)).alias("n"), *[agg.alias(f"total_{name}") for name, agg in others.items()], *[F.grouping(c).alias(f"no_{c}") for c in columns])
        metric, label = F.lit(total), F.lit("")
        for c in columns:
            metric, label = F.when(F.col(f"no_{c}") == 0, c).otherwise(metric), F.when(F.col(f"no_{c}") == 0, F.col(c)).otherwise(label)
        whole = F.lit(True)
        for c in columns:
            whole = whole & (F.col(f"no_{c}") == 1)
        row = lambda m, x, n: F.struct(m.alias("metric"), x.alias("label"), n.alias("n"))
        more = [F.when(whole, row(F.lit(name), F.lit(""), F.coalesce(F.col(f"total_{name}"), F.lit(0)).cast("long"))) for name in others]
        return got.select(F.explode(F.array_compact(F.array(row(metric, label, F.col("n")), *more))).alias("r")).select("r.*")

    per_node = counted(nodes, "nodes", ["language", "symbol_type"], macro_clusters=F.count_distinct("macro_cluster"), hubs=F.sum((F.col("is_hub") == 1).cast("long")))
    per_edge = counted(edges.select("rel_type", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")), "edges", ["rel_type", "confidence"])
    buckets = nodes.sparkSession.createDataFrame([(c,) for c in S.CONFIDENCE_RANK], "label string")  # three rows
    zeros = buckets.select(F.lit("confidence").alias("metric"), "label", F.lit(0).cast("long").alias("n"))
    return per_node.unionByName(per_edge.unionByName(zeros).where(F.col("metric").isin("edges", "rel_type") | F.col("label").isin(*S.CONFIDENCE_RANK)).groupBy("metric", "label").agg(F.sum("n").alias("n")))


def dominant_language(nodes: DataFrame, by: str) -> DataFrame:
    """Most frequent language of each group; ties go to the first in the alphabet."""
    counts = nodes.where("language <> ''").groupBy(by, "language").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("d"), "language")).alias("r")).select(by, "r.language", (-F.col("r.d")).alias("n"))


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Architectural symbols of the highest degree; ties by node id."""
    got = with_degree(nodes.where("is_architectural"), edges)
    return got.select("node_id", "symbol_name", "symbol_type", "rel_path", "degree").orderBy(F.desc("degree"), "node_id").limit(top)


def god_files(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Files by edges that leave them; internal_arch counts join rows, as edges do."""
    src = nodes.select(F.col("node_id").alias("source_id"), F.col("rel_path").alias("rel_path"), "is_architectural")
    tgt = nodes.select(F.col("node_id").alias("target_id"), F.col("rel_path").alias("target_path"))
    rows = edges.select("source_id", "target_id").join(src, "source_id").join(tgt, "target_id").where("target_path <> rel_path")
    return (
        rows.groupBy("rel_path").agg(F.sum(F.col("is_architectural").cast("long")).alias("internal_arch"), F.count(F.lit(1)).alias("external_edges"))
        .orderBy(F.desc("external_edges"), "rel_path").limit(top)
    )


def related_nodes(nodes: DataFrame, edges: DataFrame, direction: str, rel_types: list[str] | None = None, limit: int = 15) -> DataFrame:
    """Neighbours of every node in one direction, the first `limit` by (path, line, id); one row a distinct neighbour."""
    here, there = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    used = edges if rel_types is None else edges.where(F.col("rel_type").isin(rel_types))
    pairs = used.select(F.col(here).alias("node_id"), F.col(there).alias("other")).distinct()
    known = nodes.select(F.col("node_id").alias("other"), "rel_path", "start_line", "symbol_type")
    order = Window.partitionBy("node_id").orderBy(F.col("rel_path").asc_nulls_last(), F.col("start_line").asc_nulls_last(), "other")
    return pairs.join(known, "other").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def member_promotion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Synthesised member_uses edges: a class uses what its members refer to in other files.

    No edge is made where any edge but 'defines' already joins class and target.
    """
    own = nodes.where(F.col("symbol_type").isin("class", "struct", "interface", "trait") & F.col("is_architectural")).select(F.col("node_id").alias("c"), F.col("rel_path").alias("c_path"), "language")
    member = nodes.where(F.col("symbol_type").isin("method", "field", "property", "constructor")).select(F.col("node_id").alias("m"))
    target = nodes.select(F.col("node_id").alias("t"), F.col("rel_path").alias("t_path"))
    defines = edges.where("rel_type = 'defines'").select(F.col("source_id").alias("c"), F.col("target_id").alias("m"))
    uses = edges.where(F.col("rel_type").isin("references", "calls", "creates", "instantiates")).select(F.col("source_id").alias("m"), F.col("target_id").alias("t"))
    rows = defines.join(own, "c").join(member, "m").join(uses, "m").join(target, "t").where("t_path <> c_path and t <> c")
    other = edges.where("rel_type <> 'defines'").select(F.col("source_id").alias("c"), F.col("target_id").alias("t")).distinct()
    return rows.groupBy("c", "t").agg(F.count(F.lit(1)).alias("evidence")).join(other, ["c", "t"], "left_anti").select(
        F.col("c").alias("source_id"), F.col("t").alias("target_id"), F.lit("member_uses").alias("rel_type"), F.lit("INFERRED").alias("confidence"), F.col("evidence").cast("double").alias("weight")
    )


def local_constants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Constants that only their own file refers to: to be demoted. Constants without references stay."""
    constants = nodes.where("symbol_type = 'constant' and is_architectural").select(F.col("node_id").alias("target_id"), "rel_path")
    sources = nodes.select(F.col("node_id").alias("source_id"), F.col("rel_path").alias("from_path"))
    refs = edges.select("source_id", "target_id").join(constants, "target_id").join(sources, "source_id")
    return refs.groupBy("target_id", "rel_path").agg(F.count_distinct("from_path").alias("files"), F.max("from_path").alias("last")).where("files = 1 and last = rel_path").select(F.col("target_id").alias("node_id"), "rel_path")


def vendored_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("is_architectural") & X.is_vendored_path(F.col("rel_path")))


# --- Weights, hubs, orphans -----------------------------------------------------------------------------------------
def edge_weights(edges: DataFrame) -> DataFrame:
    """Edges weighted by 1 / ln(structural in-degree of the target + 2).

    Synthetic edges don't count as in-degree and weigh SYNTHETIC_FLOOR at least; calibrated ones keep their weight.
    """
    cls = F.coalesce("edge_class", F.lit("structural"))
    synthetic = cls.isin(*S.SYNTHETIC_CLASSES)
    indeg = edges.where(~synthetic).groupBy("target_id").agg(F.count(F.lit(1)).alias("in_degree"))
    raw = 1 / F.log(F.coalesce("in_degree", F.lit(0)) + 2)
    weight = F.when(cls.isin(*S.CALIBRATED_CLASSES) & F.col("weight").isNotNull(), F.col("weight")).when(synthetic, F.greatest(raw, F.lit(S.SYNTHETIC_FLOOR))).otherwise(raw)
    return edges.join(indeg, "target_id", "left").withColumn("new_weight", weight).drop("in_degree")


def weight_summary(weighted: DataFrame) -> DataFrame:
    w = F.col("new_weight")
    return weighted.agg(
        F.count(F.lit(1)).alias("edges_weighted"), F.sum(F.coalesce("edge_class", F.lit("structural")).isin(*S.SYNTHETIC_CLASSES).cast("long")).alias("synthetic"),
        F.round(F.min(w), 4).alias("min_weight"), F.round(F.max(w), 4).alias("max_weight"), F.round(F.avg(w), 4).alias("mean_weight"),
    )


def hubs(nodes: DataFrame, edges: DataFrame, z: float = 3.0) -> DataFrame:
    """Nodes whose in-degree is more than z deviations above the mean; none for fewer than three nodes or no spread."""
    indeg = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    all_of = nodes.select("node_id").join(indeg, "node_id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    moments = all_of.agg(F.avg("in_degree").alias("mean"), F.stddev_pop("in_degree").alias("std"), F.count(F.lit(1)).alias("n"))
    score = (F.col("in_degree") - F.col("mean")) / F.col("std")
    return all_of.crossJoin(F.broadcast(moments)).where("n >= 3 and std > 0").withColumn("z_score", score).where(F.col("z_score") > z).select("node_id", F.col("in_degree").cast("long").alias("in_degree"), "z_score")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).select("node_id"), "node_id", "left_anti")


# --- Clusters and folders -------------------------------------------------------------------------------------------
def surprising_connections(nodes: DataFrame, edges: DataFrame, depth: int = 1, top: int | None = None) -> DataFrame:
    """Pairs of macro clusters by how little the folders of their files overlap (1 - Jaccard), then by edges.

    Pairs of clusters without any folder are left out.
    """
    src = nodes.where("macro_cluster is not null").select(F.col("node_id").alias("source_id"), F.col("macro_cluster").alias("a"))
    tgt = nodes.where("macro_cluster is not null").select(F.col("node_id").alias("target_id"), F.col("macro_cluster").alias("b"))
    pairs = edges.select("source_id", "target_id").join(src, "source_id").join(tgt, "target_id").where("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("cluster_a"), F.greatest("a", "b").alias("cluster_b")).agg(F.count(F.lit(1)).alias("edge_count"))
    folders = nodes.where("macro_cluster is not null and rel_path <> ''").select("macro_cluster", X.path_prefix(F.col("rel_path"), depth).alias("p")).where("p <> ''").distinct()
    context = folders.groupBy("macro_cluster").agg(F.sort_array(F.collect_list("p")).alias("ctx"))
    none = F.array().cast("array<string>")
    side = lambda name, out: context.select(F.col("macro_cluster").alias(name), F.col("ctx").alias(out))
    joined = pairs.join(side("cluster_a", "ctx_a"), "cluster_a", "left").join(side("cluster_b", "ctx_b"), "cluster_b", "left")
    a, b = F.coalesce("ctx_a", none), F.coalesce("ctx_b", none)
    got = joined.where(F.size(F.array_union(a, b)) > 0).withColumn("jaccard_distance", 1 - X.jaccard(a, b)).select("cluster_a", "cluster_b", "edge_count", "jaccard_distance")
    return got if top is None else got.orderBy(F.desc("jaccard_distance"), F.desc("edge_count"), "cluster_a", "cluster_b").limit(top)


def sample_edges(nodes: DataFrame, edges: DataFrame, per_pair: int = 3) -> DataFrame:
    """The first edges of each pair of clusters by confidence, source, target, id."""
    src = nodes.select(F.col("node_id").alias("source_id"), F.col("macro_cluster").alias("a"))
    tgt = nodes.select(F.col("node_id").alias("target_id"), F.col("macro_cluster").alias("b"))
    rows = edges.join(src, "source_id").join(tgt, "target_id").where("a <> b").withColumn("cluster_a", F.least("a", "b")).withColumn("cluster_b", F.greatest("a", "b"))
    rank = F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    order = Window.partitionBy("cluster_a", "cluster_b").orderBy(rank, "source_id", "target_id", "id")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_pair).select("cluster_a", "cluster_b", "position", "id", "source_id", "target_id", "rel_type", "confidence")


def undirected(edges: DataFrame) -> DataFrame:
    """Parallel and opposite edges as one, weights summed (null counts as 1); loops fall out."""
    return edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(
        F.sum(F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)")).cast("double").alias("weight"), F.count(F.lit(1)).alias("n_edges")
    )


def file_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between files of one repository: weights summed over the edges between their symbols."""
    src = nodes.select(F.col("node_id").alias("source_id"), F.col("wiki_id").alias("w1"), F.col("rel_path").alias("from_path"))
    tgt = nodes.select(F.col("node_id").alias("target_id"), F.col("wiki_id").alias("w2"), F.col("rel_path").alias("to_path"))
    rows = edges.select("source_id", "target_id", "weight").join(src, "source_id").join(tgt, "target_id").where("w1 = w2 and from_path <> to_path")
    return rows.groupBy(F.col("w1").alias("wiki_id"), "from_path", "to_path").agg(F.sum(F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)")).cast("double").alias("weight"), F.count(F.lit(1)).alias("n_edges"))


#: Weight of a relation between folders.
RELATION_WEIGHT = {"inheritance": 5, "implementation": 5, "composition": 4, "creates": 3, "calls": 2, "uses_type": 2, "imports": 1, "references": 1}


def dir_interactions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted relations between folders of one repository."""
    side = lambda key, w, d: nodes.select(F.col("node_id").alias(key), F.col("wiki_id").alias(w), X.dirname(F.col("rel_path")).alias(d))
    weight = F.lit(1)
    for rel, n in RELATION_WEIGHT.items():
        weight = F.when(F.col("rel_type") == rel, n).otherwise(weight)
    rows = edges.select("source_id", "target_id", "rel_type").join(side("source_id", "w1", "from_dir"), "source_id").join(side("target_id", "w2", "to_dir"), "target_id").where("w1 = w2 and from_dir <> to_dir")
    return rows.groupBy(F.col("w1").alias("wiki_id"), "from_dir", "to_dir").agg(F.sum(weight).alias("weight"))


def dir_symbols(nodes: DataFrame) -> DataFrame:
    """Architectural symbols of every folder: how many, of how many types, and the first by priority and name."""
    rows = nodes.where("is_architectural and not is_doc").select("wiki_id", X.dirname(F.col("rel_path")).alias("dir"), "symbol_type", "symbol_name", X.type_priority(F.col("symbol_type")).alias("prio"))
    return rows.groupBy("wiki_id", "dir").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_distinct("symbol_type").alias("n_types"), F.min(F.struct((-F.col("prio")).alias("p"), "symbol_name")).alias("m")).select("wiki_id", "dir", "n_symbols", "n_types", F.col("m.symbol_name").alias("lead_symbol"))


def doc_clusters(nodes: DataFrame, share: float = 0.7) -> DataFrame:
    """Macro clusters that consist of documentation for more than `share`."""
    return nodes.where("macro_cluster is not null").groupBy("wiki_id", "macro_cluster").agg(F.avg(F.col("is_doc").cast("double")).alias("doc_ratio"), F.count(F.lit(1)).alias("n_nodes")).where(F.col("doc_ratio") > share)


def dir_histogram_similarity(nodes: DataFrame) -> DataFrame:
    """Similarity of macro clusters of a repository by their folders: the smaller count of each shared folder over the smaller cluster."""
    rows = nodes.where("macro_cluster is not null").select("wiki_id", "macro_cluster", X.dirname(F.col("rel_path")).alias("dir"))
    hist = rows.groupBy("wiki_id", "macro_cluster", "dir").agg(F.count(F.lit(1)).alias("n"))
    size = rows.groupBy("wiki_id", "macro_cluster").agg(F.count(F.lit(1)).alias("size"))
    a = hist.select("wiki_id", "dir", F.col("macro_cluster").alias("cluster_a"), F.col("n").alias("na"))
    b = hist.select("wiki_id", "dir", F.col("macro_cluster").alias("cluster_b"), F.col("n").alias("nb"))
    both = a.join(b, ["wiki_id", "dir"]).where("cluster_a < cluster_b").groupBy("wiki_id", "cluster_a", "cluster_b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    sz = lambda c, o: size.select("wiki_id", F.col("macro_cluster").alias(c), F.col("size").alias(o))
    return both.join(sz("cluster_a", "sa"), ["wiki_id", "cluster_a"]).join(sz("cluster_b", "sb"), ["wiki_id", "cluster_b"]).select("wiki_id", "cluster_a", "cluster_b", "shared", F.round(F.col("shared") / F.least("sa", "sb"), 6).alias("similarity"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: nodes, inner edges, density, mean, largest and smallest degree over its nodes."""
    home = nodes.select("node_id", "wiki_id")
    inner = edges.select("id", "source_id", "target_id").join(home.withColumnsRenamed({"node_id": "source_id", "wiki_id": "w1"}), "source_id").join(home.withColumnsRenamed({"node_id": "target_id", "wiki_id": "w2"}), "target_id").where("w1 = w2")
    deg = degrees(inner)
    per = home.join(deg, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n, m = F.count(F.lit(1)), F.sum("degree") / 2
    return per.groupBy("wiki_id").agg(
        n.alias("n_nodes"), m.cast("long").alias("n_edges"), F.round(F.when(n > 1, m / (n * (n - 1))).otherwise(0.0), 9).alias("density"),
        F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").cast("long").alias("max_degree"), F.min("degree").cast("long").alias("min_degree"),
    )


def projection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between architectural symbols: members stand for their parent in the same file. Loops fall out, parallel edges stay."""
    arch = nodes.where("is_architectural").select("wiki_id", "rel_path", F.col("symbol_name").alias("parent_symbol"), F.col("node_id").alias("parent_id"))
    first = arch.groupBy("wiki_id", "rel_path", "parent_symbol").agg(F.min("parent_id").alias("parent_id"))
    members = nodes.where("not is_architectural and parent_symbol is not null").join(first, ["wiki_id", "rel_path", "parent_symbol"]).select("node_id", F.col("parent_id").alias("stands_for"))
    mapping = nodes.where("is_architectural").select("node_id", F.col("node_id").alias("stands_for")).unionByName(members)
    src = mapping.withColumnsRenamed({"node_id": "source_id", "stands_for": "s"})
    tgt = mapping.withColumnsRenamed({"node_id": "target_id", "stands_for": "t"})
    kept = edges.where(~F.coalesce("edge_class", F.lit("structural")).isin("directory", "bridge"))
    return kept.select("id", "source_id", "target_id", "rel_type", "weight").join(src, "source_id").join(tgt, "target_id").where("s <> t").select("id", F.col("s").alias("source_id"), F.col("t").alias("target_id"), "rel_type", "weight")


def exact_lookup(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The node of the highest type priority for each (symbol_name, rel_path, language); ties by node id."""
    k = ["symbol_name", "rel_path", "language"]
    got = nodes.join(keys.select(*k).distinct(), k)
    return got.groupBy(*k).agg(F.min(F.struct((-X.type_priority(F.col("symbol_type"))).alias("p"), "node_id")).alias("r")).select(*k, "r.node_id")


def coverage(nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """Per repository: architectural symbols, those covered, the ratio, folders and covered folders."""
    rows = nodes.where("is_architectural").join(covered.select("node_id").distinct().withColumn("hit", F.lit(1)), "node_id", "left")
    d = X.dirname(F.col("rel_path"))
    hit = F.coalesce("hit", F.lit(0))
    return rows.groupBy("wiki_id").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum(hit).alias("n_covered"), F.round(F.avg(hit.cast("double")), 6).alias("ratio"),
        F.count_distinct(d).alias("n_dirs"), F.count_distinct(F.when(hit == 1, d)).alias("n_dirs_covered"),
    )
