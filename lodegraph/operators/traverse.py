"""Traversal: neighbours within hops, relationship listings, shortest paths, components and rank.

Loops run on the driver over distributed frontiers. Lineage is cut with reliable checkpoints in the shared folder, so
lost executors cost no result; a frontier is anti-joined with what was seen, so work shrinks as it closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import edge_types, min_confidence
from lodegraph.session import cut_lineage, parallelism


#: Walks of so many hops are one lazy plan; longer ones cut lineage and end early.
SHORT_WALK = 3


def arcs(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct (here, there) of edges followed out, in or both ways."""
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"))
    back = out.select(F.col("there").alias("here"), F.col("here").alias("there"))
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(seed, node_id, hop): nodes reached from each seed by at most `hops` edges, the seed left out, at their least hop.

    `seeds` has one column, node_id. Steps that reach nobody new end the walk.
    """
    step = arcs(edges, direction)
    seen = seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        nxt = frontier.join(step, frontier.node_id == step.here).select("seed", F.col("there").alias("node_id")).distinct()
        nxt = nxt.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = nxt
        seen = seen.unionByName(frontier)
        if hop < hops and hops > SHORT_WALK:
            frontier = cut_lineage(frontier)
            if frontier.isEmpty():
                break
            seen = cut_lineage(seen) if hop > 1 else seen
    return seen.where("hop > 0")


def relationships(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", least: str | None = None, rel_types: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Edges met on the way from the seeds, with the hop at which they are first met; one row a (source, target, type)."""
    used = edges
    if rel_types:
        used = used.where(F.col("rel_type").isin(edge_types(rel_types)))
    if least:
        used = min_confidence(used, least)
    at = reach(used, seeds, depth - 1, direction).select("node_id", "hop") if depth > 1 else None
    start = seeds.select("node_id", F.lit(0).alias("hop"))
    met = (start if at is None else start.unionByName(at)).groupBy("node_id").agg(F.min("hop").alias("hop"))
    ways = {"out": ("source_id",), "in": ("target_id",), "both": ("source_id", "target_id")}[direction]
    found = None
    for end in ways:
        part = used.join(met.withColumnRenamed("node_id", end), end).select("source_id", "target_id", "rel_type", (F.col("hop") + 1).alias("hop"))
        found = part if found is None else found.unionByName(part)
    rows = found.groupBy("source_id", "target_id", "rel_type").agg(F.min("hop").alias("hop"))
    return rows if top is None else rows.orderBy("hop", "source_id", "target_id", "rel_type").limit(top)


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = 25) -> DataFrame:
    """Nodes of a shortest undirected path: (position, node_id). No rows if there is none within `max_depth` edges.

    Of equally short paths the one through smaller predecessors is told.
    """
    spark = edges.sparkSession
    step = arcs(edges, "both").persist()
    seen = spark.createDataFrame([(start, None, 0)], "node_id string, parent string, hop int")
    frontier, found = seen, start == goal
    for hop in range(1, max_depth + 1):
        if found:
            break
        nxt = frontier.join(step, frontier.node_id == step.here).groupBy(F.col("there").alias("node_id")).agg(F.min("here").alias("parent"))
        frontier = cut_lineage(nxt.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
        found = not frontier.where(F.col("node_id") == goal).isEmpty()
    path: list[str] = []
    at = goal if found else None
    while at is not None:  # at most max_depth rows of one path
        path.append(at)
        at = None if at == start else seen.where(F.col("node_id") == at).first().parent
    step.unpersist()
    return spark.createDataFrame(list(enumerate(reversed(path))), "position int, node_id string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node id of the weakly connected component. Edges to ids that are no node tie nothing.

    Every vertex is hooked to its smallest neighbour, chains of hooks are shortened, and the links between what is left
    are carried into the next round without loops and repeats. Links only shrink and each round leaves the local minima, so it
    ends by itself; a hot vertex costs one row a neighbour until its neighbours are one with it.
    """
    known = nodes.select("node_id").distinct()
    inner = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    links = cut_lineage(inner.join(known.withColumnRenamed("node_id", "a"), "a", "left_semi").join(known.withColumnRenamed("node_id", "b"), "b", "left_semi"))
    labels = cut_lineage(known.select("node_id", F.col("node_id").alias("component")))
    while not links.isEmpty():
        # Both ends of every link are hooked: to the smallest id among themselves and their neighbours.
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")), F.struct(F.col("b").alias("v"), F.col("a").alias("to")))).alias("x")).select("x.*")
        hook = ends.groupBy("v").agg(F.min("to").alias("to")).select("v", F.least("v", "to").alias("to"))
        for _ in range(2):
            further = hook.select(F.col("v").alias("to"), F.col("to").alias("next"))
            hook = hook.join(further, "to").select("v", F.col("next").alias("to"))
        hook = cut_lineage(hook)
        end = lambda c: hook.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))
        moved = links.join(end("a"), "a").join(end("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        links = cut_lineage(moved.where("a <> b").distinct())
        labels = cut_lineage(labels.join(hook.withColumnRenamed("v", "component"), "component", "left").select("node_id", F.coalesce("to", "component").alias("component")))
    return labels


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """(node_id, rank) of the undirected graph of weighted edges; ranks sum to 1.

    Rounds go on until the ranks change by less than `tolerance` a node; if `most_rounds` don't do, that is an error. Links
    are partitioned by their start once and stay so; a round moves the summed flows only.
    """
    both = edges.where("source_id <> target_id").select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("x"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    links = both.groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("w").alias("w")).where("w > 0")
    out = links.groupBy("a").agg(F.sum("w").alias("total"))
    tasks = parallelism(edges.sparkSession)
    links = cut_lineage(links.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p"))).repartition(tasks, "a").persist()
    try:
        nodes = cut_lineage(links.select(F.col("a").alias("node_id")).distinct())
        n = nodes.count()
        if not n:
            return nodes.select("node_id", F.lit(0.0).alias("rank"))
        ranks = nodes.withColumn("rank", F.lit(1.0 / n))
        for i in range(most_rounds):
            flow = links.join(ranks, links.a == ranks.node_id).groupBy(F.col("b").alias("node_id")).agg(F.sum(F.col("rank") * F.col("p")).alias("flow"))
            nxt = flow.select("node_id", (F.lit((1 - damping) / n) + damping * F.col("flow")).alias("rank"))
            if i % 5 == 4:
                before, nxt = ranks, cut_lineage(nxt)
                change = nxt.join(before.withColumnRenamed("rank", "before"), "node_id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
                if change < n * tolerance:
                    return nxt
            ranks = nxt
    finally:
        links.unpersist()
    raise RuntimeError(f"ranks still change after {most_rounds} rounds")
