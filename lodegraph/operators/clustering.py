"""Community detection and what is done with communities: caps, sizes, hubs, stable ids, leading symbols.

A repository of bounded size is solved in one task; larger ones move their nodes in distributed DataFrame rounds by the
same rule, so no large repository is collected into a task.
Greedy steps (merging to a cap, keeping ids) run per repository on cluster-level aggregates only.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.session import cut_lineage


# --- Size rules -----------------------------------------------------------------------------------------------------
def auto_resolution(n: int) -> float:
    return 1.0 if n < 2 else max(0.3, 1.0 - 0.2 * math.log10(n))


def max_sections(n: int) -> int:
    return 3 if n < 10 else max(3, min(15, round(math.log10(n) * 3)))


def max_pages(n: int) -> int:
    return 2 if n < 6 else max(2, min(8, round(math.log10(n) * 3)))


def section_target(files: int) -> int:
    return 5 if files < 10 else max(5, min(20, math.ceil(1.2 * math.log2(files))))


def page_target(nodes: int) -> int:
    return max(8, min(200, math.ceil(math.sqrt(nodes / 7))))


def max_page_size(nodes: int) -> int:
    return 60 if nodes >= 5000 else 45 if nodes >= 2000 else 35 if nodes >= 500 else 25


# --- Community detection --------------------------------------------------------------------------------------------
def _one_level(links: DataFrame, nodes: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(part, node, community) after rounds of moves that raise modularity; half of the nodes may move in a round."""
    both = links.select("part", "a", "b", "w").unionByName(links.where("a <> b").select("part", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    # A loop of a contracted node holds its inner weight once and counts twice in its degree.
    strength = both.groupBy("part", "a").agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))
    total = strength.groupBy("part").agg(F.sum("k").alias("m2"))
    info = cut_lineage(nodes.join(strength.withColumnRenamed("a", "node"), ["part", "node"], "left").join(total, "part", "left").select("part", "node", F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("m2", F.lit(1.0)).alias("m2")))
    out = cut_lineage(both.where("a <> b").groupBy("part", "a", "b").agg(F.sum("w").alias("w")))
    state = info.select("part", "node", F.col("node").alias("community"))
    for r in range(rounds):
        where = state.join(info, ["part", "node"])
        tot = where.groupBy("part", "community").agg(F.sum("k").alias("tot"))
        near = out.join(state.select("part", F.col("node").alias("b"), "community"), ["part", "b"]).groupBy("part", F.col("a").alias("node"), "community").agg(F.sum("w").alias("into"))
        stay = where.select("part", "node", "community", F.lit(0.0).alias("into"))
        options = near.unionByName(stay).groupBy("part", "node", "community").agg(F.sum("into").alias("into"))
        own = where.select("part", "node", F.col("community").alias("own"), "k", "m2")
        scored = options.join(own, ["part", "node"]).join(tot, ["part", "community"]).withColumn("others", F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0))
        gain = F.round(F.col("into") - resolution * F.col("k") * F.col("others") / F.col("m2"), 9)
        best = scored.withColumn("gain", gain).groupBy("part", "node").agg(
            F.min(F.struct((-F.col("gain")).alias("g"), (F.col("community") != F.col("own")).alias("moves"), "community")).alias("b"), F.first("own").alias("own")
        )
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        state, before = cut_lineage(best.select("part", "node", F.when(turn, F.col("b.community")).otherwise(F.col("own")).alias("community"))), state
        if r % 2 and state.join(before.withColumnRenamed("community", "was"), ["part", "node"]).where("community <> was").isEmpty():
            break
    return state


def _parity(node: str) -> int:
    return xxhash.xxh64_intdigest(node.encode(), 42) % 2  # as Spark's xxhash64


def local_level(nodes: list[str], links: dict[tuple[str, str], float], rounds: int, resolution: float) -> dict[str, str]:
    """`_one_level` for one small part, by the same rule."""
    k = dict.fromkeys(nodes, 0.0)
    out: dict[str, dict[str, float]] = {v: {} for v in nodes}
    for (a, b), w in links.items():
        k[a] += w
        k[b] += w
        if a != b:
            out[a][b] = out[a].get(b, 0.0) + w
            out[b][a] = out[b].get(a, 0.0) + w
    m2 = sum(k.values()) or 1.0
    turn = {v: _parity(v) for v in nodes}
    state = {v: v for v in nodes}
    for r in range(rounds):
        tot: dict[str, float] = {}
        for v, c in state.items():
            tot[c] = tot.get(c, 0.0) + k[v]
        nxt = {}
        for v, own in state.items():
            if turn[v] != r % 2 or not out[v]:
                nxt[v] = own
                continue
            into = {own: 0.0}
            for u, w in out[v].items():
                into[state[u]] = into.get(state[u], 0.0) + w
            nxt[v] = min((-round(w - resolution * k[v] * (tot[c] - (k[v] if c == own else 0.0)) / m2, 9), c != own, c) for c, w in into.items())[2]
        same = nxt == state
        state = nxt
        if r % 2 and same:
            break
    return state


def _local(nodes: pd.DataFrame, links: pd.DataFrame, resolution: float, levels: int, rounds: int) -> pd.DataFrame:
    edges: dict[tuple[str, str], float] = {}
    for a, b, w in links[["a", "b", "w"]].itertuples(index=False):
        edges[a, b] = edges.get((a, b), 0.0) + w
    here = sorted(set(nodes["node"]))
    member = {v: v for v in here}
    for _ in range(levels):
        state = local_level(here, edges, rounds, resolution)
        member = {v: state[m] for v, m in member.items()}
        merged: dict[tuple[str, str], float] = {}
        for (a, b), w in edges.items():
            key = (min(state[a], state[b]), max(state[a], state[b]))
            merged[key] = merged.get(key, 0.0) + w
        edges, here = merged, sorted(set(state.values()))
    return pd.DataFrame({"part": nodes["part"].iloc[0] if len(nodes) else None, "node": list(member), "community": list(member.values())})


#: Nodes and links of a part that one task may hold.
LOCAL = 200_000


def louvain(nodes: DataFrame, links: DataFrame, resolution: float = 1.0, levels: int = 2, rounds: int = 6, local: int = LOCAL) -> DataFrame:
    """(part, node, community): communities of each part's undirected weighted graph by modularity, level by level.

    `nodes` has part and node, `links` part, a, b, w (a <= b, one row a pair). Nodes without links are communities of
    their own. The result depends on the input alone, not on its order. Parts of at most `local` nodes and links are
    solved in a task each; larger ones by distributed rounds of the same rule.
    """
    nodes = nodes.select("part", "node").toDF("part", "node")  # fresh columns: both sides may stem from one table
    links = links.select("part", "a", "b", "w").toDF("part", "a", "b", "w")
    sizes = nodes.select("part").unionByName(links.select("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > local).select("part"))

    def solve(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return _local(n, e, resolution, levels, rounds)

    small = nodes.join(large, "part", "left_anti").groupBy("part").cogroup(links.join(large, "part", "left_anti").groupBy("part")).applyInPandas(solve, "part string, node string, community string")
    if large.isEmpty():
        return small
    return small.unionByName(_distributed(nodes.join(large, "part", "left_semi"), links.join(large, "part", "left_semi"), resolution, levels, rounds))


def _distributed(nodes: DataFrame, links: DataFrame, resolution: float, levels: int, rounds: int) -> DataFrame:
    member = nodes.select("part", "node", F.col("node").alias("community"))
    here, edges = nodes.select("part", "node"), links
    for _ in range(levels):
        step = _one_level(edges, here, rounds, resolution)
        member = cut_lineage(member.withColumnRenamed("community", "mid").join(step.select("part", F.col("node").alias("mid"), "community"), ["part", "mid"]).select("part", "node", "community"))
        to = step.withColumnRenamed("community", "c")
        e = edges.join(to.select("part", F.col("node").alias("a"), F.col("c").alias("ca")), ["part", "a"]).join(to.select("part", F.col("node").alias("b"), F.col("c").alias("cb")), ["part", "b"])
        edges = cut_lineage(e.groupBy("part", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        here = cut_lineage(step.select("part", F.col("community").alias("node")).distinct())
    return member


def modularity(links: DataFrame, member: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(part, modularity) of a partition."""
    m = member.select("part", "node", "community")
    e = links.join(m.select("part", F.col("node").alias("a"), F.col("community").alias("ca")), ["part", "a"]).join(m.select("part", F.col("node").alias("b"), F.col("community").alias("cb")), ["part", "b"])
    ends = e.select("part", F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy("part", "community").agg(F.sum("w").alias("k"))
    tot = e.groupBy("part").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    deg = ends.join(tot, "part").groupBy("part").agg(F.sum((F.col("k") / (2 * F.col("m"))) ** 2).alias("d"))
    return tot.join(deg, "part").select("part", (F.col("inner") / F.col("m") - resolution * F.col("d")).alias("modularity"))


def renumber(member: DataFrame) -> DataFrame:
    """(part, node, cluster): communities numbered from 0 by size, ties by community."""
    sizes = member.groupBy("part", "community").agg(F.count(F.lit(1)).alias("size"))
    number = sizes.withColumn("cluster", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "community")) - 1)
    return member.join(number.select("part", "community", "cluster"), ["part", "community"]).select("part", "node", "cluster")


def _within(nodes: DataFrame, edges: DataFrame, part) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected links of a graph whose parts don't touch."""
    home = nodes.select("node_id", part.alias("part"))
    inner = edges.join(home.select(F.col("node_id").alias("source_id"), F.col("part").alias("p1")), "source_id").join(home.select(F.col("node_id").alias("target_id"), F.col("part").alias("p2")), "target_id").where("p1 = p2 and source_id <> target_id")
    links = inner.groupBy(F.col("p1").alias("part"), F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)")).cast("double").alias("w"))
    return home.select("part", F.col("node_id").alias("node")), links


def macro_clusters(nodes: DataFrame, edges: DataFrame, resolution: float = 0.5, levels: int = 2) -> DataFrame:
    """(wiki_id, node_id, macro) over architectural symbols of each repository."""
    n, links = _within(nodes.where("is_architectural"), G.projection(nodes, edges), F.col("wiki_id"))
    return renumber(louvain(n, links, resolution, levels)).select(F.col("part").alias("wiki_id"), F.col("node").alias("node_id"), F.col("cluster").alias("macro"))


def micro_clusters(nodes: DataFrame, edges: DataFrame, macro: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(wiki_id, node_id, macro, micro): communities within each macro cluster."""
    m = macro.withColumn("key", F.concat_ws("\u0001", "wiki_id", F.col("macro").cast("string")))
    n, links = _within(m.select("node_id", "key"), G.projection(nodes, edges), F.col("key"))
    got = renumber(louvain(n, links, resolution, 1)).select(F.col("node").alias("node_id"), F.col("cluster").alias("micro"))
    return macro.join(got, "node_id").select("wiki_id", "node_id", "macro", "micro")


def file_sections(nodes: DataFrame, edges: DataFrame, resolution: float = 0.5) -> DataFrame:
    """(wiki_id, rel_path, section): communities of the contracted file graph."""
    fg = G.file_graph(nodes, edges)
    files = nodes.where("rel_path <> ''").select(F.col("wiki_id").alias("part"), F.col("rel_path").alias("node")).distinct()
    links = fg.groupBy(F.col("wiki_id").alias("part"), F.least("from_path", "to_path").alias("a"), F.greatest("from_path", "to_path").alias("b")).agg(F.sum("weight").alias("w"))
    return renumber(louvain(files, links, resolution)).select(F.col("part").alias("wiki_id"), F.col("node").alias("rel_path"), F.col("cluster").alias("section"))


def hierarchical(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(wiki_id, node_id, macro, micro): sections over files, pages within sections."""
    sections = file_sections(nodes, edges)
    macro = nodes.where("is_architectural").join(sections, ["wiki_id", "rel_path"]).select("wiki_id", "node_id", F.col("section").alias("macro"))
    return micro_clusters(nodes, edges, macro)


# --- Greedy steps on cluster-level tables ---------------------------------------------------------------------------
def affinities(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(wiki_id, a, b, w): weight of the edges between clusters of a repository."""
    side = lambda k, c: assigned.select(F.col("node_id").alias(k), F.col("wiki_id").alias(f"w_{c}"), F.col("cluster").alias(c))
    rows = edges.select("source_id", "target_id", "weight").join(side("source_id", "x"), "source_id").join(side("target_id", "y"), "target_id").where("w_x = w_y and x <> y")
    return rows.groupBy(F.col("w_x").alias("wiki_id"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)")).cast("double").alias("w"))


def merge_to_cap(sizes: pd.DataFrame, pairs: pd.DataFrame, cap: int) -> dict[int, int]:
    """Merge the smallest cluster into the one it is most tied to (ties: larger, then smaller id) until `cap` are left; numbers by size."""
    size = dict(zip(sizes["cluster"].tolist(), sizes["size"].tolist()))
    into = {c: c for c in size}
    tie: dict[int, dict[int, float]] = {c: {} for c in size}
    for a, b, w in pairs[["a", "b", "w"]].itertuples(index=False):
        tie[a][b] = tie[a].get(b, 0.0) + w
        tie[b][a] = tie[b].get(a, 0.0) + w
    while len(size) > cap:
        small = min(size, key=lambda c: (size[c], c))
        best = max((c for c in size if c != small), key=lambda c: (tie[small].get(c, 0.0), size[c], -c))
        size[best] += size.pop(small)
        for other, w in tie.pop(small).items():
            tie[other].pop(small, None)
            if other != best:
                tie[best][other] = tie[best].get(other, 0.0) + w
                tie[other][best] = tie[other].get(best, 0.0) + w
        into = {c: best if t == small else t for c, t in into.items()}
    number = {c: i for i, c in enumerate(sorted(size, key=lambda c: (-size[c], c)))}
    return {c: number[t] for c, t in into.items()}


def capped(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(wiki_id, node_id, cluster) with at most max_sections(nodes) clusters a repository."""
    sizes = assigned.groupBy("wiki_id", "cluster").agg(F.count(F.lit(1)).alias("size"))

    def run(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if s.empty:
            return pd.DataFrame({"wiki_id": [], "cluster": [], "merged": []})
        to = merge_to_cap(s, p, max_sections(int(s["size"].sum())))
        return pd.DataFrame({"wiki_id": s["wiki_id"].iloc[0], "cluster": list(to), "merged": list(to.values())})

    merged = sizes.groupBy("wiki_id").cogroup(affinities(assigned, edges).groupBy("wiki_id")).applyInPandas(run, "wiki_id string, cluster int, merged int")
    return assigned.join(merged, ["wiki_id", "cluster"]).select("wiki_id", "node_id", F.col("merged").alias("cluster"))


def sized_pages(assigned: DataFrame, nodes: DataFrame, most: int = 25) -> DataFrame:
    """(wiki_id, node_id, cluster, page): clusters cut into pages of at most `most` symbols, in order of file and line."""
    rows = assigned.join(nodes.select("node_id", "rel_path", "start_line"), "node_id")
    order = Window.partitionBy("wiki_id", "cluster").orderBy("rel_path", F.col("start_line").asc_nulls_last(), "node_id")
    return rows.withColumn("page", F.floor((F.row_number().over(order) - 1) / most).cast("int")).select("wiki_id", "node_id", "cluster", "page")


def reintegrate(hubs: DataFrame, assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, cluster): each hub joins the cluster it has most edges to, else the largest; ties by smaller cluster."""
    rest = assigned.join(hubs.select("node_id"), "node_id", "left_anti")
    both = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("h"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("h"), F.col("source_id").alias("o")))).alias("x")).select(F.col("x.h").alias("node_id"), F.col("x.o").alias("other"))
    votes = both.join(hubs.select("node_id"), "node_id", "left_semi").join(rest.select(F.col("node_id").alias("other"), "cluster"), "other").groupBy("node_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("node_id").agg(F.min(F.struct((-F.col("n")).alias("d"), "cluster")).alias("b")).select("node_id", F.col("b.cluster").alias("cluster"))
    largest = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("d"), "cluster")).alias("b")).select(F.col("b.cluster").alias("largest"))
    return hubs.select("node_id").join(chosen, "node_id", "left").crossJoin(F.broadcast(largest)).select("node_id", F.coalesce("cluster", "largest").alias("cluster"))  # one row


def keep_ids(overlap: pd.DataFrame, threshold: float = 0.5) -> dict[int, int]:
    """New cluster -> stable id. The largest new cluster chooses first; the best unclaimed old one of at least `threshold` Jaccard, ties by smaller id; others get fresh ids.

    `overlap` has new, old, both, new_size, old_size; old may be null where a new cluster meets none.
    """
    fresh = int(overlap["max_old"].max()) + 1 if overlap["max_old"].notna().any() else 0
    sizes = overlap.groupby("new")["new_size"].first()
    claimed: set[int] = set()
    out: dict[int, int] = {}
    for new in sorted(sizes.index, key=lambda c: (-sizes[c], c)):
        mine = overlap[(overlap["new"] == new) & overlap["old"].notna()]
        scored = sorted(((-r.both / (r.new_size + r.old_size - r.both), int(r.old)) for r in mine.itertuples() if int(r.old) not in claimed))
        if scored and -scored[0][0] >= threshold:
            out[int(new)] = scored[0][1]
            claimed.add(scored[0][1])
    for new in sorted(sizes.index, key=lambda c: (-sizes[c], c)):
        if int(new) not in out:
            out[int(new)] = fresh
            fresh += 1
    return out


def stable_ids(old: DataFrame, new: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(wiki_id, cluster, stable): ids of an earlier partition kept for clusters that are mostly the same."""
    ns = new.groupBy("wiki_id", F.col("cluster").alias("new")).agg(F.count(F.lit(1)).alias("new_size"))
    os = old.groupBy("wiki_id", F.col("cluster").alias("old")).agg(F.count(F.lit(1)).alias("old_size"))
    both = new.select("wiki_id", "node_id", F.col("cluster").alias("new")).join(old.select("wiki_id", "node_id", F.col("cluster").alias("old")), ["wiki_id", "node_id"]).groupBy("wiki_id", "new", "old").agg(F.count(F.lit(1)).alias("both"))
    top = os.groupBy("wiki_id").agg(F.max("old").alias("max_old"))
    rows = ns.join(both, ["wiki_id", "new"], "left").join(os, ["wiki_id", "old"], "left").join(top, "wiki_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        to = keep_ids(pdf, threshold)
        return pd.DataFrame({"wiki_id": pdf["wiki_id"].iloc[0], "cluster": list(to), "stable": list(to.values())})

    return rows.groupBy("wiki_id").applyInPandas(run, "wiki_id string, cluster int, stable int")


# --- Leading symbols ------------------------------------------------------------------------------------------------
def centroids(nodes: DataFrame, edges: DataFrame, assigned: DataFrame, least_priority: int = 5) -> DataFrame:
    """(wiki_id, cluster, node_id, score, position): the leading symbols of each cluster.

    0.6 * degree / max + 0.4 * type priority / max; symbols of low priority lead only where there are no others; the
    square root of the cluster's size leads, 1 to 10; scores are relative to the first.
    """
    rows = assigned.join(G.with_degree(nodes, edges).select("node_id", "degree", X.type_priority(F.col("symbol_type")).alias("prio")), "node_id")
    c = Window.partitionBy("wiki_id", "cluster")
    scored = rows.withColumns({"md": F.greatest(F.max("degree").over(c), F.lit(1)), "mp": F.greatest(F.max("prio").over(c), F.lit(1)), "n": F.count(F.lit(1)).over(c)})
    scored = scored.withColumn("raw", F.round(0.6 * F.col("degree") / F.col("md") + 0.4 * F.col("prio") / F.col("mp"), 9))
    pool = scored.withColumn("lead", F.max((F.col("prio") >= least_priority).cast("int")).over(c)).where((F.col("lead") == 0) | (F.col("prio") >= least_priority))
    ranked = pool.withColumns({"position": F.row_number().over(c.orderBy(F.desc("raw"), "node_id")), "top": F.max("raw").over(c)})
    k = F.least(F.lit(10), F.greatest(F.lit(1), F.bround(F.sqrt("n")).cast("int")))
    return ranked.where(F.col("position") <= k).select("wiki_id", "cluster", "node_id", F.round(F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(0.0), 4).alias("score"), "position")

