"""Context around symbols: typed expansion by a rule table, alias chains, two-hop finders, retrieval expansion, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.functions import scalars as X
from lodegraph.operators import linking as L

_CLASSES = ("class", "interface", "struct", "enum", "trait")
#: What is followed from a symbol of a type: (types, relations, direction, at most, reason).
RULES = (
    (_CLASSES, ("inheritance", "implementation"), "out", 3, "base"),
    (_CLASSES, ("inheritance", "implementation"), "in", 3, "derived"),
    (_CLASSES, ("creates", "instantiates"), "out", 2, "creates"),
    (_CLASSES, ("composition", "aggregation"), "out", 2, "composes"),
    (_CLASSES, ("composition", "aggregation"), "in", 2, "composed_by"),
    (_CLASSES, ("references",), "out", 2, "refs"),
    (("function",), ("calls",), "out", 3, "calls"),
    (("function",), ("calls",), "in", 3, "called_by"),
    (("function",), ("creates", "instantiates"), "out", 2, "creates"),
    (("function",), ("references", "composition"), "out", 2, "refs"),
)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node_id, other, direction, rel_type, weight): every edge seen from both ends, parallel ones as one of their greatest weight."""
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other"), F.lit("out").alias("direction"), "rel_type", "weight")
    back = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other"), F.lit("in").alias("direction"), "rel_type", "weight")
    return out.unionByName(back).groupBy("node_id", "other", "direction", "rel_type").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = 10) -> DataFrame:
    """(seed, node_id, reason, weight, position): neighbours that the rules allow, the heaviest first, at most `budget` a seed.

    Only architectural symbols outside tests are taken. Each rule takes its own few; ties go by node id.
    """
    table = [(t, r, d, n, why) for types, rels, d, n, why in RULES for t in types for r in rels]
    rules = F.broadcast(nodes.sparkSession.createDataFrame(table, "symbol_type string, rel_type string, direction string, most int, reason string"))
    valid = nodes.where("is_architectural and not is_test").where(F.col("symbol_type").isin(*S.EXPANSION_TYPES)).select(F.col("node_id").alias("other"))
    rows = seeds.select("node_id").join(nodes.select("node_id", "symbol_type"), "node_id").join(both_ways(edges), "node_id").join(rules, ["symbol_type", "rel_type", "direction"]).join(valid, "other").where("node_id <> other")
    few = rows.withColumn("rn", F.row_number().over(Window.partitionBy("node_id", "reason").orderBy(F.desc("weight"), "other", "rel_type"))).where("rn <= most")
    one = few.groupBy("node_id", "other").agg(F.max(F.struct("weight", "reason")).alias("b"))
    ranked = one.withColumn("position", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("b.weight"), "other")))
    return ranked.where(F.col("position") <= budget).select(F.col("node_id").alias("seed"), F.col("other").alias("node_id"), "b.reason", "b.weight", "position")


def retrieval_expansion(edges: DataFrame, hits: DataFrame, per_hit: int = 15, total: int = 150) -> DataFrame:
    """(seed, node_id, confidence_rank): one hop around retrieved nodes, the surest edges first, `per_hit` each and `total` in all."""
    rank = X.confidence_rank(F.col("confidence"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("s"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("s"), F.col("source_id").alias("o")))).alias("x"), rank.alias("r"))
    rows = ends.select(F.col("x.s").alias("seed"), F.col("x.o").alias("node_id"), "r").join(hits.select(F.col("node_id").alias("seed")), "seed", "left_semi")
    best = rows.join(hits.select("node_id"), "node_id", "left_anti").groupBy("seed", "node_id").agg(F.max("r").alias("confidence_rank"))
    order = Window.partitionBy("seed").orderBy(F.desc("confidence_rank"), "node_id")
    return best.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_hit).orderBy(F.desc("confidence_rank"), "seed", "node_id").limit(total).select("seed", "node_id", "confidence_rank")


def alias_targets(nodes: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """(node_id, resolved): type aliases followed along alias_of edges to the first symbol that is none; a ring or an end stops the walk."""
    step = edges.where("rel_type = 'alias_of'").groupBy(F.col("source_id").alias("at")).agg(F.min("target_id").alias("next"))
    kinds = nodes.select(F.col("node_id").alias("next"), "symbol_type")
    walk = nodes.where("symbol_type = 'type_alias'").select("node_id", F.col("node_id").alias("at"), F.array("node_id").alias("seen"), F.lit(False).alias("done"))
    for _ in range(hops):
        walk = walk.join(step, "at", "left").join(kinds, "next", "left")
        go = ~F.col("done") & F.col("next").isNotNull() & F.col("symbol_type").isNotNull() & ~F.array_contains("seen", F.col("next"))
        walk = walk.select(
            "node_id", F.when(go, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"),
            (F.col("done") | ~go | (F.col("symbol_type") != "type_alias")).alias("done"),
        )
    return walk.where("at <> node_id").select("node_id", F.col("at").alias("resolved"))


#: Two-hop finders from a class: (first relation, type in the middle, second relations, at most).
TWO_HOPS = {"field_types": ("defines", "field", ("composition", "aggregation"), 5), "created_types": ("defines", "method", ("creates", "instantiates"), 4), "called_functions": ("defines", "method", ("calls",), 3)}


def two_hops(nodes: DataFrame, edges: DataFrame, finder: str) -> DataFrame:
    """(node_id, target_id): what the members of a class lead to, the first few by target id."""
    first, middle, second, most = TWO_HOPS[finder]
    a = edges.where(F.col("rel_type") == first).select(F.col("source_id").alias("node_id"), F.col("target_id").alias("m")).distinct()
    m = nodes.where(F.col("symbol_type") == middle).select(F.col("node_id").alias("m"))
    b = edges.where(F.col("rel_type").isin(*second)).select(F.col("source_id").alias("m"), "target_id").distinct()
    own = nodes.where(F.col("symbol_type").isin(*_CLASSES)).select("node_id")
    rows = a.join(own, "node_id", "left_semi").join(m, "m").join(b, "m").where("target_id <> node_id").select("node_id", "target_id").distinct()
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("node_id").orderBy("target_id"))).where(F.col("rn") <= most).drop("rn")


def with_bodies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, text): a declaration with the bodies that defines_body edges lead to, in order of path and line."""
    body = edges.where("rel_type = 'defines_body'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("b")).distinct()
    text = nodes.select(F.col("node_id").alias("b"), "rel_path", "start_line", F.col("source_text").alias("body"))
    per = body.join(text, "b").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rel_path", "start_line", "body"))).alias("bs"))
    return nodes.join(per, "node_id", "left").select("node_id", F.concat_ws("\n\n", "source_text", F.array_join(F.transform("bs", lambda x: x.body), "\n\n")).alias("text"))


#: Scores of relations and types in document ranking.
RELATION_SCORE = {"contains": 15, "defines": 15, "calls": 12, "inheritance": 10, "implementation": 10, "composition": 8, "aggregation": 8}
TYPE_SCORE = {"class": 10, "interface": 10, "struct": 9, "enum": 8, "trait": 8, "function": 6, "method": 5, "constant": 3}


def rank_documents(nodes: DataFrame, edges: DataFrame, topic: str, folders: list[str], distance: DataFrame) -> DataFrame:
    """(node_id, score): relevance of symbols to a topic node: +20 in a target folder, relations to the topic, type, closeness of folders, -0.5 a hop (-5 unreachable), -1 or -2 for large texts.

    `distance` has node_id and hop.
    """
    related = edges.where((F.col("source_id") == topic) | (F.col("target_id") == topic)).withColumn("node_id", F.when(F.col("source_id") == topic, F.col("target_id")).otherwise(F.col("source_id")))
    rel = F.lit(0)
    for name, score in RELATION_SCORE.items():
        rel = F.when(F.col("rel_type") == name, score).otherwise(rel)
    tie = related.groupBy("node_id").agg(F.max(rel).alias("rel"))
    kind = F.lit(1)
    for name, score in TYPE_SCORE.items():
        kind = F.when(F.col("symbol_type") == name, score).otherwise(kind)
    home = nodes.where(F.col("node_id") == topic).select(F.col("rel_path").alias("home")).limit(1)
    rows = nodes.crossJoin(F.broadcast(home)).join(tie, "node_id", "left").join(distance.select("node_id", "hop"), "node_id", "left")  # one row
    target = X.any_of([X.matches_path(F.col("rel_path"), f) for f in folders]) if folders else F.lit(False)
    a, b = X.dirname(F.col("rel_path")), X.dirname(F.col("home"))
    near = F.when(a == b, 8).when(F.element_at(F.split(a, "/"), 1) == F.element_at(F.split(b, "/"), 1), 5).otherwise(0)
    size = F.length(F.coalesce("source_text", F.lit("")))
    score = F.when(target, 20).otherwise(0) + F.coalesce("rel", F.lit(0)) + kind + near + F.coalesce(-0.5 * F.col("hop"), F.lit(-5.0)) + F.when(size > 20_000, -2).when(size > 10_000, -1).otherwise(0)
    return rows.where(F.col("node_id") != topic).select("node_id", score.cast("double").alias("score"))


# --- Pages and links ------------------------------------------------------------------------------------------------
def cocited(links: DataFrame) -> DataFrame:
    """(page, class_id, n_targets, n_shared): one row a page that shares a link target with another.

    Pages with the same targets are one class, named by its smallest page; n_shared counts, over the page's targets, the
    other pages that have it. `links` has source and target, one row a pair; it is the membership the counts stand for.
    """
    n = links.groupBy("target").agg((F.count(F.lit(1)) - 1).alias("others"))
    pages = links.join(n, "target").groupBy("source").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("others").alias("n_shared"), F.array_join(F.sort_array(F.collect_set("target")), "\n").alias("targets")).where("n_shared > 0")
    first = pages.groupBy("targets").agg(F.min("source").alias("class_id"))
    return pages.join(first, "targets").select(F.col("source").alias("page"), "class_id", "n_targets", "n_shared")


def rerank_pages(hits: DataFrame, links: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(page, score): base * (1 + centrality + density) * relevance.

    Centrality is the share of pages that link to a page, density the share of its link targets among the hits,
    relevance the share of pages hit. `hits` has page and base, `links` source and target, `n_pages` one row n.
    """
    back = links.select("source", "target").distinct().groupBy(F.col("target").alias("page")).agg(F.count(F.lit(1)).alias("back"))
    hit = hits.select(F.col("page").alias("target"), F.lit(1).alias("hit"))
    out = links.select("source", "target").distinct().join(hit, "target", "left").groupBy(F.col("source").alias("page")).agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("density"))
    total = hits.agg(F.count(F.lit(1)).alias("h")).crossJoin(n_pages)
    rows = hits.join(back, "page", "left").join(out, "page", "left").crossJoin(F.broadcast(total))  # one row
    score = F.col("base") * (1 + F.coalesce("back", F.lit(0)) / F.col("n") + F.coalesce("density", F.lit(0.0))) * F.col("h") / F.col("n")
    return rows.select("page", score.alias("score"))

