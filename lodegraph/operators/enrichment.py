"""Composed passes: orphan cascade, component bridging, symbol resolution, API surfaces, citations, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import markdown as M
from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.operators.traverse import components


def orphan_cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, stage): every orphan linked by the first pass that finds it a target.

    Explicit references, then shared rare name words by tier, then the nearest folder. Each stage sees only what the
    ones before left over.
    """
    lone = G.orphans(nodes, edges).select("node_id")
    text = nodes.join(lone, "node_id", "left_semi").where("source_text is not null").select(F.col("node_id").alias("doc_key"), F.col("source_text").alias("text"))
    explicit = L.backtick_links(text, nodes).where("doc_key <> target_id").select(F.col("doc_key").alias("source_id"), "target_id", F.lit("explicit").alias("stage")).distinct()
    left = lone.join(explicit.select(F.col("source_id").alias("node_id")), "node_id", "left_anti")
    lexical = L.lexical_tiers(nodes, left).select("source_id", "target_id", F.concat(F.lit("lexical_t"), F.col("tier").cast("string")).alias("stage"))
    done = explicit.select("source_id").unionByName(lexical.select("source_id"))
    folder = L.directory_anchors(nodes, edges).select("source_id", "target_id", F.lit("directory").alias("stage")).join(done, "source_id", "left_anti")
    return explicit.unionByName(lexical).unionByName(folder)


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id): one edge from the best connected node of each lesser component to that of the largest one of its repository."""
    comp = components(nodes, edges)
    deg = G.with_degree(nodes, edges).select("node_id", "wiki_id", "degree").join(comp, "node_id")
    lead = deg.groupBy("wiki_id", "component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("degree")).alias("d"), "node_id")).alias("b"))
    main = lead.groupBy("wiki_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "component", F.col("b.node_id").alias("node_id"))).alias("m"))
    return lead.join(main, "wiki_id").where("component <> m.component").select(F.col("b.node_id").alias("source_id"), F.col("m.node_id").alias("target_id"), "wiki_id")


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, kind, node_id, priority): the keys by which a symbol may be meant, most exact first: id, path::name, name, last part of the id."""
    prio = X.type_priority(F.col("symbol_type"))
    ways = (("id", F.col("node_id")), ("qualified", F.concat_ws("::", "rel_path", "symbol_name")), ("name", F.col("symbol_name")), ("suffix", F.regexp_extract("node_id", r"([^.:]+)$", 1)))
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), key.alias("key")) for i, (kind, key) in enumerate(ways, 1)])
    return nodes.select("node_id", prio.alias("priority"), F.explode(keys).alias("k")).select("k.key", "k.kind", "k.rank", "node_id", "priority").where("key <> ''")


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, node_id, kind): each wanted key resolved by the most exact kind that knows it, then type priority, then id."""
    rows = name_index(nodes).join(wanted.select("key").distinct(), "key")
    return rows.groupBy("key").agg(F.min(F.struct("rank", (-F.col("priority")).alias("p"), "node_id", "kind")).alias("b")).select("key", "b.node_id", "b.kind")


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, target_id, resolved, kind): edges whose target is no node id, with the symbol that its name resolves to."""
    open_ = edges.join(nodes.select(F.col("node_id").alias("target_id")), "target_id", "left_anti").where("target_id <> ''")
    found = resolve(nodes, open_.select(F.col("target_id").alias("key")))
    return open_.join(found, open_.target_id == found.key).select("id", "target_id", F.col("node_id").alias("resolved"), "kind")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: nodes, orphans, components, the largest component and its share."""
    comp = components(nodes, edges).join(nodes.select("node_id", "wiki_id"), "node_id")
    size = comp.groupBy("wiki_id", "component").agg(F.count(F.lit(1)).alias("n"))
    lone = G.orphans(nodes, edges).groupBy("wiki_id").agg(F.count(F.lit(1)).alias("n_orphans"))
    per = size.groupBy("wiki_id").agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"))
    return per.join(lone, "wiki_id", "left").select("wiki_id", "n_nodes", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), "n_components", "largest", F.round(F.col("largest") / F.col("n_nodes"), 6).alias("largest_share"))


def hybrid_orphans(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, threshold: float = 0.02, top: int = 20) -> DataFrame:
    """(source_id, target_id, score): orphans linked by shared rare name words and by vectors, ranks fused (k = 60).

    A link needs `threshold`, so at least a good place in both lists; of the `top` of each list the best one is taken.
    """
    from pyspark.sql import Window

    from lodegraph.operators.vectors import batch_nearest

    lone = G.orphans(nodes, edges).select("node_id")
    order = Window.partitionBy("source_id")
    lexical = L.lexical_tiers(nodes, lone, top).select("source_id", "target_id", F.row_number().over(order.orderBy("tier", "target_id")).alias("rank"))
    usable = vectors.where("embedding is not null").groupBy("node_id").agg(F.max("embedding").alias("embedding"))
    near = batch_nearest(usable, usable.join(lone, "node_id", "left_semi"), "node_id", top).select(F.col("query").alias("source_id"), F.col("node_id").alias("target_id"), F.col("position").alias("rank"))
    fused = lexical.unionByName(near).groupBy("source_id", "target_id").agg(F.sum(1 / (60 + F.col("rank"))).alias("score")).where(F.col("score") >= threshold)
    return fused.withColumn("rn", F.row_number().over(order.orderBy(F.desc("score"), "target_id"))).where("rn = 1").drop("rn")


def coverage_gaps(nodes: DataFrame, edges: DataFrame, covered: DataFrame, top: int = 20) -> DataFrame:
    """The first `top` architectural symbols that nothing covers, by type priority, degree, id."""
    rest = nodes.where("is_architectural and not is_doc").join(covered.select("node_id").distinct(), "node_id", "left_anti")
    deg = G.with_degree(rest, edges).withColumn("priority", X.type_priority(F.col("symbol_type")))
    return deg.select("node_id", "symbol_type", "priority", "degree").orderBy(F.desc("priority"), F.desc("degree"), "node_id").limit(top)


# --- API surfaces beyond routes and names ---------------------------------------------------------------------------
#: What marks a surface of each kind, the group that names it, and its weight.
SURFACES = (
    ("grpc", r"(?m)\brpc\s+(\w+)\s*\(", 0.9),
    ("graphql", r"(?m)^\s*(?:type|extend type)\s+(Query|Mutation|Subscription)\b", 0.9),
    ("ffi", r"(?:extern\s+\"C\"|@ffi|ctypes\.CDLL|JNIEXPORT)[^\n]*?\b(\w+)\s*\(", 0.9),
    ("env", r"(?:os\.environ(?:\.get\(|\[)|os\.getenv\(|process\.env\.|System\.getenv\(|os\.Getenv\()[\"']?([A-Z][A-Z0-9_]+)", 0.4),
    ("http", r"[\"'`](/(?:[a-z0-9_-]+|\{[^}]*\}|:[a-z_]+)(?:/(?:[a-z0-9_-]+|\{[^}]*\}|:[a-z_]+))+)[\"'`]", 0.5),
    ("cli", r"add_(?:argument|option)\(\s*[\"'](--[a-z][\w-]*)", 0.4),
    ("log", r"\b(?:logger|log|LOG)\.(?:info|Printf)\([\"'](\w+)", 0.1),
)


def text_surfaces(nodes: DataFrame) -> DataFrame:
    """(node_id, kind, surface, weight_hint) of the surfaces that a symbol's text shows; one row a surface."""

    def found(kind: str, pattern: str, weight: float) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("source_text", F.lit(pattern), 1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("surface"), F.lit(weight).alias("weight_hint")))

    kinds = [found(*x) for x in SURFACES]
    rows = nodes.where("source_text is not null").select("node_id", "wiki_id", "language", "rel_path", F.explode(F.flatten(F.array(*kinds))).alias("s"))
    surface = F.when(F.col("s.kind") == "http", L.http_path(F.col("s.surface"))).otherwise(F.col("s.surface"))
    return rows.select("node_id", "wiki_id", "language", "rel_path", "s.kind", surface.alias("surface"), "s.weight_hint")


def object_shapes(nodes: DataFrame) -> DataFrame:
    """(node_id, surface): the sorted snake-cased field names of literal objects in a symbol's text, where there are two or more."""
    fields = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("source_text", F.lit(r"[{,]\s*[\"']?([A-Za-z_]\w*)[\"']?\s*:"), 1), X.snake_case)))
    return nodes.where("source_text is not null").select("node_id", fields.alias("f")).where(F.size("f") >= 2).select("node_id", F.concat(F.lit("obj:"), F.array_join("f", ",")).alias("surface"))


def without_verbless_twins(links: DataFrame) -> DataFrame:
    """REST links without those by path alone between nodes that both know a verb for the path.

    `links` has source_id, target_id, surface ('VERB /path' or '* /path').
    """
    path = F.regexp_extract("surface", r"^\S+ (.*)$", 1)
    verb = links.where(~F.col("surface").startswith("* ")).select("source_id", "target_id", path.alias("p"))
    knows = verb.select(F.explode(F.array("source_id", "target_id")).alias("n"), "p").distinct()
    rows = links.withColumn("p", path).withColumn("bare", F.col("surface").startswith("* "))
    a = knows.select(F.col("n").alias("source_id"), "p", F.lit(True).alias("ka"))
    b = knows.select(F.col("n").alias("target_id"), "p", F.lit(True).alias("kb"))
    return rows.join(a, ["source_id", "p"], "left").join(b, ["target_id", "p"], "left").where("not (bare and ka is not null and kb is not null)").select(*links.columns)


# --- Citations and page links ---------------------------------------------------------------------------------------
def citations(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, start_line, end_line): citations of the form [path:12-34] or (path:12), lines null where none are given."""
    found = F.regexp_extract_all(column, F.lit(r"[\[(]([\w./-]+\.\w+):(\d+)(?:-(\d+))?[\])]"), 0)
    rows = docs.select(key, F.explode(found).alias("c"))
    part = lambda g: F.regexp_extract("c", r"[\[(]([\w./-]+\.\w+):(\d+)(?:-(\d+))?", g)
    end = F.when(part(3) != "", part(3)).otherwise(part(2))
    return rows.select(key, part(1).alias("path"), part(2).cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def resolve_wikilinks(docs: DataFrame, key: str, column: str, pages: DataFrame, least: float = 0.3) -> DataFrame:
    """(key, target, page, status): wiki links matched to the page of the most alike slug, ambiguous or missing.

    `pages` has page and slug. Candidates share a slug bigram; equal slugs win, a lower score than `least` is missing.
    """
    links = docs.select(key, F.explode(F.array_distinct(M.wikilinks(F.col(column)))).alias("target")).withColumn("slug", X.slug(F.col("target")))
    wanted = links.select("slug").distinct()
    a = wanted.select("slug", F.explode(X.bigrams(F.col("slug"))).alias("g"))
    b = pages.select("page", F.col("slug").alias("ps"), F.explode(X.bigrams(F.col("slug"))).alias("g"))
    cand = a.join(b, "g").select("slug", "page", "ps").distinct().withColumn("score", X.slug_similarity(F.col("slug"), F.col("ps")))
    best = cand.where(F.col("score") >= least).groupBy("slug").agg(F.max("score").alias("top"))
    tied = cand.join(best, "slug").where("score = top").groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return links.join(tied, "slug", "left").select(key, "target", F.when(F.col("n") == 1, F.col("page")).alias("page"), status.alias("status"))


# --- Texts for limited contexts -------------------------------------------------------------------------------------
def middle_out(text: Column, most: int, mark: str = "\n...\n") -> Column:
    """A text within `most` characters: the first 60 % and the last 40 % of them around a mark."""
    head, tail = int(most * 0.6), most - int(most * 0.6)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -tail, tail)))


def signature_view(nodes: DataFrame) -> DataFrame:
    """(node_id, view): a symbol as its signature and the first line of its docstring."""
    return nodes.select("node_id", F.concat_ws("\n", F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.col("symbol_name")), F.when(F.coalesce("docstring", F.lit("")) != "", F.get(F.split("docstring", "\n"), F.lit(0)))).alias("view"))
