"""Passes that find edges: explicit references, folders, lexical tiers, tests, API surfaces, repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G


# --- Explicit references --------------------------------------------------------------------------------------------
def backtick_links(docs: DataFrame, nodes: DataFrame, most: int = 2) -> DataFrame:
    """Doc -> symbols named in backticks: the whole name, else the part after the last dot; at most `most` a name, by node id.

    `docs` has doc_key and text.
    """
    refs = docs.select("doc_key", F.explode(F.regexp_extract_all("text", F.lit(r"`([A-Za-z_][\w.]*)`"), 1)).alias("ref")).distinct()
    names = nodes.where("symbol_name <> ''").select(F.col("symbol_name").alias("name"), F.col("node_id").alias("target_id"))
    order = Window.partitionBy("name").orderBy("target_id")
    index = names.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")
    whole = refs.join(index, refs.ref == index.name).select("doc_key", "ref", "target_id", F.lit("exact").alias("how"))
    rest = refs.where(F.contains("ref", F.lit("."))).join(index.select("name").distinct(), F.col("ref") == F.col("name"), "left_anti")
    last = rest.withColumn("tail", F.regexp_extract("ref", r"([^.]+)$", 1)).join(index, F.col("tail") == F.col("name")).select("doc_key", "ref", "target_id", F.lit("last_part").alias("how"))
    return whole.unionByName(last)


def path_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Doc -> files named by a markdown link or in backticks, matched as the end of a path (two segments at least)."""
    link = F.regexp_extract_all("text", F.lit(r"\]\(([^)#\s]+\.\w+)"), 1)
    tick = F.regexp_extract_all("text", F.lit(r"`([\w.-]+(?:/[\w.-]+)+)`"), 1)
    refs = docs.select("doc_key", F.explode(F.array_distinct(F.concat(link, tick))).alias("ref")).withColumn("tail", F.regexp_replace("ref", r"^(\.\.?/)+", ""))
    parts = F.split("rel_path", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    files = nodes.where("symbol_type = 'module'").where(F.size(parts) >= 2).select("node_id", F.explode(suffixes).alias("tail"))
    return refs.join(files, "tail").select("doc_key", "ref", F.col("node_id").alias("target_id")).distinct()


def proximity_links(nodes: DataFrame, most: int = 5) -> DataFrame:
    """Doc -> code in folders whose path ends like the doc's folder without its docs/ prefix; `most` a folder, by node id.

    The suffix match is an equality on exploded folder ends, not a comparison of all folders.
    """
    d = X.dirname(F.col("rel_path"))
    docs = nodes.where("is_doc").select("wiki_id", F.col("node_id").alias("source_id"), F.regexp_replace(d, "^(docs|doc|documentation)(/|$)", "").alias("topic")).where("topic <> ''")
    parts = F.split("dir", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    code = nodes.where("not is_doc").select("wiki_id", F.col("node_id").alias("target_id"), d.alias("dir")).where("dir <> ''")
    few = code.withColumn("rn", F.row_number().over(Window.partitionBy("wiki_id", "dir").orderBy("target_id"))).where(F.col("rn") <= most)
    return docs.join(few.select("wiki_id", "target_id", F.explode(ends).alias("topic")), ["wiki_id", "topic"]).select("source_id", "target_id").distinct()


def directory_anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphan -> the best connected node in the nearest folder above it that has one; ties by node id."""
    deg = G.with_degree(nodes, edges)
    linked = deg.where("degree > 0").select("wiki_id", X.dirname(F.col("rel_path")).alias("dir"), "node_id", "degree")
    best = linked.groupBy("wiki_id", "dir").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node_id")).alias("b")).select("wiki_id", "dir", F.col("b.node_id").alias("target_id"))
    lone = deg.where("degree = 0 and rel_path <> ''").select("wiki_id", F.col("node_id").alias("source_id"), F.posexplode(F.array_union(X.ancestor_dirs(F.col("rel_path")), F.array(F.lit("")))).alias("up", "dir"))
    return lone.join(best, ["wiki_id", "dir"]).groupBy("source_id").agg(F.min(F.struct("up", "target_id", "dir")).alias("r")).select("source_id", "r.target_id", "r.dir", F.col("r.up").alias("levels_up"))


# --- Lexical tiers --------------------------------------------------------------------------------------------------
#: Inverse document frequency from which a name may search everywhere, or at least nearby; length for the global tier.
IDF_HIGH, IDF_LOW, GLOBAL_LENGTH = 3.0, 1.5, 8


def lexical_tiers(nodes: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """Seeds linked to symbols that share their rarest name word, by the nearest tier that has any.

    T1 same folder (architectural), T2 parent folder or below, T3 anywhere in the repository (architectural), T4
    anywhere. Words below IDF_LOW find nothing, below IDF_HIGH only T1 and T2; T4 needs a long name. One scan, one join.
    """
    n = nodes.count()
    words = nodes.select("wiki_id", "node_id", F.explode(F.array_distinct(X.name_tokens(F.coalesce("symbol_name", F.lit(""))))).alias("word")).where(F.length("word") >= 4)
    idf = words.groupBy("word").agg(F.log(F.lit(float(n)) / (1 + F.count(F.lit(1)))).alias("idf")).where(F.col("idf") >= IDF_LOW)
    best = words.join(seeds.select("node_id"), "node_id", "left_semi").join(idf, "word").groupBy("wiki_id", "node_id").agg(F.max(F.struct("idf", "word")).alias("b"))
    src = best.select("wiki_id", F.col("node_id").alias("source_id"), "b.word", "b.idf").join(nodes.select(F.col("node_id").alias("source_id"), "symbol_name", X.dirname(F.col("rel_path")).alias("here")), "source_id")
    tgt = words.join(idf.select("word"), "word").join(nodes.select("node_id", "is_architectural", X.dirname(F.col("rel_path")).alias("there")), "node_id").select("wiki_id", "word", F.col("node_id").alias("target_id"), "is_architectural", "there")
    parent = X.dirname(F.col("here"))
    tier = (
        F.when((F.col("there") == F.col("here")) & F.col("is_architectural"), 1)
        .when((parent != "") & ((F.col("there") == parent) | F.col("there").startswith(F.concat(parent, F.lit("/")))), 2)
        .when(F.col("is_architectural") & (F.col("idf") >= IDF_HIGH), 3)
        .when((F.col("idf") >= IDF_HIGH) & (F.length("symbol_name") >= GLOBAL_LENGTH), 4)
    )
    hits = src.join(tgt, ["wiki_id", "word"]).where("source_id <> target_id").withColumn("tier", tier).where("tier is not null")
    order = Window.partitionBy("source_id").orderBy("tier", "target_id")
    ranked = hits.withColumn("first", F.min("tier").over(Window.partitionBy("source_id"))).where("tier = first").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return ranked.select("source_id", "target_id", "tier", "word")


# --- Tests ----------------------------------------------------------------------------------------------------------
def _is_test(nodes: DataFrame):
    return F.col("is_test") | F.lower("file_name").rlike(r"^tests?[_.\-]|[_.\-](tests?|spec)$")


def same_stem_tests(nodes: DataFrame) -> DataFrame:
    """Test file -> the file it is named after, in the same language. Files only, so no product of their symbols."""
    files = nodes.where(F.col("symbol_type").isin("module", "module_doc", "file_doc") & (F.coalesce("file_name", F.lit("")) != "")).withColumn("t", _is_test(nodes))
    tests = files.where("t").select("wiki_id", F.col("node_id").alias("source_id"), X.strip_test_stem(F.col("file_name")).alias("stem"), "language")
    code = files.where("not t").select("wiki_id", F.col("node_id").alias("target_id"), F.lower("file_name").alias("stem"), "language")
    return tests.join(code, ["wiki_id", "stem", "language"]).where("source_id <> target_id").select("source_id", "target_id", F.lit("test_link_same_stem").alias("rel_type"), F.lit(0.5).alias("weight"))


def class_proxy_tests(nodes: DataFrame) -> DataFrame:
    """Test class -> the class it is named after, in the same language."""
    named = F.col("symbol_name").rlike("^Test|Tests?$")
    classes = nodes.where("symbol_type = 'class' and symbol_name <> ''").withColumn("t", F.col("is_test") & named)
    tests = classes.where("t").select("wiki_id", F.col("node_id").alias("source_id"), X.strip_test_class(F.col("symbol_name")).alias("base"), "language")
    code = classes.where("not t").select("wiki_id", F.col("node_id").alias("target_id"), F.col("symbol_name").alias("base"), "language")
    return tests.join(code, ["wiki_id", "base", "language"]).where("source_id <> target_id").select("source_id", "target_id", F.lit("test_link_class_proxy").alias("rel_type"), F.lit(0.5).alias("weight"))


def test_links(nodes: DataFrame) -> DataFrame:
    return same_stem_tests(nodes).unionByName(class_proxy_tests(nodes)).dropDuplicates(["source_id", "target_id", "rel_type"])


# --- API surfaces and languages -------------------------------------------------------------------------------------
def name_surfaces(nodes: DataFrame) -> DataFrame:
    """(node_id, kind, surface, weight_hint): every architectural symbol offers its snake-cased name."""
    return nodes.where("is_architectural and symbol_name <> ''").select("node_id", "wiki_id", "language", "rel_path", F.lit("name").alias("kind"), X.snake_case(F.col("symbol_name")).alias("surface"), F.lit(0.3).alias("weight_hint")).where("surface <> ''")


_ROUTE = r"""(?i)(?:@\w+(?:\.\w+)*\.(get|post|put|patch|delete)|\b(?:app|router|r|mux|server)\.(get|post|put|patch|delete)|@(Get|Post|Put|Patch|Delete)Mapping)\s*\(\s*(?:value\s*=\s*)?["'`](/[^"'`\s]*)"""


def rest_surfaces(nodes: DataFrame) -> DataFrame:
    """REST routes that a symbol's text registers: 'VERB /path', parameters as {}, and without /api/vN as an alternate."""
    hit = lambda g: F.regexp_extract_all("source_text", F.lit(_ROUTE), g)
    rows = nodes.where(F.col("source_text").rlike(_ROUTE)).select("node_id", "wiki_id", "language", "rel_path", F.explode(F.arrays_zip(hit(1).alias("a"), hit(2).alias("b"), hit(3).alias("c"), hit(4).alias("p"))).alias("x"))
    verb = F.upper(F.concat(F.coalesce("x.a", F.lit("")), F.coalesce("x.b", F.lit("")), F.coalesce("x.c", F.lit(""))))
    path = http_path(F.col("x.p"))
    both = F.array_distinct(F.array(path, F.regexp_replace(path, "^/api(/v[0-9]+)?(?=/)", "")))
    return rows.select("node_id", "wiki_id", "language", "rel_path", F.lit("rest").alias("kind"), verb.alias("verb"), F.explode(both).alias("path"), F.lit(0.8).alias("weight_hint")).select("node_id", "wiki_id", "language", "rel_path", "kind", F.concat_ws(" ", "verb", "path").alias("surface"), "weight_hint")


def http_path(path):
    """Lower case, parameters as {}, no query and no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), r"\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*", "{}")
    cut = F.regexp_replace(F.lower(bare), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


#: Rows of a group that one task pairs with the whole group.
BLOCK = 1000


def group_pairs(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """`left` joined to `right` on `keys`. `sizes` has the keys and n, the rows of a group; only groups it has are joined.

    The left rows of a group are spread over blocks of about BLOCK rows and the right ones copied to each block, so the
    pairs of a large group are made by many tasks.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = left.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64(*left.columns), blocks).cast("int"))
    copies = right.join(sizes, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    return spread.join(copies, [*keys, "_block"]).drop("_block")


_SURFACE = ["kind", "surface"]


def surface_links(surfaces: DataFrame, other_language: bool = True) -> DataFrame:
    """Links between nodes of the same surface, one row a pair of language classes of a surface.

    A class is all nodes of a surface in one language; (source_id, target_id) are its smallest ids, n_links says how many
    pairs of nodes the row stands for, and `surface_members` lists the nodes. weight is that of the strongest of them:
    clamp(0.7 * hint * locality / ln(1 + nodes of the surface)). With other_language=False a class is also linked with
    itself (source and target are then its smallest and largest id). No pairs of nodes are made: a surface has as many
    rows as pairs of languages, and the nodes of a hot surface are only counted.
    """
    per = surfaces.groupBy(*_SURFACE, "language").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("rel_path") != "", 1)).alias("placed"), F.min("node_id").alias("first"), F.max("node_id").alias("last"), F.max("weight_hint").alias("hint")
    )
    whole = per.groupBy(*_SURFACE).agg(F.sum("n").alias("nodes"), F.collect_list(F.struct("language", "n", "placed", "first", "last", "hint")).alias("classes")).where("nodes > 1")
    below = lambda a, b: F.col(a) < F.col(b) if other_language else F.col(a) <= F.col(b)
    pairs = whole.withColumn("a", F.explode("classes")).withColumn("b", F.explode("classes")).where(below("a.language", "b.language"))
    # Top folders that two classes share, or two nodes of one class.
    top = surfaces.where("rel_path <> ''").groupBy(*_SURFACE, F.element_at(F.split("rel_path", "/"), 1).alias("top"), "language").agg(F.count(F.lit(1)).alias("n"))
    tops = top.groupBy(*_SURFACE, "top").agg(F.collect_list(F.struct("language", "n")).alias("classes"))
    near = tops.withColumn("a", F.explode("classes")).withColumn("b", F.explode("classes")).where(below("a.language", "b.language") & ((F.col("a.language") != F.col("b.language")) | (F.col("a.n") > 1)))
    near = near.select(*_SURFACE, F.col("a.language").alias("language_a"), F.col("b.language").alias("language_b"), F.lit(True).alias("near")).distinct()
    same = F.col("a.language") == F.col("b.language")
    rows = pairs.select(
        *_SURFACE, "nodes", F.col("a.language").alias("language_a"), F.col("b.language").alias("language_b"), F.col("a.first").alias("source_id"), F.when(same, F.col("b.last")).otherwise(F.col("b.first")).alias("target_id"),
        F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n")).cast("long").alias("n_links"),
        F.when(same, F.col("a.placed") > 1).otherwise((F.col("a.placed") > 0) & (F.col("b.placed") > 0)).alias("both_placed"), ((F.col("a.hint") + F.col("b.hint")) / 2).alias("hint"),
    ).where("n_links > 0").join(near, [*_SURFACE, "language_a", "language_b"], "left")
    locality = F.when(F.col("near"), 1.0).when(F.col("both_placed"), 0.7).otherwise(0.5)
    return rows.select(*_SURFACE, "language_a", "language_b", "source_id", "target_id", "n_links", _link_weight(F.col("hint"), locality, F.col("nodes")).alias("weight"))


def _link_weight(hint, locality, nodes):
    return F.least(F.lit(0.8), F.greatest(F.lit(0.3), 0.7 * hint * locality / F.log(1.0 + nodes)))


def surface_members(surfaces: DataFrame) -> DataFrame:
    """One row a node and surface: its class (kind, surface, language), and how many nodes of other languages and of other repositories it is linked with."""
    keys = [*_SURFACE, "language", "wiki_id"]
    n = surfaces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*_SURFACE).agg(F.sum("n").alias("n"))
    by = lambda c: n.groupBy(*_SURFACE, c).agg(F.sum("n").alias("own"))
    many = total.where("n > 1")
    rows = surfaces.join(many, _SURFACE).join(by("language").withColumnRenamed("own", "same_language"), [*_SURFACE, "language"]).join(by("wiki_id").withColumnRenamed("own", "same_repository"), [*_SURFACE, "wiki_id"])
    return rows.select("node_id", *_SURFACE, "language", "wiki_id", (F.col("n") - F.col("same_language")).alias("n_other_language"), (F.col("n") - F.col("same_repository")).alias("n_other_repository"))


def member_surfaces(nodes: DataFrame) -> DataFrame:
    """(node_id, kind, surface, weight_hint): members by their parent's snake-cased name and their own, so that members of like parents meet."""
    name = F.concat_ws(".", X.snake_case(F.element_at(F.split("parent_symbol", r"[.:]+"), -1)), X.snake_case(F.col("symbol_name")))
    return nodes.where("parent_symbol <> '' and symbol_name <> ''").select("node_id", "wiki_id", "language", "rel_path", F.lit("member").alias("kind"), name.alias("surface"), F.lit(0.3).alias("weight_hint")).where("surface not like '.%' and surface not like '%.'")


def shared_surfaces(surfaces: DataFrame) -> DataFrame:
    """One row a surface: how many nodes, languages and repositories share it, and its specificity 1 / ln(1 + n)."""
    return surfaces.groupBy("kind", "surface").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("language").alias("n_languages"), F.count_distinct("wiki_id").alias("n_repositories")).withColumn("specificity", 1 / F.log(1.0 + F.col("n_nodes")))


# --- Repositories ---------------------------------------------------------------------------------------------------
def repository_features(nodes: DataFrame, top: int = 200) -> DataFrame:
    """Per repository: sets of languages, of folders as stand-in for dependencies, of api surfaces, and its most frequent names."""
    names = nodes.where("symbol_name <> ''").groupBy("wiki_id", "symbol_name").agg(F.count(F.lit(1)).alias("n"))
    ranked = names.withColumn("rn", F.row_number().over(Window.partitionBy("wiki_id").orderBy(F.desc("n"), "symbol_name"))).where(F.col("rn") <= top)
    lead = ranked.groupBy("wiki_id").agg(F.collect_list("symbol_name").alias("names"))
    sets = nodes.groupBy("wiki_id").agg(
        F.collect_set(F.when(F.col("language") != "", F.col("language"))).alias("languages"),
        F.collect_set(X.path_prefix(F.col("rel_path"), 2)).alias("deps"),
        F.collect_set(F.when(F.col("symbol_type") == "struct", X.snake_case(F.col("symbol_name")))).alias("apis"),
    )
    return sets.join(lead, "wiki_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def relatedness(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of repository pairs: 0.30 languages + 0.20 deps + 0.30 api overlap + 0.20 names; 0 without a common language or api.

    `pairs` has wiki_a and wiki_b; only the pairs asked for are scored.
    """
    side = lambda s: features.select(*[F.col(c).alias(f"{c}_{s}") for c in ("wiki_id", "languages", "deps", "apis", "names")])
    rows = pairs.join(side("a"), F.col("wiki_a") == F.col("wiki_id_a")).join(side("b"), F.col("wiki_b") == F.col("wiki_id_b"))
    lang, dep, naming = (X.jaccard(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in ("languages", "deps", "names"))
    common = F.size(F.array_intersect("apis_a", "apis_b"))
    small = F.least(F.size("apis_a"), F.size("apis_b"))
    api = F.when(small > 0, common / small).otherwise(0.0)
    overlap = (F.size(F.array_intersect("languages_a", "languages_b")) > 0) | (common > 0)
    score = F.when(overlap, F.least(F.lit(1.0), 0.30 * lang + 0.20 * dep + 0.30 * api + 0.20 * naming)).otherwise(0.0)
    return rows.select("wiki_a", "wiki_b", F.round(score, 6).alias("score"), F.round(lang, 6).alias("lang"), F.round(dep, 6).alias("dep"), F.round(api, 6).alias("api"), F.round(naming, 6).alias("naming"))


def repository_pairs(features: DataFrame) -> DataFrame:
    """Every repository pair (wiki_a < wiki_b) of the federation: as many rows as the scores asked for."""
    ids = features.select("wiki_id")
    return ids.select(F.col("wiki_id").alias("wiki_a")).join(F.broadcast(ids.select(F.col("wiki_id").alias("wiki_b"))), F.col("wiki_a") < F.col("wiki_b"))


def repository_links(surfaces: DataFrame) -> DataFrame:
    """(wiki_a, wiki_b, n_surfaces, n_links, weight): repositories whose nodes share surfaces, wiki_a < wiki_b.

    The nodes of a surface in one repository are one class; n_links counts the pairs of nodes, weight is that of the
    strongest. Classes of a surface that many repositories share are paired in blocks, and summed where they are made.
    """
    top = F.when(F.col("rel_path") != "", F.element_at(F.split("rel_path", "/"), 1))
    per = surfaces.where("wiki_id is not null").groupBy(*_SURFACE, "wiki_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(top).alias("tops"), F.max("weight_hint").alias("hint"))
    sizes = per.groupBy(*_SURFACE).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("nodes")).where("n > 1")
    side = lambda s: per.select(*_SURFACE, *[F.col(c).alias(f"{c}_{s}") for c in ("wiki_id", "n", "tops", "hint")])
    pairs = group_pairs(side("a"), side("b"), _SURFACE, sizes.drop("nodes")).where("wiki_id_a < wiki_id_b").join(sizes.select(*_SURFACE, "nodes"), _SURFACE)
    locality = F.when(F.arrays_overlap("tops_a", "tops_b"), 1.0).when((F.size("tops_a") > 0) & (F.size("tops_b") > 0), 0.7).otherwise(0.5)
    return pairs.groupBy(F.col("wiki_id_a").alias("wiki_a"), F.col("wiki_id_b").alias("wiki_b")).agg(
        F.count(F.lit(1)).alias("n_surfaces"), F.sum(F.col("n_a") * F.col("n_b")).alias("n_links"), F.max(_link_weight((F.col("hint_a") + F.col("hint_b")) / 2, locality, F.col("nodes"))).alias("weight")
    )


def cross_repository(links: DataFrame, scores: DataFrame, least: float = 0.15, damping: float = 0.7) -> DataFrame:
    """Links between repositories related enough, one row a pair of repositories; the strongest weighs clamp01(weight * damping * score).

    The nodes are those of `surface_members`: two are linked if they share a surface and their repositories are in a row.
    """
    rows = links.join(scores.select("wiki_a", "wiki_b", "score"), ["wiki_a", "wiki_b"]).where(F.col("score") >= least)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight") * damping * F.col("score")))
    return rows.select("wiki_a", "wiki_b", "n_surfaces", "n_links", F.round(weight, 6).alias("weight"), F.lit("cross_repo").alias("edge_class"))
