"""Pages and projects: reverse indexes, overlaps, slugs without collisions, splits of large files, repositories of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X
from lodegraph.operators import graph as G
from lodegraph.operators.fusion import within_budget


def upsert_page_symbols(stored: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """The page-symbol index after some pages were written: all rows of those pages replaced by the new ones, one row a (page_id, node_id, citation_kind).

    `pages` has the page_id of every page written, also of one that cites nothing any more.
    """
    kept = stored.join(pages.select("page_id").distinct(), "page_id", "left_anti")
    return kept.unionByName(new).dropDuplicates(["page_id", "node_id", "citation_kind"])


def overlapping_pages(members: DataFrame, share: float = 0.5) -> DataFrame:
    """(page_a, page_b, n_common): pages that share more than `share` of the smaller one's nodes. `members` has page_id and node_id.

    Pairs are made within the pages of a node only; sizes are counted beside.
    """
    rows = members.select("page_id", "node_id").distinct()
    size = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("size"))
    side = lambda s: rows.select("node_id", F.col("page_id").alias(s))
    common = side("page_a").join(side("page_b"), "node_id").where("page_a < page_b").groupBy("page_a", "page_b").agg(F.count(F.lit(1)).alias("n_common"))
    of = lambda s: size.select(F.col("page_id").alias(f"page_{s}"), F.col("size").alias(f"size_{s}"))
    return common.join(of("a"), "page_a").join(of("b"), "page_b").where(F.col("n_common") > share * F.least("size_a", "size_b")).select("page_a", "page_b", "n_common")


def unique_slugs(pages: DataFrame, within: str, key: str, title: str) -> DataFrame:
    """(within, key, slug): slugs of titles, repeated ones told apart by -2, -3 in the order of `key`; a title without letters is 'page'."""
    base = pages.select(within, key, X.slug(F.coalesce(title, F.lit(""))).alias("base")).withColumn("base", F.when(F.col("base") == "", "page").otherwise(F.col("base")))
    nth = F.row_number().over(Window.partitionBy(within, "base").orderBy(key))
    return base.select(within, key, F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", nth.cast("string"))).alias("slug"))


def normal_title(title: Column) -> Column:
    """Lower-case title without punctuation and repeated blanks, for comparison."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def resolve_relative(base: Column, link: Column) -> Column:
    """The path a link names, seen from the folder of `base`: '.' and '..' are walked; a link from the root begins with '/'. Leaving the root stays at it."""
    parts = F.split(F.when(link.startswith("/"), link).otherwise(F.concat_ws("/", X.dirname(base), link)), "/")
    drop = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", drop(a)).otherwise(F.concat(a, F.array(p))))
    return F.array_join(walked, "/")


def split_files(nodes: DataFrame, most: int = 30) -> DataFrame:
    """(wiki_id, rel_path, node_id, part): files with more than `most` symbols cut into parts: by the scope of their symbols where there are two or more, else by `start_line`, `most` a part.

    Symbols without parent make a scope of their own; parts are numbered from 0 in the order of scopes.
    """
    keys = ["wiki_id", "rel_path"]
    rows = nodes.where("symbol_type <> 'module' and rel_path is not null").select(*keys, "node_id", "start_line", F.coalesce("parent_symbol", F.lit("")).alias("scope"))
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scope").alias("scopes")).where(F.col("n") > most)
    per = Window.partitionBy(*keys)
    by_scope = F.dense_rank().over(per.orderBy("scope")) - 1
    by_line = F.floor((F.row_number().over(per.orderBy(F.asc_nulls_last("start_line"), "node_id")) - 1) / most)
    return rows.join(size, keys).select(*keys, "node_id", F.when(F.col("scopes") > 1, by_scope).otherwise(by_line).cast("long").alias("part"))


def project_repositories(edges: DataFrame, project_nodes: DataFrame) -> DataFrame:
    """(project_id, wiki_id, n_edges): the repositories that refer to a project's shared symbols."""
    shared = project_nodes.select("project_id", F.col("node_id").alias("target_id")).distinct()
    rows = edges.join(F.broadcast(shared) if _small(shared) else shared, "target_id")
    return rows.groupBy("project_id", "wiki_id").agg(F.count(F.lit(1)).alias("n_edges"))


#: Rows up to which a side is broadcast; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def match_summary(found: DataFrame, documents: DataFrame, by: str) -> DataFrame:
    """(by, n_matches, n_documents, relevance): how many documents of each group a search found, and their share. Groups without a match count too."""
    total = documents.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n_documents"))
    hits = found.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n_matches"))
    return total.join(hits, by, "left").select(by, F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "n_documents", F.round(F.coalesce("n_matches", F.lit(0)) / F.col("n_documents"), 6).alias("relevance"))


def scan_limits(counts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(scan, n_rows, cap, truncated): whether scans with a cap leave rows out, so that callers can be warned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("scan"), "n_rows", F.lit(cap).cast("long").alias("cap"), (F.col("n_rows") > cap).alias("truncated")) for name, (df, cap) in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_labels(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """(label, node_id, how, n_candidates): the node a label means: by symbol name (any case) before file path; of several the smallest id, and how many there were."""
    wanted = nodes.sparkSession.createDataFrame([(x, x.lower()) for x in dict.fromkeys(labels)], "label string, low string")  # the labels of one call
    some = nodes.where(F.lower("symbol_name").isin([x.lower() for x in labels]) | F.lower("rel_path").isin([x.lower() for x in labels]))
    ways = F.array(F.struct(F.lit(1).alias("rank"), F.lit("name").alias("how"), F.lower("symbol_name").alias("low")), F.struct(F.lit(2).alias("rank"), F.lit("path").alias("how"), F.lower("rel_path").alias("low")))
    keyed = some.select("node_id", F.explode(ways).alias("k")).select("node_id", "k.*")
    per = wanted.join(keyed, "low").groupBy("label", "rank", "how").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("node_id").alias("node_id"))
    return per.groupBy("label").agg(F.min(F.struct("rank", "how", "node_id", "n_candidates")).alias("b")).select("label", "b.node_id", "b.how", "b.n_candidates")


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair of nodes whichever way it runs: the surest, then the smallest id; for telling the steps of a path."""
    pair = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")]
    rows = edges.where("source_id <> target_id").select(*pair, (-G.X.confidence_rank(F.col("confidence"))).alias("doubt"), "id", "rel_type", "source_id")
    return rows.groupBy("a", "b").agg(F.min(F.struct("doubt", "id", "rel_type", "source_id")).alias("e")).select("a", "b", F.col("e.id").alias("edge_id"), "e.rel_type", (F.col("e.source_id") == F.col("a")).alias("forward"))


def expand_pages(members: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 8_000) -> DataFrame:
    """(page_id, id, rank, tokens): architectural neighbours of a page's nodes, strongest first, as many as fit the page's token budget.

    `members` has page_id, node_id and boundary (the cluster a page may reach into, null for none); nodes of the page
    itself, tests and nodes beyond the boundary are left out. Candidates of a page are ranked by summed edge weight,
    then id. Only the ranks and token counts of a page's candidates meet in one task, and not more of them than could
    fit: each costs a token at least.
    """
    own = members.select("page_id", "node_id", "boundary")
    ways = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("other")))).alias("x"), F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)").alias("w")).select("x.*", "w")
    reach = own.join(ways, "node_id").groupBy("page_id", "boundary", F.col("other").alias("id")).agg(F.sum("w").alias("w"))
    allowed = nodes.where("is_architectural and not is_test").select(F.col("node_id").alias("id"), "macro_cluster", F.greatest(F.lit(1), G.X.token_estimate(F.col("source_text"))).cast("long").alias("tokens"))
    rows = reach.join(allowed, "id").where("boundary is null or boundary = macro_cluster").join(own.select("page_id", F.col("node_id").alias("id")), ["page_id", "id"], "left_anti")
    order = Window.partitionBy("page_id").orderBy(F.desc("w"), "id")
    ranked = rows.where(F.col("tokens") <= budget).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("page_id", "id", "rank", "tokens")
    return within_budget(ranked, "page_id", budget)
