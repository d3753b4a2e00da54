"""Snapshots: what changed, which pages it touches, how each page is to be renewed, and lookups in the answer log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"moved": 1, "modified": 2, "added": 3, "deleted": 4}


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, kind) of every node that differs between two snapshots of (node_id, content_hash, rel_path).

    Only in `new`: added; only in `old`: deleted; other hash, or none recorded: modified; same hash under another
    path: moved (null paths count as ''). Unchanged nodes have no row. Ids must be unique in each snapshot.
    """
    o = old.select("node_id", F.col("content_hash").alias("old_hash"), F.coalesce("rel_path", F.lit("")).alias("old_path"), F.lit(True).alias("in_old"))
    n = new.select("node_id", F.col("content_hash").alias("new_hash"), F.coalesce("rel_path", F.lit("")).alias("new_path"), F.lit(True).alias("in_new"))
    kind = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "deleted")
        .when(F.col("old_hash").isNull() | ~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
        .when(F.col("old_path") != F.col("new_path"), "moved")
    )
    return o.join(n, "node_id", "full_outer").withColumn("kind", kind).where("kind is not null").select("node_id", "kind", "old_path", "new_path")


def affected_pages(changes: DataFrame, page_symbols: DataFrame) -> DataFrame:
    """(page_id, n_changes, worst): pages that cite a changed node, with the gravest kind of change."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    rows = page_symbols.select("page_id", "node_id").distinct().join(changes.select("node_id", "kind"), "node_id")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_changes"), F.max_by("kind", rank[F.col("kind")]).alias("worst"))


def regimes(changes: DataFrame, page_symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, regime) of affected pages: deleted, structural, edit or trivial.

    All cited nodes deleted: deleted. The page's primary node deleted, or any node added or deleted: structural. Only
    moved: trivial. Else edit. `pages` has page_id and primary_symbol_id.
    """
    cites = page_symbols.select("page_id", "node_id").distinct().join(changes.select("node_id", "kind"), "node_id", "left")
    gone = changes.where("kind = 'deleted'").select(F.col("node_id").alias("primary_symbol_id"), F.lit(True).alias("primary_gone"))
    is_kind = lambda *k: F.col("kind").isin(*k)
    per = cites.groupBy("page_id").agg(
        F.count("kind").alias("n"), F.min(F.coalesce(is_kind("deleted"), F.lit(False))).alias("all_gone"),
        F.max(F.coalesce(is_kind("added", "deleted"), F.lit(False))).alias("topology"), F.max(F.coalesce(is_kind("modified"), F.lit(False))).alias("modified"),
    ).where("n > 0")
    rows = per.join(pages.select("page_id", "primary_symbol_id"), "page_id", "left").join(gone, "primary_symbol_id", "left")
    regime = F.when(F.col("all_gone"), "deleted").when(F.coalesce("primary_gone", F.lit(False)) | F.col("topology"), "structural").when(F.col("modified"), "edit").otherwise("trivial")
    return rows.select("page_id", regime.alias("regime"), F.col("n").alias("n_changes"))


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes whose signature differs between two snapshots of (node_id, signature)."""
    rows = old.select("node_id", F.col("signature").alias("before")).join(new.select("node_id", F.col("signature").alias("after")), "node_id")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


# --- Answer log -----------------------------------------------------------------------------------------------------
REUSABLE = ("pending", "validated", "enriched")


def question_hash(question):
    return F.sha2(F.lower(F.trim(question)), 256)


def cached_answer(log: DataFrame, wiki_id: str, question: str, commit: str | None, since: str) -> DataFrame:
    """The newest reusable answer to a question: exact hash, status, no chat context, commit where known, not too old."""
    rows = log.where((F.col("wiki_id") == wiki_id) & (F.col("question_hash") == question_hash(F.lit(question))) & F.col("status").isin(*REUSABLE) & (F.col("has_context") == 0) & (F.col("created_at") > F.lit(since).cast("timestamp")))
    if commit:
        rows = rows.where(F.col("source_commit_hash") == commit)
    return rows.orderBy(F.desc("created_at"), "id").limit(1)


def answer_stats(log: DataFrame) -> DataFrame:
    """Per repository: answers, cache hits, validated, rejected, and the hit rate (0 without answers)."""
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    total = F.count(F.lit(1))
    hits = n(F.col("is_cache_hit") == 1)
    return log.groupBy("wiki_id").agg(total.alias("total"), hits.alias("cache_hits"), n(F.col("status") == "validated").alias("validated"), n(F.col("status") == "rejected").alias("rejected"), F.round(hits / total, 6).alias("hit_rate"))


def invalidate(log: DataFrame, commit: str) -> DataFrame:
    """Pending answers of other commits become stale; answers without a commit too."""
    stale = (F.col("status") == "pending") & ~F.col("source_commit_hash").eqNullSafe(F.lit(commit))
    return log.withColumn("status", F.when(stale, "stale").otherwise(F.col("status")))
