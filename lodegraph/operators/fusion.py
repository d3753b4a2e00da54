"""Ranked lists: reciprocal-rank fusion, budgets, diversification and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, key: str, score: str, ascending: bool = False) -> DataFrame:
    """(key, rank) with ranks from 1; ties by key. The list is a top-k result, so one window partition is small."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return rows.select(key, F.row_number().over(Window.orderBy(order, key)).alias("rank"))


def rrf(lists: list[DataFrame], key: str, weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Sum of weight / (k + rank) over lists of (key, rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select(key, (F.lit(w) / (k + F.col("rank"))).alias("s")) for x, w in zip(lists, weights)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.sum("s").alias("score"))


def fuse_documents(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Named lists of (symbol_name, doc, rank) fused by lower(symbol_name); the better-ranked payload stays.

    Gives name, score, best rank, payload and the lists that held it.
    """
    union = None
    for name, df in lists.items():
        part = df.select(F.lower("symbol_name").alias("name"), "doc", "rank", F.lit(name).alias("list"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("name").agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"),
        F.min(F.struct("rank", "list", "doc")).alias("p"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
    ).select("name", "score", "best_rank", F.col("p.doc").alias("doc"), "lists")


def within_budget(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """Greedy choice under a token budget in rank order: a document that doesn't fit is passed over, later ones may fit.

    `rows` has group, rank, id, tokens. Inherently ordered, so it runs per group; a group is one answer's candidates.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for t in (pdf := pdf.sort_values(["rank", "id"]))["tokens"]:
            keep.append(t <= left)
            left -= t if t <= left else 0
        return pdf[keep][[group, "id", "rank", "tokens"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, id {kinds['id']}, rank {kinds['rank']}, tokens {kinds['tokens']}")


#: Budgets of the three tiers and the share of a document's tokens that each tier shows.
TIERS = ((50_000, 1.0), (30_000, 0.35), (10_000, 0.10))


def tiered_budget(rows: DataFrame, group: str) -> DataFrame:
    """Documents in score order into three tiers of shrinking detail; the first tier with room takes a document, else it is skipped."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = [b for b, _ in TIERS], []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            for tier, (_, share) in enumerate(TIERS):
                cost = int(r.tokens * share)
                if cost <= left[tier]:
                    left[tier] -= cost
                    out.append((getattr(r, group), r.id, tier + 1, cost))
                    break
        return pd.DataFrame(out, columns=[group, "id", "tier", "shown_tokens"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, id {kinds['id']}, tier int, shown_tokens bigint")


def round_robin(rows: DataFrame, source: str, key: str, score: str, k: int) -> DataFrame:
    """Diversified order: the best of each source in turn, one row a key (the best), cut at k."""
    one = Window.partitionBy(key).orderBy(F.desc(score), source)
    turn = Window.partitionBy(source).orderBy(F.desc(score), key)
    kept = rows.withColumn("_one", F.row_number().over(one)).where("_one = 1").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k)
    return kept.orderBy("turn", F.desc(score), source, key).limit(k).select(source, key, score, "turn")


def merge_repositories(rows: DataFrame, key: str, score: str, degree: str) -> DataFrame:
    """Union of per-repository results with one row a key: the first repository in order of wiki_id wins."""
    first = Window.partitionBy(key).orderBy("wiki_id")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn").orderBy(F.desc(score), F.desc(degree), key)
