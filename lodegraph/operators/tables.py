"""Results of writes: upserts, merges, updates and deletions as new versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of `new`, and the rows of `old` whose key isn't in it. A key repeated in `new` keeps all its rows."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one of the largest `order`."""
    rank = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1").drop("_rn")


def merge_parallel(edges: DataFrame) -> DataFrame:
    """Edges alike in source, target and relation as one: weights summed (null as 1), other values of the smallest id."""
    return edges.groupBy("source_id", "target_id", "rel_type").agg(
        F.sum(F.coalesce("weight", F.lit(1.0)).cast("decimal(18,6)")).cast("double").alias("weight"),
        F.min(F.struct("id", "confidence", "edge_class")).alias("first"),
    ).select("source_id", "target_id", "rel_type", "weight", F.col("first.confidence").alias("confidence"), F.col("first.edge_class").alias("edge_class"), F.col("first.id").alias("first_id"))


def update_column(rows: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`column` replaced where `new` has a value for the key (one row a key)."""
    fresh = new.select(*keys, F.col(column).alias("_new"))
    return rows.join(fresh, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def reset_clusters(nodes: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return nodes.withColumns({"macro_cluster": none, "micro_cluster": none, "is_hub": F.lit(0)})


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end among `gone` (node_id)."""
    ids = gone.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")


def embedding_pending(nodes: DataFrame) -> DataFrame:
    """Nodes whose content changed since they were embedded; two nulls count as unchanged."""
    return nodes.where(~F.col("content_hash").eqNullSafe(F.col("embedding_content_hash")))


def embed(nodes: DataFrame, model, batch: int = 64) -> DataFrame:
    """(node_id, embedding) of pending nodes by a model that maps a list of texts to a list of vectors.

    The text is source_text, else docstring, else symbol_name; nodes without any are skipped.
    """
    import pandas as pd

    text = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("source_text", "docstring", "symbol_name")])
    rows = embedding_pending(nodes).select("node_id", text.alias("text")).where("text is not null")

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"node_id": part["node_id"], "embedding": [list(map(float, v)) for v in model(part["text"].tolist())]})

    return rows.mapInPandas(run, "node_id string, embedding array<float>")
