"""Exact vector search: distances, nearest neighbours of one query, top k of many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import parallelism


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is all zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, 1 - _dot(a, b) / norm)


def nearest(vectors: DataFrame, key: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows to one vector (TakeOrdered, no full sort); ties by key. Null vectors take no part."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = l2(F.col("embedding"), q) if metric == "l2" else cosine_distance(F.col("embedding"), q)
    return vectors.where("embedding is not null").select(key, distance.alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)


#: Queries that one task compares at a time.
QUERY_BLOCK = 4096


def batch_nearest(vectors: DataFrame, queries: DataFrame, key: str, k: int, below: float | None = None) -> DataFrame:
    """(query, key, distance, position): for each query vector its k nearest rows by cosine distance, itself left out; ties go by key.

    Both sides are cut into blocks by hash; a task compares a block of queries with a block of vectors and keeps the k
    best of each query, so few rows are shuffled afterwards. Nothing passes through the driver but the number of
    queries. All-zero and null vectors take no part; a key delivered twice counts once.
    """
    usable = vectors.where("embedding is not null").select(key, "embedding")
    asked = queries.where("embedding is not null").select(F.col(key).alias("query"), F.col("embedding").alias("vector"))
    kind = dict(vectors.dtypes)[key]
    rows, cols = max(1, -(-asked.count() // QUERY_BLOCK)), parallelism(vectors.sparkSession)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", block("query", rows)).withColumn("_v", every(cols))
    right = usable.withColumn("_v", block(key, cols)).withColumn("_q", every(rows))

    def unit(names: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.empty((0, 0))
        norm = np.linalg.norm(x, axis=1)
        return names.to_numpy()[norm > 0], x[norm > 0] / norm[norm > 0, None]

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        asked_ids, a = unit(q["query"], q["vector"])
        v = v.drop_duplicates(key).sort_values(key)
        ids, b = unit(v[key], v["embedding"])
        made: list[tuple] = []
        if len(asked_ids) and len(ids):
            dist = 1 - a @ b.T
            take = min(k + 1, len(ids))
            bound = np.partition(dist, take - 1, axis=1)[:, take - 1]
            for i, name in enumerate(asked_ids):
                near = np.flatnonzero(dist[i] <= bound[i])  # in the order of keys
                near = near[np.argsort(dist[i][near], kind="stable")][:take]
                made += [(name, ids[j], float(dist[i, j])) for j in near if ids[j] != name]
        out = pd.DataFrame(made, columns=["query", key, "distance"])
        return out if below is None else out[out["distance"] < below]

    pairs = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(compare, f"query {kind}, {key} {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", key)
    return pairs.dropDuplicates(["query", key]).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def cached_answers(answers: DataFrame, query: list[float], threshold: float, k: int = 5) -> DataFrame:
    """The k stored answers whose normalised vectors have an inner product of at least `threshold` with the query."""
    close = nearest(answers, "id", query, k, "cosine")
    return close.select("id", (1 - F.col("distance")).alias("similarity")).where(F.col("similarity") >= threshold)
