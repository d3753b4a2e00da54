"""A stored inverted index: postings in parquet, pruned by term, so a search reads the lists of its terms and no text.

Layout of a folder: `postings` is partitioned by a hash bucket of the term and sorted by term within files, so a search
opens the buckets of its terms and skips the row groups of others; `totals` has one row (documents, words). A posting
carries its document's length, so scoring needs no second table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import text as T

BUCKETS = 64


@dataclass
class Index:
    postings: DataFrame
    documents: int
    words: int
    key: str
    buckets: int


def write(docs: DataFrame, key: str, columns: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Build or rebuild the index of `docs` (one row a key) at `path`. One pass over the texts, one shuffle of postings."""
    length = reduce(lambda a, b: a + b, [F.size(T.tokens(F.col(c))) for c in columns])
    lists = T.postings(docs.withColumn("_dl", length), key, columns, keep=["_dl"])
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    rows = lists.select(key, "col", "term", "tf", "positions", F.col("_dl").alias("dl"), bucket.alias("bucket"))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(length), F.lit(0)).alias("words"), F.lit(key).alias("key"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def read(spark: SparkSession, path: str) -> Index:
    totals = spark.read.parquet(f"{path}/totals").first()
    return Index(spark.read.parquet(f"{path}/postings"), totals.documents, totals.words, totals.key, totals.buckets)


def _wanted(leaf) -> Column:
    return F.col("term").startswith(leaf.word) if isinstance(leaf, T.Prefix) else F.col("term") == leaf.word


def _pruned(index: Index, leaves: list) -> DataFrame:
    """Postings of the leaves' terms. The buckets of whole terms are named as numbers, so that other folders aren't listed; a prefix reads all."""
    rows = index.postings.where(reduce(lambda a, b: a | b, map(_wanted, leaves)))
    if any(isinstance(x, T.Prefix) for x in leaves):
        return rows
    terms = index.postings.sparkSession.createDataFrame([(x.word,) for x in leaves], "term string")  # the words of one query
    own = {r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int")).collect()}
    return rows.where(F.col("bucket").isin(sorted(own)))


def search(index: Index, weights: dict[str, float], query, require: bool = True) -> DataFrame:
    """(key, score): BM25 as `text.bm25` computes it over the same documents. Phrases and nearness are looked for within one column.

    With require=False one scored term is enough. A query without terms finds nothing.
    """
    leaves = T.leaves(query)
    if not leaves or not index.documents:
        return index.postings.select(index.key, F.lit(0.0).alias("score")).limit(0)
    weight = F.lit(0.0)
    for c, w in weights.items():
        weight = F.when(F.col("col") == c, float(w)).otherwise(weight)
    rows = _pruned(index, leaves).where(F.col("col").isin(*weights))
    tf = [F.sum(F.when(_wanted(x), weight * F.col("tf"))).alias(f"tf{i}") for i, x in enumerate(leaves)]
    at = [F.collect_list(F.when(_wanted(x), F.struct("col", "positions"))).alias(f"at{i}") for i, x in enumerate(leaves)]
    found = rows.groupBy(index.key).agg(F.max("dl").alias("dl"), *tf, *at).fillna(0.0, [f"tf{i}" for i in range(len(leaves))])
    counts = found.agg(*[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(leaves))])
    place = {x: i for i, x in enumerate(leaves)}
    fits = _holds(query, place) if require else F.lit(True)
    mean = index.words / index.documents if index.words else 1.0
    score = F.lit(0.0)
    for i in range(len(leaves)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log(1 + (F.lit(index.documents) - df + 0.5) / (df + 0.5)) * f * (T.K1 + 1) / (f + T.K1 * (1 - T.B + T.B * F.col("dl") / F.lit(mean)))
    return found.where(fits).crossJoin(F.broadcast(counts)).select(index.key, score.alias("score"))  # one row


def _positions(i: int, col: Column) -> Column:
    return F.flatten(F.transform(F.filter(F.col(f"at{i}"), lambda x: x["col"] == col), lambda x: x["positions"]))


def _holds(query, place: dict) -> Column:
    if isinstance(query, (T.Term, T.Prefix)):
        return F.col(f"tf{place[query]}") > 0
    if isinstance(query, T.Phrase):
        first, rest = place[T.Term(query.words[0])], [place[T.Term(w)] for w in query.words[1:]]
        cols = F.transform(F.col(f"at{first}"), lambda x: x["col"])

        def run(col: Column) -> Column:
            return F.exists(_positions(first, col), lambda p: reduce(lambda a, b: a & b, [F.array_contains(_positions(i, col), p + k) for k, i in enumerate(rest, 1)], F.lit(True)))

        return F.exists(cols, run)
    if isinstance(query, T.Near):
        a, b = place[T.Term(query.a)], place[T.Term(query.b)]
        cols = F.transform(F.col(f"at{a}"), lambda x: x["col"])
        return F.exists(cols, lambda col: F.exists(_positions(a, col), lambda p: F.exists(_positions(b, col), lambda q: (F.abs(p - q) <= query.within + 1) & (p != q))))
    if not query.parts:
        return F.lit(False)
    parts = [_holds(p, place) for p in query.parts]
    return reduce((lambda a, b: a & b) if isinstance(query, T.And) else (lambda a, b: a | b), parts)
