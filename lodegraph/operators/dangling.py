"""References to records that do not exist, are not there yet, or are gone.

Keys are range-partitioned on their 64-bit hash, so ranges are even without sampling. Each range holds its parents as
one sorted array of key bytes (with their first sighting and their added / deleted history) and probes its batch of
references against it by vectorised binary search. A key that many references name is spread over several ranges, and
its parents are copied to exactly those ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import parallelism

#: References that one range should hold: what one Python worker probes at once.
RANGE_ROWS = 150_000
NODE, PROJECT, ADDED, DELETED = 0, 1, 2, 3
REASONS = ("missing", "not_yet_indexed", "deleted")
_OUT = "edge_id bigint, reason string, recorded_at timestamp, target_file string, confidence string"


def _range_of(key: Column, bits: int) -> Column:
    """Top bits of the key's hash, 0 .. 2^bits - 1, in the order of the hash."""
    return (F.shiftrightunsigned(F.xxhash64(key), 64 - bits)).cast("int") if bits else F.lit(0)


def _micros(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = np.asarray(whole.is_null())
    return np.asarray(whole.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0)), null


def _lookup(parents: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted parents, -1 if it isn't there."""
    if not len(parents):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(parents, keys), len(parents) - 1)
    return np.where(parents[at] == keys, at, -1)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([x.encode() for x in column.to_pylist()], dtype=object)


def probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Misses among `refs` of one range."""
    kind = np.asarray(parents["kind"].combine_chunks()) if len(parents) else np.empty(0, int)
    at, at_null = _micros(parents["at"])
    names = _bytes(parents["key"])
    keys, index = np.unique(names, return_inverse=True) if len(names) else (names, np.empty(0, int))
    first = np.full(len(keys), np.iinfo(np.int64).max)
    is_node = kind == NODE
    np.minimum.at(first, index[is_node], np.where(at_null, np.iinfo(np.int64).min, at)[is_node])
    node = np.zeros(len(keys), bool)
    node[index[is_node]] = True
    project = np.zeros(len(keys), bool)
    project[index[kind == PROJECT]] = True

    coded = refs["target_id"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    found = _lookup(keys, _bytes(coded.dictionary))[np.asarray(coded.indices)]
    when, when_null = _micros(refs["recorded_at"])
    there = found >= 0
    safe = np.maximum(found, 0)
    if not len(keys):
        node, project, first = np.zeros(1, bool), np.zeros(1, bool), np.zeros(1, np.int64)
    missing = ~(there & (node | project)[safe])
    known = there & node[safe] & ~when_null
    late = known & (first[safe] > when)

    gone = np.zeros(len(when), bool)
    event = (kind >= ADDED) & ~at_null
    if event.any():
        seq = np.asarray(parents["seq"].combine_chunks())[event]
        order = np.lexsort((seq, at[event], index[event]))
        owner, moment, last = index[event][order], at[event][order], kind[event][order]
        moments = np.unique(moment)
        wide = len(moments) + 1
        slots = owner * wide + np.searchsorted(moments, moment, "right")
        pos = np.searchsorted(slots, safe * wide + np.searchsorted(moments, when, "right"), "right") - 1
        hit = np.maximum(pos, 0)
        gone = known & (pos >= 0) & (owner[hit] == safe) & (last[hit] == DELETED)

    reason = np.where(missing, 0, np.where(late, 1, np.where(gone, 2, -1)))
    keep = pa.array(np.flatnonzero(reason >= 0))
    out = refs.take(keep)
    named = pa.array([REASONS[i] for i in reason[reason >= 0]], pa.string())
    return pa.table(
        [out["edge_id"], named, out["recorded_at"], out["target_file"], out["confidence"]],
        schema=pa.schema([("edge_id", pa.int64()), ("reason", pa.string()), ("recorded_at", refs.schema.field("recorded_at").type), ("target_file", pa.string()), ("confidence", pa.string())]),
    )


def dangling_edges(edges: DataFrame, nodes: DataFrame, project_nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """One row an edge id whose target is missing, not yet indexed or deleted when the edge was recorded.

    A null target is no reference and is no case; an empty one is missing. A null `recorded_at` can't be before
    anything: only 'missing' applies. A node with any null `indexed_at` counts as there from the start. Of changes at
    one moment the larger change_id is the last; 'modified' and 'moved' say nothing. Where several reasons hold the
    first of REASONS is given. Empty tables give: no edges - no rows; no parents - every edge missing.
    """
    spark = edges.sparkSession
    n = edges.count()
    tasks = parallelism(spark)
    bits = max(0, math.ceil(math.log2(max(tasks, n / RANGE_ROWS, 1))))
    ranges = 1 << bits
    fair = max(1, n // ranges)
    refs = edges.where("target_id is not null").select(
        F.col("id").alias("edge_id"), "target_id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), "target_file", "confidence"
    )
    # Fewer than 2 * ranges keys have more than half of a fair share: a proven bound for the broadcast.
    heavy = (
        refs.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fair // 2)
        .select(F.col("target_id").alias("hot"), F.least(F.lit(ranges), F.ceil(F.col("n") / max(1, fair // 2))).cast("int").alias("copies"))
    )
    hot = [tuple(r) for r in heavy.collect()] if n else []
    heavy = F.broadcast(spark.createDataFrame(hot, "hot string, copies int"))

    def ranged(df: DataFrame, key: str, salt: Column) -> DataFrame:
        joined = df.join(heavy, F.col(key) == F.col("hot"), "left")
        copies = F.coalesce("copies", F.lit(1))
        salted = joined.withColumn("salt", salt(copies))
        return salted.withColumn("rid", F.pmod(_range_of(F.col(key), bits) + F.col("salt"), F.lit(ranges)).cast("int")).drop("hot", "copies", "salt")

    stamp = lambda c: F.col(c).cast("timestamp").alias("at")
    none = F.lit(None).cast("timestamp").alias("at")
    kind = lambda k: F.lit(k).alias("kind")
    seq = lambda c: c.cast("long").alias("seq")
    parents = (
        nodes.select(F.col("node_id").alias("key"), kind(NODE), stamp("indexed_at"), seq(F.lit(0)))
        .unionByName(project_nodes.select(F.col("node_id").alias("key"), kind(PROJECT), none, seq(F.lit(0))))
        .unionByName(
            changes.where(F.col("change_kind").isin("added", "deleted")).select(
                F.col("node_id").alias("key"), F.when(F.col("change_kind") == "deleted", DELETED).otherwise(ADDED).alias("kind"), stamp("changed_at"), seq(F.col("change_id"))
            )
        )
        .where("key is not null")
    )
    left = ranged(refs, "target_id", lambda c: F.pmod(F.xxhash64("edge_id"), c))
    right = ranged(parents, "key", lambda c: F.explode(F.sequence(F.lit(0), c - 1)))
    misses = left.groupBy("rid").cogroup(right.groupBy("rid")).applyInArrow(_probe_range, _OUT)
    return misses.dropDuplicates(["edge_id"])


def _probe_range(refs: pa.Table, parents: pa.Table) -> pa.Table:
    return probe(refs, parents)


def dangling_report(misses: DataFrame, table: str) -> DataFrame:
    """Counts per referring table, month, target file and confidence, and why."""
    month = F.date_format("recorded_at", "yyyy-MM")
    return misses.groupBy(F.lit(table).alias("ref_table"), month.alias("month"), "target_file", "confidence", "reason").agg(F.count(F.lit(1)).alias("n_edges"))
