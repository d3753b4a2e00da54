"""Per-key results over keys of very uneven load (fragment-replicate by estimated load).

The load of every key is counted with map-side combine. Keys above a fair share of a task are *fragmented*:
their rows go to a number of shards in proportion to their load. All other keys stay whole and travel in hash
buckets. Shards and buckets are packed onto tasks, largest first, onto the least loaded task. The matching side
(one row per key) is replicated only to the shards of its key.

Only the heavy keys and the bucket loads reach the driver: of keys above total / (tasks * SPLIT) rows there are
fewer than tasks * SPLIT, and there are tasks * BUCKETS buckets, whatever the data.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import parallelism

#: A key is heavy above 1/SPLIT of a task's fair share; light keys travel in BUCKETS buckets a task.
SPLIT, BUCKETS = 2, 16


@dataclass
class LoadPlan:
    """tasks: how many; shards: heavy key -> task of each of its shards; buckets: task of each bucket of light keys; load: rows of each task."""

    tasks: int
    total: int
    shards: dict[tuple, list[int]]
    buckets: list[int]
    load: list[int]


def pack(items: list[tuple[int, object]], tasks: int) -> tuple[dict, list[int]]:
    """Largest first onto the least loaded of `tasks`; gives the task of each item and the loads."""
    heap = [(0, t) for t in range(tasks)]
    load, where = [0] * tasks, {}
    for rows, item in sorted(items, key=lambda x: (-x[0], repr(x[1]))):
        now, t = heapq.heappop(heap)
        where[item] = t
        load[t] = now + rows
        heapq.heappush(heap, (load[t], t))
    return where, load


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def plan_load(rows: DataFrame, keys: list[str], total: int, tasks: int | None = None) -> LoadPlan:
    """Count each key's rows and place keys on tasks. Null keys take no part."""
    tasks = tasks or parallelism(rows.sparkSession)
    fair = max(1, total // tasks)
    heavy, n = max(1, fair // SPLIT), tasks * BUCKETS
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    got = (
        counts.groupBy(_bucket(keys, n).alias("_b"))
        .agg(
            F.sum(F.when(F.col("_n") <= heavy, F.col("_n"))).alias("light"),
            F.collect_list(F.when(F.col("_n") > heavy, F.struct(*keys, "_n"))).alias("heavy"),
        )
        .collect()
    )
    items: list[tuple[int, object]] = [(r.light or 0, ("bucket", r._b)) for r in got]
    pieces: dict[tuple, int] = {}
    for r in got:
        for h in r.heavy:
            key = tuple(h[k] for k in keys)
            pieces[key] = min(tasks, -(-h["_n"] // heavy))
            items += [(-(-h["_n"] // pieces[key]), ("shard", key, s)) for s in range(pieces[key])]
    where, load = pack(items, tasks)
    buckets = [where.get(("bucket", b), b % tasks) for b in range(n)]
    return LoadPlan(tasks, total, {k: [where["shard", k, s] for s in range(m)] for k, m in pieces.items()}, buckets, load)


def _with_shards(df: DataFrame, plan: LoadPlan, keys: list[str]) -> DataFrame:
    if not plan.shards:
        return df.withColumn("_shards", F.lit(None).cast("array<int>"))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _shards array<int>"
    heavy = df.sparkSession.createDataFrame([(*k, s) for k, s in plan.shards.items()], schema)
    return df.join(F.broadcast(heavy), keys, "left")  # fewer than tasks * SPLIT rows


def fragment(rows: DataFrame, plan: LoadPlan, keys: list[str], spread_by: list[str]) -> DataFrame:
    """Send each row to the task of its key, rows of heavy keys to the shard that `spread_by` hashes to. Adds `_task` and `_heavy`."""
    df = _with_shards(rows, plan, keys)
    light = F.element_at(F.array(*map(F.lit, plan.buckets)), _bucket(keys, len(plan.buckets)) + 1)
    shard = F.element_at("_shards", (F.pmod(F.xxhash64(*spread_by), F.size("_shards")) + 1).cast("int"))
    df = df.withColumn("_heavy", F.col("_shards").isNotNull()).withColumn("_task", F.when(F.col("_shards").isNull(), light).otherwise(shard)).drop("_shards")
    return df.repartitionById(plan.tasks, "_task")


def replicate(dims: DataFrame, plan: LoadPlan, keys: list[str]) -> DataFrame:
    """The matching side: one copy for a light key, one for each task that holds a shard of a heavy key."""
    df = _with_shards(dims, plan, keys)
    light = F.element_at(F.array(*map(F.lit, plan.buckets)), _bucket(keys, len(plan.buckets)) + 1)
    tasks = F.when(F.col("_shards").isNull(), F.array(light)).otherwise(F.array_distinct("_shards"))
    return df.withColumn("_task", F.explode(tasks)).drop("_shards").repartitionById(plan.tasks, "_task")


def endpoint_rows(edges: DataFrame) -> DataFrame:
    """Two rows an edge: its target as key, its source as key. Null keys are no key and fall out; '' is one."""
    two = F.explode(
        F.array(
            F.struct(F.lit("target").alias("side"), F.col("target_id").alias("key"), F.col("source_id").alias("other")),
            F.struct(F.lit("source").alias("side"), F.col("source_id").alias("key"), F.col("target_id").alias("other")),
        )
    )
    return edges.select("id", F.col("weight").cast("decimal(18,6)").alias("weight"), two.alias("e")).select("id", "weight", "e.*").where("key is not null")


def key_stats(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Per (side, node_id): rows, degree (distinct edge ids), weight sum, distinct neighbours, and what repo_nodes knows of the key.

    Redelivered edges (same id) count once in degree and weight_sum, each time in n_rows. Null and NaN weights add
    nothing; a null neighbour is no neighbour. A key with no row in `nodes` has null `symbol_type`. An empty edge
    table gives no rows. Weights are summed as decimals of six places, so the sum doesn't depend on the order.
    Also gives the number of edge rows.
    """
    keys = ["side", "key"]
    total = edges.count()
    both = endpoint_rows(edges)
    plan = plan_load(both.select(*keys), keys, 2 * total)
    # A heavy key's rows are spread by neighbour and edge, so that neither a hot pair nor the null neighbour fills one shard.
    rows = fragment(both, plan, keys, ["other", "id"])
    per = ["_task", "_heavy", *keys]
    once = rows.groupBy(*per, "other", "id").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w"))
    pairs = once.groupBy(*per, "other").agg(F.sum("n").alias("n"), F.count("id").alias("degree"), F.sum("w").alias("w"))
    parts = pairs.groupBy(*per).agg(
        F.sum("n").alias("n"), F.sum("degree").alias("degree"), F.sum("w").alias("w"), F.when(F.col("_heavy"), 0).otherwise(F.count("other")).alias("neighbours")
    ).drop("_heavy")
    kinds = nodes.where("node_id is not null").groupBy(F.col("node_id").alias("key")).agg(F.min(F.lower("symbol_type")).alias("symbol_type"))
    dims = replicate(kinds.select("key", "symbol_type", F.explode(F.array(F.lit("target"), F.lit("source"))).alias("side")), plan, keys)
    joined = parts.join(dims, ["_task", *keys], "left").drop("_task")
    # A neighbour of a heavy key may stand in several shards; these are counted once for all of them.
    apart = pairs.where("_heavy and other is not null").select(*keys, "other").distinct().groupBy(*keys).agg(F.count("other").alias("neighbours"))
    joined = joined.unionByName(apart, allowMissingColumns=True)
    out = joined.groupBy("side", F.col("key").alias("node_id")).agg(
        F.sum("n").alias("n_rows"),
        F.sum("degree").alias("degree"),
        F.sum("w").cast("double").alias("weight_sum"),
        F.sum("neighbours").alias("n_neighbours"),
        F.max("symbol_type").alias("symbol_type"),
    )
    return out, total
