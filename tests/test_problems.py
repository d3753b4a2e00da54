"""Problems 2 and 7: skewed keys and dangling references, against brute force, with dirty rows."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.operators import balance as B
from lodegraph.operators import dangling as D

T0 = dt.datetime(2024, 1, 1)


def edges_of(spark, rows):
    """rows: (id, source, target, weight, recorded_at); a clashing extra column rides along."""
    full = [(i, "w", s, t, "calls", "structural", None, "EXTRACTED", w, None, None, "f.py", "py", None, None, None, at) for i, s, t, w, at in rows]
    return spark.createDataFrame(full, S.EDGE_SCHEMA).withColumn("key", F.lit("clash")).withColumn("_task", F.lit("clash"))


def nodes_of(spark, rows):
    """rows: (node_id, symbol_type, indexed_at)."""
    names = [f.name for f in S.NODE_SCHEMA]
    full = [tuple({"node_id": n, "symbol_type": k, "indexed_at": at, "wiki_id": "w"}.get(c) for c in names) for n, k, at in rows]
    return spark.createDataFrame(full, S.NODE_SCHEMA)


def test_pack_levels_load():
    where, load = B.pack([(100, "a"), (60, "b"), (50, "c"), (50, "d")], 2)
    assert sorted(load) == [110, 150] and set(where) == {"a", "b", "c", "d"}
    assert B.pack([], 3) == ({}, [0, 0, 0])


def test_key_stats_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, f"s{rnd.randrange(40)}", "hot" if rnd.random() < 0.35 else f"t{rnd.randrange(30)}", rnd.choice([0.5, 1.25, None, float("nan")]), T0) for i in range(2000)]
    rows += [(2000, None, "t1", 1.0, T0), (2001, "s1", None, 1.0, T0), (2002, "s1", "", 2.0, T0)]
    rows += rows[:50]  # delivered twice
    nodes = nodes_of(spark, [("hot", "Class", None), ("t1", "function", None), ("t1", "function", T0)])
    got, total = B.key_stats(edges_of(spark, rows), nodes)
    want = defaultdict(lambda: [0, set(), 0.0, set()])
    for i, s, t, w, _ in rows:
        for side, k, o in (("target", t, s), ("source", s, t)):
            if k is None:
                continue
            x = want[side, k]
            x[0] += 1
            if i not in x[1]:
                x[1].add(i)
                x[2] += w if w is not None and w == w else 0.0
            if o is not None:
                x[3].add(o)
    made = {(r.side, r.node_id): r for r in got.collect()}
    assert total == len(rows) and set(made) == set(want)
    for k, (n, ids, w, others) in want.items():
        r = made[k]
        assert (r.n_rows, r.degree, r.n_neighbours) == (n, len(ids), len(others)), k
        assert abs((r.weight_sum or 0.0) - w) < 1e-6
    assert made["target", "hot"].symbol_type == "class" and made["target", "t2"].symbol_type is None


def test_hot_key_is_sharded(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"), F.col("id").cast("string").alias("other"))
    plan = B.plan_load(rows.select("key"), ["key"], 3000, tasks=8)
    assert len(set(plan.shards[("hot",)])) >= 4
    sizes = [r["count"] for r in B.fragment(rows, plan, ["key"], ["other"]).groupBy("_task").count().collect()]
    assert max(sizes) < 2.0 * 3000 / 8


def test_hot_pair_is_sharded(spark):
    """Half of all edges run between one pair, a quarter of them have no source."""
    rows = [(i, "a" if i % 4 < 2 else None if i % 4 == 2 else f"s{i}", "b" if i % 4 < 3 else f"t{i}", 1.0, T0) for i in range(4000)]
    both = B.endpoint_rows(edges_of(spark, rows))
    plan = B.plan_load(both.select("side", "key"), ["side", "key"], both.count(), tasks=8)
    sizes = [r["count"] for r in B.fragment(both, plan, ["side", "key"], ["other", "id"]).groupBy("_task").count().collect()]
    assert max(sizes) < 2.0 * both.count() / 8
    made = {(r.side, r.node_id): (r.degree, r.n_neighbours) for r in B.key_stats(edges_of(spark, rows), nodes_of(spark, []))[0].collect()}
    assert made["target", "b"] == (3000, 1) and made["source", "a"] == (2000, 1) and made["source", "s3"] == (1, 1)


def test_key_stats_empty(spark):
    got, total = B.key_stats(edges_of(spark, []), nodes_of(spark, []))
    assert total == 0 and got.count() == 0


def brute_dangling(edges, nodes, project, changes):
    seen = {}
    for n, _, at in nodes:
        if n not in seen or seen[n] is not None:
            seen[n] = None if at is None else min(seen.get(n) or at, at)
    out = {}
    for i, _, t, _, at in edges:
        if t is None:
            continue
        if t not in seen and t not in project:
            out[i] = "missing"
        elif t in seen and at is not None:
            last = max(((c, k, kind) for k, n, kind, c in changes if n == t and kind in ("added", "deleted") and c is not None and c <= at), default=None)
            if seen[t] is not None and seen[t] > at:
                out[i] = "not_yet_indexed"
            elif last and last[2] == "deleted":
                out[i] = "deleted"
    return out


def test_dangling_against_brute_force(spark):
    rnd = random.Random(2)
    day = lambda n: T0 + dt.timedelta(days=n)
    names = [f"n{i}" for i in range(60)] + ["", "Ünï\x00", "hot"]
    nodes = [(n, "class", rnd.choice([None, day(rnd.randrange(20))])) for n in names[:40] + ["hot", "Ünï\x00"] for _ in range(rnd.choice([1, 1, 2]))]
    project = {"n50", "n51"}
    changes = [(k, rnd.choice(names), rnd.choice(["added", "deleted", "modified", "moved"]), rnd.choice([day(rnd.randrange(20)), day(5)])) for k in range(120)]
    edges = [(i, "s", rnd.choice([*names, None, "hot", "hot"]), 1.0, rnd.choice([day(rnd.randrange(20)), None])) for i in range(800)]
    edges += edges[:20]
    p = spark.createDataFrame([("p", n, "w", "{}") for n in project], "project_id string, node_id string, wiki_id string, attrs string")
    c = spark.createDataFrame([(k, "w", n, kind, None, None, at) for k, n, kind, at in changes], "change_id bigint, wiki_id string, node_id string, change_kind string, content_hash string, rel_path string, changed_at timestamp")
    got = D.dangling_edges(edges_of(spark, edges), nodes_of(spark, nodes), p, c)
    made = {r.edge_id: r.reason for r in got.collect()}
    assert made == brute_dangling(edges, nodes, project, changes)
    none = D.dangling_edges(edges_of(spark, edges), nodes_of(spark, []), p.limit(0), c.limit(0))
    assert {r.reason for r in none.collect()} == {"missing"}
    assert D.dangling_edges(edges_of(spark, []), nodes_of(spark, nodes), p, c).count() == 0
    assert D.dangling_report(got, "repo_edges").agg(F.sum("n_edges")).first()[0] == len(made)


def test_probe_without_parents():
    refs = pa.table({"edge_id": pa.array([1], pa.int64()), "target_id": ["x"], "recorded_at": pa.array([T0], pa.timestamp("us", "UTC")), "target_file": ["f"], "confidence": pa.array([None], pa.string())})
    parents = pa.table({"key": pa.array([], pa.string()), "kind": pa.array([], pa.int32()), "at": pa.array([], pa.timestamp("us", "UTC")), "seq": pa.array([], pa.int64())})
    assert D.probe(refs, parents)["reason"].to_pylist() == ["missing"]
