"""The most similar vectors of every vector, by an inverted multi-index.

The two halves of each unit vector are quantised separately; a cell is a pair of centroids. A query walks the pairs by
summed distance with a heap until the cells hold enough vectors, is sent to those cells, and is compared there exactly
in blocks. Exact copies are searched once and share their answer. Centroids are fitted on a bounded sample; every
vector is indexed. Hot cells are cut into blocks on both sides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.batches import spread

DIM, K = 64, 5
#: Vectors at most that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
#: Vectors a cell should hold on average; centroids a half at most; vectors that the cells of one query hold.
CELL, MOST_CENTROIDS, PROBE = 250, 256, 4000
#: Second search, for vectors whose K-th neighbour is less similar than NEAR: centroids a half of a coarse index, and
#: the share of all vectors that it probes. Such vectors have no close neighbours; theirs are spread over many cells.
NEAR, COARSE, COARSE_SHARE = 0.7, 16, 0.15
#: Vectors and queries of one block.
BLOCK, QUERY_BLOCK = 4096, 16384


def fit(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means centroids of a bounded sample; never more than there are distinct points."""
    points = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (sample @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
        size = np.bincount(near, minlength=len(centres))
        for j in np.flatnonzero(size):
            centres[j] = sample[near == j].mean(0)
    return centres.astype(np.float32)


@dataclass
class Index:
    """Centroids of both halves and the number of vectors in each cell (cell = first * len(second) + second)."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        d = lambda a, c: (a @ c.T) * -2 + (c * c).sum(1) + (a * a).sum(1)[:, None]
        return d(x[:, :h], self.first), d(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def walk(self, d1: np.ndarray, d2: np.ndarray, probe: int) -> list[int]:
        """Cells by ascending summed distance until they hold `probe` vectors; empty cells are passed over."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        a, b = d1[o1].tolist(), d2[o2].tolist()
        o1, o2 = o1.tolist(), o2.tolist()
        m, counts = len(o2), self.counts
        heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
        while heap and held < probe:
            _, i, j = heapq.heappop(heap)
            cell = o1[i] * m + o2[j]
            n = counts[cell]
            if n:
                out.append(cell)
                held += n
            # Each pair is reached once: along its row, and down the first column.
            if j + 1 < m:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def unit_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """node_id and unit vector (bytes of float32) of every usable row; null, wrong-sized, not finite and all-zero ones fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("embedding").to_pylist(), np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype(np.float32) + np.float32(0)  # no negative zeros, so equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([batch.column("node_id").filter(pa.array(ok)), pa.array([r.tobytes() for r in unit], pa.binary())], names=["node_id", "vec"])

    usable = vectors.where((F.size("embedding") == dim) & F.col("node_id").isNotNull() & ~F.exists("embedding", lambda v: v.isNull())).select("node_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return spread(usable).mapInArrow(run, "node_id string, vec binary")


def classes(units: DataFrame, k: int) -> DataFrame:
    """One row a distinct vector: vid (a hash of it), vec, and its k + 1 smallest node ids; more copies are not listed here."""
    ranked = units.withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("node_id"))).where(F.col("rn") <= k + 1)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("node_id")).alias("members")).select(F.xxhash64("vec").alias("vid"), "vec", "members")


def build(distinct: DataFrame, n: int, k: int, dim: int) -> Index:
    """Centroids from a bounded sample drawn by hash, counts of all cells (at most MOST_CENTROIDS squared)."""
    step = max(1, -(-n // SAMPLE))
    sample = distinct.where(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(step)) == 0).select("vec").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = distinct.select("vec").limit(SAMPLE).toArrow()
    x = _matrix(sample["vec"], dim)
    h = dim // 2
    index = Index(fit(x[:, :h], k), fit(x[:, h:], k), np.empty(0, np.int64))
    index.counts = np.zeros(len(index.first) * len(index.second), np.int64)
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.counts), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(shared.value.cells(_matrix(batch.column("vec"), dim)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["cell", "n"])

    got = distinct.select("vec").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    index.counts[np.asarray(got["cell"])] = np.asarray(got["n"])
    return index


_COPY = pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("qblock", pa.int32()), ("vid", pa.int64()), ("vec", pa.binary())])
_COPIES = "cell bigint, block int, qblock int, vid bigint, vec binary"


def search(distinct: DataFrame, queries: DataFrame, index: Index, probe: int, k: int, dim: int, least: float) -> DataFrame:
    """(vid, other, similarity): for each query and visited cell its k best vectors there of at least `least`."""
    shared = distinct.sparkSession.sparkContext.broadcast(index)
    visits = max(1, round(probe / max(1.0, index.counts[index.counts > 0].mean()))) if index.counts.any() else 1

    def blocks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = shared.value.counts[cells]
        return -(-n // BLOCK), -(-n * visits // QUERY_BLOCK)

    def emit(cell, block, qblock, vid, vecs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(block, pa.int32()), pa.array(qblock, pa.int32()), pa.array(vid, pa.int64()), vecs], schema=_COPY)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = shared.value.cells(_matrix(batch.column("vec"), dim))
            vid = np.asarray(batch.column("vid"))
            nb, nq = blocks(cell)
            at = np.repeat(np.arange(len(cell)), nq)
            qblock = np.concatenate([np.arange(q) for q in nq.tolist()])
            yield emit(cell[at], (np.abs(vid) % nb)[at], qblock, vid[at], batch.column("vec").take(pa.array(at)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                d1, d2 = shared.value.distances(_matrix(part.column("vec"), dim))
                vid = np.asarray(part.column("vid"))
                walked = [shared.value.walk(d1[i], d2[i], probe) for i in range(len(vid))]
                at = np.repeat(np.arange(len(vid)), [len(w) for w in walked])
                cell = np.array([c for w in walked for c in w], np.int64)
                nb, nq = blocks(cell)
                once = np.repeat(np.arange(len(cell)), nb)
                block = np.concatenate([np.arange(b) for b in nb.tolist()]) if len(nb) else np.empty(0, int)
                yield emit(cell[once], block, ((np.abs(vid[at]) // 7919) % nq)[once], vid[at][once], part.column("vec").take(pa.array(at[once])))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = np.asarray(left["vid"].combine_chunks()), np.asarray(right["vid"].combine_chunks())
        if not len(q) or not len(v):
            return pa.table({"vid": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "similarity": pa.array([], pa.float32())})
        a, b = _matrix(left["vec"], dim), _matrix(right["vec"], dim)
        out = []
        for i in range(0, len(q), 1024):
            s = a[i : i + 1024] @ b.T
            s[q[i : i + 1024, None] == v[None, :]] = -2
            m = min(k, len(v))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(v) else np.broadcast_to(np.arange(m), (len(s), m))
            sim = np.take_along_axis(s, best, 1)
            row, col = np.nonzero(sim >= max(least, -1.5))
            out.append((q[i : i + 1024][row], v[best[row, col]], sim[row, col]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"vid": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], pa.float32())})

    key = ["cell", "block", "qblock"]
    routed = queries.select("vid", "vec").mapInArrow(route, _COPIES).groupBy(*key)
    placed = distinct.select("vid", "vec").mapInArrow(place, _COPIES).groupBy(*key)
    return routed.cogroup(placed).applyInArrow(compare, "vid bigint, other bigint, similarity float")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query as one array; a query has at most k rows a visited block, so the list is bounded."""
    pair = F.struct((-F.col("similarity")).alias("d"), F.col("other"), F.col("similarity"))
    return found.groupBy("vid").agg(F.slice(F.array_sort(F.collect_set(pair)), 1, k).alias("near"))


def neighbours(vectors: DataFrame, k: int = K, dim: int = DIM, least: float = -1.0, probe: int = PROBE, far: bool = True) -> DataFrame:
    """(node_id, other, similarity): for each usable vector its k most similar other nodes of at least `least`.

    Rows delivered twice (same node_id) count once (if their vectors differ, the smaller bytes win). Null, all-zero,
    not finite and wrong-sized vectors take no part. Ties go to the smaller node id. Copies of one vector are each
    other's best neighbours. Fewer than k others: all of them. With `far`, vectors without close neighbours are
    searched again over a larger share. An empty table gives no rows.
    """
    units = unit_vectors(vectors, dim).groupBy("node_id").agg(F.min("vec").alias("vec"))
    distinct = classes(units, k).persist()
    sizes = distinct.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vid").alias("ids")).first()
    if not sizes.n:
        return distinct.sparkSession.createDataFrame([], "node_id string, other string, similarity float")
    if sizes.n != sizes.ids:
        raise ValueError("two vectors share a hash")  # 64 bits: not below some hundred million vectors
    fine = build(distinct, sizes.n, int(np.clip(np.sqrt(sizes.n / CELL), 1, MOST_CENTROIDS)), dim)
    found = search(distinct, distinct, fine, probe, k, dim, least)
    if far:
        first = best(found, k)
        weak = F.element_at("near", -1).similarity < NEAR
        lonely = distinct.join(first.where((F.size("near") == k) & ~weak).select("vid"), "vid", "left_anti")
        coarse = build(distinct, sizes.n, int(np.clip(np.sqrt(sizes.n / 16), 1, COARSE)), dim)
        found = found.unionByName(search(distinct, lonely, coarse, max(probe, int(COARSE_SHARE * sizes.n)), k, dim, least))
    near = best(found, k).select("vid", F.explode("near").alias("p")).select("vid", F.col("p.other").alias("o"), F.col("p.similarity").alias("similarity"))
    members = distinct.select(F.col("vid").alias("o"), F.col("members").alias("theirs"))
    around = near.join(members, "o").groupBy("vid").agg(F.collect_list(F.struct("similarity", "theirs")).alias("around"))
    answers = distinct.select("vid", "vec", "members").join(around, "vid", "left").select(
        F.col("vec"), F.transform("members", lambda m: F.struct(F.lit(-1.0).cast("float").alias("d"), m.alias("other"))).alias("copies"),
        F.flatten(F.transform(F.coalesce("around", F.array()), lambda a: F.transform(a.theirs, lambda m: F.struct((-a.similarity).alias("d"), m.alias("other"))))).alias("rest"),
    )
    # Every node takes the answer of its vector; itself left out, the k best remain (k + 1 copies are listed).
    joined = units.join(answers, "vec")
    ranked = F.slice(F.array_sort(F.filter(F.concat("copies", "rest"), lambda p: (p.other != F.col("node_id")) & (-p.d >= F.lit(least)))), 1, k)
    return joined.select("node_id", F.explode(ranked).alias("p")).select("node_id", F.col("p.other").alias("other"), (-F.col("p.d")).alias("similarity"))


def close_pairs(vectors: DataFrame, least: float = 0.82, k: int = K, dim: int = DIM) -> DataFrame:
    """Pairs (node_a < node_b in byte order) of at least `least` similarity where one is among the k best of the other."""
    near = neighbours(vectors, k, dim, least, far=False)
    return near.select(F.least("node_id", "other").alias("node_a"), F.greatest("node_id", "other").alias("node_b")).distinct()
