"""Graph operators on small seeded graphs and against plain dictionaries on random ones."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import clustering as C
from lodegraph.operators import expansion as E
from lodegraph.operators import graph as G
from lodegraph.operators import incremental as I
from lodegraph.operators import traverse as P
from tests.test_problems import nodes_of

EDGE = "id bigint, wiki_id string, source_id string, target_id string, rel_type string, edge_class string, confidence string, weight double"


def edges(spark, pairs):
    return spark.createDataFrame([(i, "w", a, b, r, "structural", c, 1.0) for i, (a, b, r, c) in enumerate(pairs)], EDGE)


def path_graph(spark):
    e = [("A", "B", "calls", "EXTRACTED"), ("B", "C", "calls", "INFERRED"), ("C", "D", "calls", "EXTRACTED"), ("B", "E", "imports", "EXTRACTED"), ("E", "F", "calls", "EXTRACTED"), ("G", "H", "calls", "EXTRACTED")]
    return edges(spark, e)


def test_shortest_path(spark):
    e = path_graph(spark)
    assert [r.node_id for r in P.shortest_path(e, "A", "D").orderBy("position").collect()] == ["A", "B", "C", "D"]
    assert P.shortest_path(e, "A", "G").count() == 0
    assert P.shortest_path(e, "A", "D", 2).count() == 0
    assert [r.node_id for r in P.shortest_path(e, "A", "A").collect()] == ["A"]


def test_relationships_and_confidence(spark):
    e = path_graph(spark)
    seeds = spark.createDataFrame([("A",)], "node_id string")
    got = {(r.source_id, r.target_id): r.hop for r in P.relationships(e, seeds, 3).collect()}
    assert got == {("A", "B"): 1, ("B", "C"): 2, ("B", "E"): 2, ("C", "D"): 3, ("E", "F"): 3}
    sure = {(r.source_id, r.target_id) for r in P.relationships(e, seeds, 3, least="EXTRACTED").collect()}
    assert sure == {("A", "B"), ("B", "E"), ("E", "F")}


def random_graph(seed, n=40, m=60):
    rnd = random.Random(seed)
    return [f"v{i:02}" for i in range(n)], [(f"v{rnd.randrange(n):02}", f"v{rnd.randrange(n):02}", "calls", None) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_and_components(spark, seed):
    names, pairs = random_graph(seed)
    near = defaultdict(set)
    for a, b, _, _ in pairs:
        near[a].add(b)
        near[b].add(a)
    e = edges(spark, pairs)
    seeds = spark.createDataFrame([(names[0],), (names[5],)], "node_id string")
    want = {}
    for s in (names[0], names[5]):
        dist, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in dist and dist[x] < 3:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        want |= {(s, k): v for k, v in dist.items() if v}
    assert {(r.seed, r.node_id): r.hop for r in P.reach(e, seeds, 3, "both").collect()} == want
    root = {v: v for v in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _, _ in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    n = spark.createDataFrame([(v,) for v in names], "node_id string")
    assert {r.node_id: r.component for r in P.components(n, e).collect()} == {v: find(v) for v in names}


def test_pagerank(spark):
    _, pairs = random_graph(3)
    e = edges(spark, pairs)
    ranks = {r.node_id: r["rank"] for r in P.pagerank(e, tolerance=1e-9).collect()}
    w = defaultdict(lambda: defaultdict(float))
    for a, b, _, _ in pairs:
        if a != b:
            w[a][b] += 1
            w[b][a] += 1
    r = {v: 1 / len(w) for v in w}
    for _ in range(60):
        r = {v: 0.15 / len(w) + 0.85 * sum(r[u] * w[u][v] / sum(w[u].values()) for u in w[v]) for v in w}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and max(abs(ranks[v] - r[v]) for v in w) < 1e-3


def test_two_cliques(spark):
    left, right = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    pairs = [(x, y) for c in (left, right) for i, x in enumerate(c) for y in c[i + 1 :]] + [("a0", "b0")]
    links = spark.createDataFrame([("p", *sorted(x), 1.0) for x in pairs], "part string, a string, b string, w double")
    nodes = spark.createDataFrame([("p", v) for v in [*left, *right, "lone"]], "part string, node string")
    got = C.louvain(nodes, links)
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.community].add(r.node)
    assert sorted(map(sorted, groups.values())) == [left, right, ["lone"]]
    assert C.modularity(links, got).first().modularity > 0.4
    numbers = {r.node: r.cluster for r in C.renumber(got).collect()}
    assert numbers["lone"] == 2 and len(set(numbers.values())) == 3


def test_local_and_distributed_communities_agree(spark):
    rnd = random.Random(5)
    pairs = {}
    for p in ("p", "q"):
        for _ in range(60):
            g = rnd.randrange(3)
            a, b = (f"n{g}{rnd.randrange(8)}" for _ in range(2))
            if rnd.random() < 0.1:
                b = f"n{rnd.randrange(3)}{rnd.randrange(8)}"
            pairs[p, min(a, b), max(a, b)] = float(rnd.randint(1, 3))
    links = spark.createDataFrame([(p, a, b, w) for (p, a, b), w in pairs.items() if a != b], "part string, a string, b string, w double")
    nodes = spark.createDataFrame([(p, f"n{g}{i}") for p in ("p", "q") for g in range(3) for i in range(8)], "part string, node string")
    got = [{(r.part, r.node): r.community for r in C.louvain(nodes, links, local=n).collect()} for n in (10_000, 0)]
    assert got[0] == got[1] and len(got[0]) == 48


def test_merge_and_stable_ids():
    import pandas as pd

    sizes = pd.DataFrame({"cluster": [0, 1, 2], "size": [5, 1, 4]})
    ties = pd.DataFrame({"a": [0, 1], "b": [1, 2], "w": [1.0, 3.0]})
    assert C.merge_to_cap(sizes, ties, 2) == {0: 1, 1: 0, 2: 0} or C.merge_to_cap(sizes, ties, 2) == {0: 0, 1: 1, 2: 1}
    over = pd.DataFrame({"new": [0, 1], "old": [7, None], "both": [9, None], "new_size": [10, 3], "old_size": [10, None], "max_old": [7, 7]})
    assert C.keep_ids(over) == {0: 7, 1: 8}


def test_alias_chain(spark):
    kinds = {"a": "type_alias", "b": "type_alias", "c": "class", "x": "type_alias", "y": "type_alias"}
    n = G.nodes_view(nodes_of(spark, [(k, v, None) for k, v in kinds.items()]))
    e = edges(spark, [("a", "b", "alias_of", None), ("b", "c", "alias_of", None), ("x", "y", "alias_of", None), ("y", "x", "alias_of", None)])
    got = {r.node_id: r.resolved for r in E.alias_targets(n, e).collect()}
    assert got["a"] == "c" and got["b"] == "c" and got.get("x") == "y"


def test_changes(spark):
    s = "node_id string, content_hash string, rel_path string"
    old = spark.createDataFrame([("same", "h", "p"), ("gone", "h", "p"), ("nohash", None, "p"), ("moved", "h", "p"), ("edit", "h", "p")], s)
    new = spark.createDataFrame([("same", "h", "p"), ("nohash", None, "p"), ("moved", "h", "q"), ("edit", "g", "p"), ("fresh", "h", "p")], s)
    kinds = {r.node_id: r.kind for r in I.detect_changes(old, new).collect()}
    assert kinds == {"gone": "deleted", "nohash": "modified", "moved": "moved", "edit": "modified", "fresh": "added"}
    changes = I.detect_changes(old, new)
    cites = spark.createDataFrame([("p1", "edit"), ("p1", "moved"), ("p2", "gone"), ("p3", "moved"), ("p4", "fresh"), ("p5", "same"), ("p6", "gone"), ("p6", "same")], "page_id string, node_id string")
    pages = spark.createDataFrame([(f"p{i}", "same") for i in range(1, 7)], "page_id string, primary_symbol_id string")
    assert {r.page_id: r.regime for r in I.regimes(changes, cites, pages).collect()} == {"p1": "edit", "p2": "deleted", "p3": "trivial", "p4": "structural", "p6": "structural"}
    assert {r.page_id: (r.n_changes, r.worst) for r in I.affected_pages(changes, cites).collect()}["p1"] == (2, "modified")


def test_nodes_view_dirty(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    n = G.nodes_view(nodes_of(spark, [("a", "Class", None), ("a", "CLASS", t), ("b", None, None), (None, "class", t)]).withColumn("degree", F.lit(1)))
    got = {r.node_id: r for r in n.collect()}
    assert set(got) == {"a", "b"} and got["a"].symbol_type == "class" and got["a"].is_architectural and not got["b"].is_architectural
    empty = G.nodes_view(nodes_of(spark, []))
    assert G.stats(empty, edges(spark, [])).where("metric = 'confidence'").count() == 3


def test_streaming_diff(spark, tmp_path):
    from lodegraph.streaming import diff

    schema = "node_id string, content_hash string, rel_path string, indexed_at timestamp"
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    one = spark.createDataFrame([("a", "1", "p", None), ("b", "1", "p", None)], schema)
    one.coalesce(1).write.mode("append").parquet(src)
    diff.start(spark.readStream.schema(schema).parquet(src), store).awaitTermination(60)
    spark.createDataFrame([("a", "2", "p", None), ("c", "1", "p", None)], schema).coalesce(1).write.mode("append").parquet(src)
    diff.start(spark.readStream.schema(schema).parquet(src), store).awaitTermination(60)
    got = {(r.epoch, r.node_id, r.kind) for r in spark.read.parquet(f"{store}/changes").collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "modified"), (1, "c", "added")}


def test_bundle_round_trip(spark, tmp_path, data):
    from lodegraph.sources.bundles import read_bundle, write_bundle

    nodes, links = spark.read.parquet(f"{data}/repo_nodes.parquet"), spark.read.parquet(f"{data}/repo_edges.parquet")
    for form in ("parquet", "json"):
        write_bundle(nodes, links, str(tmp_path / form), form)
        n, e = read_bundle(spark, str(tmp_path / form))
        assert n.count() == nodes.count() and e.select("id", "target_id", "weight").exceptAll(links.select("id", "target_id", "weight")).count() == 0
    (tmp_path / "old" / "manifest").mkdir(parents=True)
    (tmp_path / "old" / "manifest" / "a.json").write_text('{"version": 99, "form": "json"}')
    with pytest.raises(ValueError):
        read_bundle(spark, str(tmp_path / "old"))


def test_sources(spark, tmp_path):
    from lodegraph.sources.files import SOURCES, working_tree

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "b.md").write_text("# b")
    got = {r.rel_path: r.text for r in working_tree(spark, str(tmp_path), include=["*.py"]).collect()}
    assert got == {"src/a.py": "x = 1"} and "git" in SOURCES.names()
    with pytest.raises(KeyError):
        SOURCES.create("nope", spark, "x")


def test_facade(spark, data):
    from lodegraph.api import CodeGraph

    g = CodeGraph(spark, data)
    assert g.query("type:class limit:3").count() == 3 and g.query("classes in src/").count() > 0
    assert g.search("cache OR ledger", 5).count() <= 5 and g.stats().count() > 5 and g.files("*.py").count() > 0
    top = g.god_nodes(1).first().node_id
    assert g.expand([top]).count() >= 0 and g.relationships(top).count() > 0 and g.code(top).count() == 1
    assert g.resolve([top]).first().node_id == top


def test_project_ids(spark):
    from lodegraph.functions import scalars as X

    d = spark.createDataFrame([("w", "python::a::b")], "w string, n string").select(X.project_node_id(F.col("w"), F.col("n")).alias("p"))
    r = d.select(X.split_project_node_id(F.col("p")).alias("s"), X.language_by_path(F.lit("x/y.py")).alias("l"), X.doc_kind(F.lit("y.md")).alias("k")).first()
    assert (r.s.wiki_id, r.s.node_id, r.l, r.k) == ("w", "python::a::b", "python", "markdown")
