"""Stored index, search variants, pages and projects."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.operators import pages as P
from lodegraph.operators import search_index as IX
from lodegraph.operators import text as T
from lodegraph.plans.compile import compile_query
from tests.test_linking import nodes


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["ledger", "vault"], k=rnd.randint(0, 3))), " ".join(rnd.choices("ledger vault cache queue by hand quarter quarantine".split(), k=rnd.randint(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None, None), (501, "", "")], "doc_id bigint, title string, text string")
    path = str(tmp_path_factory.mktemp("index"))
    IX.write(docs, "doc_id", ["title", "text"], path, buckets=8)
    return docs, IX.read(spark, path)


@pytest.mark.parametrize("query", ["ledger", "ledger vault", "ledger OR queue", '"by hand"', "cache NEAR/3 queue", "quar*", '"by hand" OR quarantine', "nosuchword"])
def test_index_scores_as_the_scan_does(corpus, query):
    docs, index = corpus
    weights = {"text": 1.0} if '"' in query or "NEAR" in query else {"title": 10.0, "text": 1.0}
    q = T.parse_query(query)
    scan = T.bm25(docs, "doc_id", weights, q)
    got = {r.doc_id for r in IX.search(index, weights, q).collect()}
    assert got == {r.doc_id for r in scan.collect()}
    if len(weights) == 2:
        scores = {r.doc_id: round(r.score, 9) for r in IX.search(index, weights, q).collect()}
        assert scores == {r.doc_id: round(r.score, 9) for r in scan.collect()}


def test_index_reads_buckets_of_its_terms_only(corpus):
    plan = IX._pruned(corpus[1], [T.Term("ledger")])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]


def test_index_of_nothing(spark, tmp_path):
    IX.write(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", ["text"], str(tmp_path))
    index = IX.Index(spark.createDataFrame([], "doc_id bigint, col string, term string, tf bigint, positions array<int>, dl int, bucket int"), 0, 0, "doc_id", 8)
    assert IX.search(index, {"text": 1.0}, T.Term("x")).count() == 0


def test_search_variants(spark):
    n = nodes(spark, [
        {"node_id": "a", "symbol_name": "load_user", "symbol_type": "function", "language": "Python", "rel_path": "src/a.py", "source_text": "load user from cache"},
        {"node_id": "b", "symbol_name": "user_load", "symbol_type": "method", "language": "java", "rel_path": "lib/b.java", "source_text": "load user"},
        {"node_id": "c", "symbol_type": "class", "rel_path": None},
    ])
    assert [r.node_id for r in T.search_in_path(n, T.Term("load"), "/src/").collect()] == ["a"]
    for path in ("", "/", None):
        with pytest.raises(ValueError):
            T.search_in_path(n, T.Term("load"), path)
    assert [r.node_id for r in T.search_by_name(n, "load user").collect()] == ["a"] and T.search_by_name(n, "").count() == 0
    assert {r.node_id for r in T.search_by_name(n, "user_load", architectural=False).collect()} == {"b"}
    assert {r.node_id for r in T.search_smart(n, "where is loadUser", "symbol").collect()} == {"a", "b"}
    assert {r.node_id for r in T.search_smart(n, "cache", "concept", without=["class"], path="src").collect()} == {"a"}
    assert {r.node_id for r in T.search_smart(n, "user", language="JAVA").collect()} == {"b"} and T.search_smart(n, "").count() == 0
    assert {r.node_id for r in T.search_with_retry(n, "node_id", {"source_text": 1.0}, "cach").collect()} == {"a"}
    low = {r.node_id: r.low for r in nodes(spark, [{"node_id": "x", "symbol_name": "which"}, {"node_id": "y", "symbol_name": "get"}, {"node_id": "z", "symbol_name": "ledger"}, {"node_id": "w"}]).select("node_id", T.low_value(F.col("symbol_name")).alias("low")).collect()}
    assert low == {"x": True, "y": True, "z": False, "w": True}


def test_comparison_needs_a_number(spark):
    n = nodes(spark, [{"node_id": "a", "symbol_type": "class", "symbol_name": "A"}])
    e = spark.createDataFrame([], "id bigint, source_id string, target_id string, rel_type string")
    assert compile_query("type:class connections:>abc", n, e).count() == 0 and compile_query("type:class connections:<1", n, e).count() == 1


def test_relative_paths_and_titles(spark):
    rows = [("a/b/c.md", "../x.md", "a/x.md"), ("a/b/c.md", "./d/../e.md", "a/b/e.md"), ("c.md", "../../x.md", "x.md"), ("a/c.md", "/top.md", "top.md"), ("a/c.md", "", "a"), ("c.md", "", "")]
    got = spark.createDataFrame(rows, "base string, link string, want string").select("want", P.resolve_relative(F.col("base"), F.col("link")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    t = spark.createDataFrame([(" The  Ledger: v2! ",), (None,)], "t string").select(P.normal_title(F.col("t")).alias("t")).collect()
    assert [r.t for r in t] == ["the ledger v2", ""]


def test_slugs_are_unique(spark):
    rows = [("w", 1, "A b"), ("w", 2, "a  B!"), ("v", 3, "A b"), ("w", 4, None), ("w", 5, "??"), (None, 6, "A b")]
    got = {r.k: r.slug for r in P.unique_slugs(spark.createDataFrame(rows, "wiki_id string, k int, title string"), "wiki_id", "k", "title").collect()}
    assert got == {1: "a-b", 2: "a-b-2", 3: "a-b", 4: "page", 5: "page-2", 6: "a-b"}


def test_pages(spark):
    m = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", "3"), ("q", "1"), ("q", "2"), ("q", "2"), ("r", "3"), ("r", "4")], "page_id string, node_id string")
    assert [(r.page_a, r.page_b, r.n_common) for r in P.overlapping_pages(m).collect()] == [("p", "q", 2)]
    cites = lambda rows: spark.createDataFrame(rows, "page_id string, node_id string, citation_kind string")
    got = P.upsert_page_symbols(cites([("p", "1", "x"), ("q", "1", "x"), ("r", "1", "x")]), cites([("p", "2", "y"), ("p", "2", "y")]), cites([("p", "", ""), ("r", "", "")])).collect()
    assert {tuple(r) for r in got} == {("q", "1", "x"), ("p", "2", "y")} and len(got) == 2
    rows = [{"node_id": f"s{i}", "wiki_id": "w", "rel_path": "a.py", "symbol_type": "function", "start_line": 10 - i} for i in range(5)] + [{"node_id": f"t{i}", "wiki_id": "w", "rel_path": "b.py", "symbol_type": "method", "parent_symbol": "AB"[i % 2]} for i in range(4)]
    parts = {r.node_id: r.part for r in P.split_files(nodes(spark, rows), 3).collect()}
    assert parts == {"s4": 0, "s3": 0, "s2": 0, "s1": 1, "s0": 1, "t0": 0, "t2": 0, "t1": 1, "t3": 1}


def test_pages_expand_within_budget(spark):
    rows = [{"node_id": x, "symbol_type": "class", "symbol_name": x, "rel_path": f"src/{x}.py", "macro_cluster": 2 if x == "far" else 1, "source_text": "x" * (4 * size)} for x, size in (("own", 5), ("big", 90), ("near", 40), ("weak", 50), ("tiny", 20), ("far", 1))]
    n = nodes(spark, [*rows, {"node_id": "t", "symbol_type": "class", "symbol_name": "t", "rel_path": "tests/t.py", "macro_cluster": 1, "source_text": "x"}])
    e = spark.createDataFrame([("own", "near", 5.0), ("big", "own", 4.0), ("own", "weak", 3.0), ("own", "tiny", 2.0), ("own", "far", 9.0), ("own", "t", 9.0), ("own", "near", None)], "source_id string, target_id string, weight double")
    m = spark.createDataFrame([("p", "own", 1)], "page_id string, node_id string, boundary int")
    assert {r.id for r in P.expand_pages(m, n, e, 100).collect()} == {"near", "weak"}
    assert {r.id for r in P.expand_pages(m.withColumn("boundary", F.lit(None).cast("int")), n, e, 10_000).collect()} == {"near", "big", "weak", "tiny", "far"}


def test_labels_and_steps(spark):
    n = nodes(spark, [{"node_id": "b", "symbol_name": "Load"}, {"node_id": "a", "symbol_name": "load"}, {"node_id": "c", "rel_path": "src/load.py"}, {"node_id": "d", "rel_path": "load"}])
    got = {r.label: (r.node_id, r.how, r.n_candidates) for r in P.resolve_labels(n, ["LOAD", "src/load.py", "nope"]).collect()}
    assert got == {"LOAD": ("a", "name", 2), "src/load.py": ("c", "path", 1)}
    e = spark.createDataFrame([(3, "a", "b", "calls", "INFERRED"), (7, "b", "a", "uses", None), (9, "a", "b", "reads", "EXTRACTED"), (1, "a", "a", "calls", None)], "id bigint, source_id string, target_id string, rel_type string, confidence string")
    assert [tuple(r) for r in P.best_edges(e).collect()] == [("a", "b", 7, "uses", False)]


def test_summaries(spark):
    d = spark.createDataFrame([(1, "w"), (2, "w"), (3, "v"), (4, None)], "doc_id int, wiki_id string")
    assert {tuple(r) for r in P.match_summary(d.where("doc_id = 1"), d, "wiki_id").collect()} == {("w", 1, 2, 0.5), ("v", 0, 1, 0.0)}
    assert {(r.scan, r.truncated) for r in P.scan_limits({"a": (d, 3), "b": (d, 4)}).collect()} == {("a", True), ("b", False)}
    e = spark.createDataFrame([("w", "k1"), ("w", "k1"), ("v", "k2"), ("v", "zz")], "wiki_id string, target_id string")
    p = spark.createDataFrame([("P", "k1"), ("P", "k2"), ("P", "k2")], "project_id string, node_id string")
    assert {tuple(r) for r in P.project_repositories(e, p).collect()} == {("P", "w", 2), ("P", "v", 1)}
    assert G.has_relation(spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([("a", "b", "extends")], "source_id string, target_id string, rel_type string"), "calls", "inherits").count() == 1
