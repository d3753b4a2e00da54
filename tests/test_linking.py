"""Linking passes on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from lodegraph import schema as S
from lodegraph.operators import enrichment as R
from lodegraph.operators import expansion as E
from lodegraph.operators import graph as G
from lodegraph.operators import linking as L
from lodegraph.plans import passes, structure
from tests.test_graph import edges


def nodes(spark, rows):
    """rows: dicts of node columns; extra text columns are kept in the view."""
    names = [f.name for f in S.NODE_SCHEMA]
    df = spark.createDataFrame([tuple(({"wiki_id": "w"} | r).get(c) for c in names) for r in rows], S.NODE_SCHEMA)
    return G.nodes_view(df, "source_text", "signature", "docstring")


def test_routes_and_surfaces(spark):
    py = '@app.get("/api/v1/users/{id}")\ndef f(): pass\nos.environ["TOKEN_KEY"]\n'
    java = '@PostMapping("/users/{user}")\npublic void f() {}'
    n = nodes(spark, [{"node_id": "a", "language": "python", "source_text": py}, {"node_id": "b", "language": "java", "source_text": java}, {"node_id": "c"}])
    got = {(r.node_id, r.surface) for r in L.rest_surfaces(n).collect()}
    assert got == {("a", "GET /api/v1/users/{}"), ("a", "GET /users/{}"), ("b", "POST /users/{}")}
    assert ("a", "env", "TOKEN_KEY") in {(r.node_id, r.kind, r.surface) for r in R.text_surfaces(n).collect()}
    shapes = {r.surface for r in R.object_shapes(nodes(spark, [{"node_id": "o", "source_text": "x = {userName: 1, 'id': 2}"}])).collect()}
    assert shapes == {"obj:id,user_name"}


def test_surface_links(spark):
    rows = [("a", "w", "py", "x/a", "rest", "GET /u", 0.8), ("b", "w", "js", "x/b", "rest", "GET /u", 0.8), ("c", "v", "py", "y/c", "rest", "GET /u", 0.8), ("d", "w", "py", None, "rest", "GET /v", 0.8)]
    s = spark.createDataFrame(rows, "node_id string, wiki_id string, language string, rel_path string, kind string, surface string, weight_hint double")
    assert [(r.language_a, r.language_b, r.source_id, r.target_id, r.n_links) for r in L.surface_links(s).collect()] == [("js", "py", "b", "a", 2)]
    assert {(r.language_a, r.language_b, r.n_links) for r in L.surface_links(s, False).collect()} == {("js", "py", 2), ("py", "py", 1)}
    assert {r.node_id: (r.n_other_language, r.n_other_repository) for r in L.surface_members(s).collect()} == {"a": (1, 1), "b": (2, 1), "c": (1, 2)}
    assert [(r.wiki_a, r.wiki_b, r.n_surfaces, r.n_links) for r in L.repository_links(s).collect()] == [("v", "w", 1, 2)]
    links = spark.createDataFrame([("a", "b", "* /u"), ("a", "b", "GET /u"), ("a", "c", "* /u"), ("a", "d", "* /z")], "source_id string, target_id string, surface string")
    left = {(r.source_id, r.target_id, r.surface) for r in R.without_verbless_twins(links).collect()}
    assert left == {("a", "b", "GET /u"), ("a", "c", "* /u"), ("a", "d", "* /z")}


def test_links_of_a_surface_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    rows = [(f"n{i:02}", "v" if i % 3 else "w", "py" if i % 2 else "js", f"x/n{i}", "name", "init", 0.3) for i in range(60)]
    s = spark.createDataFrame(rows, "node_id string, wiki_id string, language string, rel_path string, kind string, surface string, weight_hint double")
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0]]
    assert [(r.language_a, r.language_b, r.n_links) for r in L.surface_links(s).collect()] == [("js", "py", sum(a[2] != b[2] for a, b in pairs))]
    assert sum(r.n_links for r in L.surface_links(s, False).collect()) == len(pairs)
    assert [(r.n_surfaces, r.n_links) for r in L.repository_links(s).collect()] == [(1, sum(a[1] != b[1] for a, b in pairs))]
    assert sum(r.n_other_language for r in L.surface_members(s).collect()) == 2 * sum(a[2] != b[2] for a, b in pairs)


def test_members_of_like_parents(spark):
    rows = [{"node_id": "a", "language": "python", "parent_symbol": "UserStore", "symbol_name": "load_all"}, {"node_id": "b", "language": "java", "parent_symbol": "app.UserStore", "symbol_name": "loadAll"}, {"node_id": "c", "language": "java", "parent_symbol": "OtherStore", "symbol_name": "loadAll"}]
    got = L.surface_links(L.member_surfaces(nodes(spark, rows))).collect()
    assert [(r.surface, r.source_id, r.target_id, r.n_links) for r in got] == [("user_store.load_all", "b", "a", 1)]


def test_pages_of_a_target_that_many_share(spark):
    k = spark.createDataFrame([(i, "hot/read.me") for i in range(60)] + [(i, "a/b.py") for i in (3, 57)] + [(9, "only/one.py")], "source long, target string")
    got = {r.page: (r.class_id, r.n_targets, r.n_shared) for r in E.cocited(k).collect()}
    want = {i: (0, 1, 59) for i in range(60)} | {3: (3, 2, 60), 57: (3, 2, 60), 9: (9, 2, 59)}
    assert got == want


def test_all_repositories_are_scored(spark):
    rows = [{"node_id": f"n{i}", "wiki_id": f"w{i:02}", "symbol_name": "SharedName" if i > 57 else f"Name{i}", "symbol_type": "class", "language": "python", "rel_path": f"src/n{i}.py"} for i in range(60)]
    n = nodes(spark, rows)
    f = L.repository_features(n)
    assert {(r.wiki_a, r.wiki_b) for r in L.relatedness(f, L.repository_pairs(f)).collect()} == {(f"w{a:02}", f"w{b:02}") for a in range(60) for b in range(a + 1, 60)}
    links = L.repository_links(L.name_surfaces(n))
    assert [(r.wiki_a, r.wiki_b, r.n_links) for r in L.cross_repository(links, L.relatedness(f, links)).collect()] == [("w58", "w59", 1)]


def test_upsert_and_surfaces_of_all_nodes(spark, tmp_path):
    names = [f.name for f in S.NODE_SCHEMA]
    rows = [{"node_id": f"n{i}", "wiki_id": "w", "start_line": i, "rel_path": f"{i}.py", "symbol_name": f"s{i}"} for i in range(12)]
    rows[3]["source_text"] = 'os.environ["TOKEN_KEY"]\nlog.info("done")\nadd_argument("--deep")'
    spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], S.NODE_SCHEMA).write.parquet(f"{tmp_path}/repo_nodes.parquet")
    day = lambda n: dt.datetime(2024, 1, n)
    changes = [(1, "w", "n1", "modified", None, "old.py", day(1)), (2, "w", "n1", "moved", None, "new.py", day(2)), (3, "w", "n3", "deleted", None, "3.py", day(2)), (4, "w", "x", "added", None, "x.py", day(2)), (5, "w", "n5", "modified", None, None, day(1))]
    spark.createDataFrame(changes, "change_id bigint, wiki_id string, node_id string, change_kind string, content_hash string, rel_path string, changed_at timestamp").write.parquet(f"{tmp_path}/node_changes.parquet")
    want = {(f"n{i}", "new.py" if i == 1 else f"{i}.py", f"s{i}") for i in range(12)} | {("x", "x.py", None)}
    got = structure.write_node_upsert(spark, str(tmp_path)).collect()
    assert len(got) == 13 and {tuple(r) for r in got} == want
    assert {r.surface for r in passes.text_surfaces(spark, str(tmp_path)).collect()} == {"TOKEN_KEY", "done", "--deep"}


def test_references(spark):
    n = nodes(spark, [{"node_id": "1", "symbol_name": "Loader", "symbol_type": "class", "rel_path": "src/io/loader.py"}, {"node_id": "2", "symbol_type": "module", "rel_path": "src/io/loader.py"}])
    docs = spark.createDataFrame([(1, "see `pkg.Loader` and `Loader`, also [file](../io/loader.py#x) and `io/loader.py`"), (2, None)], "doc_key int, text string").where("text is not null")
    assert {(r.ref, r.target_id, r.how) for r in L.backtick_links(docs, n).collect()} == {("Loader", "1", "exact"), ("pkg.Loader", "1", "last_part")}
    assert {r.target_id for r in L.path_links(docs, n).collect()} == {"2"}
    cites = {(r.path, r.start_line, r.end_line) for r in R.citations(spark.createDataFrame([(1, "as in [src/a.py:3-9] or (b.go:7)")], "id int, t string"), "id", "t").collect()}
    assert cites == {("src/a.py", 3, 9), ("b.go", 7, 7)}


def test_wikilinks(spark):
    docs = spark.createDataFrame([(1, "[[Data Model]] [[Data Models|x]] [[Nothing alike]]")], "id int, t string")
    pages = spark.createDataFrame([("p1", "data-model"), ("p2", "query-language")], "page string, slug string")
    got = {r.target: (r.page, r.status) for r in R.resolve_wikilinks(docs, "id", "t", pages).collect()}
    assert got["Data Model"] == ("p1", "matched") and got["Data Models"] == ("p1", "matched") and got["Nothing alike"] == (None, "missing")


def test_test_links(spark):
    rows = [("t", "module", "tests/test_user.py", "test_user", None), ("u", "module", "src/user.py", "user", None), ("T", "class", "tests/x.py", "x", "UserServiceTest"), ("U", "class", "src/s.py", "s", "UserService")]
    n = nodes(spark, [{"node_id": i, "symbol_type": k, "rel_path": p, "file_name": f, "symbol_name": s, "language": "Python"} for i, k, p, f, s in rows])
    assert {(r.source_id, r.target_id, r.rel_type) for r in L.test_links(n).collect()} == {("t", "u", "test_link_same_stem"), ("T", "U", "test_link_class_proxy")}


def test_anchors_and_bridges(spark):
    n = nodes(spark, [{"node_id": i, "symbol_type": "class", "rel_path": p, "symbol_name": i} for i, p in (("a", "src/x/a.py"), ("b", "src/b.py"), ("c", "src/c.py"), ("lone", "src/x/y/l.py"), ("far", "z.py"), ("p", "q/p.py"), ("q", "q/q.py"))])
    e = edges(spark, [("a", "b", "calls", None), ("c", "b", "calls", None), ("p", "q", "calls", None)])
    got = {r.source_id: (r.target_id, r.levels_up) for r in L.directory_anchors(n, e).collect()}
    assert got == {"lone": ("a", 1)}
    assert {(r.source_id, r.target_id) for r in R.bridges(n, e).collect()} == {("far", "b"), ("lone", "b"), ("p", "b")}
    stages = {r.source_id: r.stage for r in R.orphan_cascade(n, e).collect()}
    assert stages.get("lone") == "directory"
    r = R.connectivity(n, e).first()
    assert (r.n_nodes, r.n_orphans, r.n_components, r.largest) == (7, 2, 4, 3)


def test_resolution(spark):
    n = nodes(spark, [{"node_id": "python::a.py::Foo", "symbol_name": "Foo", "symbol_type": "class", "rel_path": "a.py"}, {"node_id": "python::b.py::Foo", "symbol_name": "Foo", "symbol_type": "function", "rel_path": "b.py"}])
    want = spark.createDataFrame([("Foo",), ("b.py::Foo",), ("python::b.py::Foo",), ("nothing",)], "key string")
    assert {r.key: (r.node_id, r.kind) for r in R.resolve(n, want).collect()} == {
        "Foo": ("python::a.py::Foo", "name"), "b.py::Foo": ("python::b.py::Foo", "qualified"), "python::b.py::Foo": ("python::b.py::Foo", "id"),
    }


def test_short_texts(spark):
    d = spark.createDataFrame([("x" * 30 + "y" * 30,), ("short",), (None,)], "t string").select(R.middle_out(F.col("t"), 20, "|").alias("m")).collect()
    assert [r.m for r in d] == ["x" * 12 + "|" + "y" * 8, "short", None]
