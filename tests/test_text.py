import math

from pyspark.sql import functions as F

from lodegraph.functions import markdown as M
from lodegraph.functions import scalars as X
from lodegraph.operators import fusion as Z
from lodegraph.operators import text as T
from lodegraph.operators import vectors as V
from lodegraph.plans import context


def docs(spark):
    rows = [(1, "Grüße an die Welt, world peace"), (2, "the world is round; world cup"), (3, None), (4, ""), (5, "peace now")]
    return spark.createDataFrame(rows, "id int, text string")


def test_queries(spark):
    d = docs(spark)
    find = lambda q: {r.id for r in d.where(T.matches(T.tokens(F.col("text")), T.parse_query(q))).collect()}
    assert find("world") == {1, 2} and find("world peace") == {1} and find("round OR peace") == {1, 2, 5}
    assert find('"world cup"') == {2} and find("gr*") == {1} and find("world NEAR/0 peace") == {1} and find("the NEAR/1 cup") == set()


def test_bm25_formula(spark):
    got = {r.id: r.score for r in T.bm25(docs(spark), "id", {"text": 1.0}, T.Term("world")).collect()}
    n, df, avg = 5, 2, (6 + 6 + 0 + 0 + 2) / 5
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert abs(got[2] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 6 / avg))) < 1e-9 and got[2] > got[1]
    assert T.bm25(docs(spark).limit(0), "id", {"text": 1.0}, T.Term("x")).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, embedding array<float>")
    assert [r.id for r in V.nearest(v, "id", [1.0, 0.0], 2).collect()] == [1, 2]
    pairs = {(r["query"], r.id) for r in V.batch_nearest(v, v.where("id = 1"), "id", 1).collect()}
    assert pairs == {(1, 2)}


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r.id: r.score for r in Z.rrf([a, b], "id").collect()}
    assert abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-12 and got["y"] > got["x"]
    rows = spark.createDataFrame([("g", 1, "a", 60), ("g", 2, "b", 50), ("g", 3, "c", 40)], "g string, rank int, id string, tokens int")
    assert {r.id for r in Z.within_budget(rows, "g", 100).collect()} == {"a", "c"}
    tiers = {r.id: r.tier for r in Z.tiered_budget(spark.createDataFrame([("g", 3.0, "a", 40_000), ("g", 2.0, "b", 20_000)], "g string, score double, id string, tokens int"), "g").collect()}
    assert tiers == {"a": 1, "b": 2}


def test_scalars(spark):
    d = spark.createDataFrame([("a\r\nb  \n\n", "HTTPServerName2x", "src/tests/a_test.go", "FooTests")], "t string, n string, p string, c string")
    r = d.select(
        X.normalised(F.col("t")).alias("t"), X.name_tokens(F.col("n")).alias("n"), X.is_test_path(F.col("p")).alias("p"), X.path_prefix(F.col("p"), 1).alias("d"), X.strip_test_class(F.col("c")).alias("c"),
        X.ancestor_dirs(F.col("p")).alias("up"), X.slug(F.lit("  Größe & Co. ")).alias("s"), X.is_vendored_path(F.lit("third_party/x.c")).alias("v"),
    ).first()
    assert r.t == "a\nb" and r.n == ["http", "server", "name2x"] and r.p and r.d == "src" and r.c == "Foo"
    assert r.up == ["src/tests", "src"] and r.s == "grosse-co" or r.s == "grose-co"
    assert r.v


def test_chunks():
    text = "intro\n# One\ntext\n```\n# not a heading\n```\n## Two\nmore"
    got = M.chunk(text, "k")
    assert [c[2] for c in got] == ["", "One", "Two"] and "not a heading" in got[1][3]
    assert got == M.chunk(text, "k") and M.chunk("plain", "k")[0][3] == "plain"
    assert [len(c[3].splitlines()) for c in M.chunk_plain("\n".join("x" * 65), "k")] == [30, 30, 5]


def test_markdown(spark):
    t = "---\ntitle: \"A page\"\n---\n# H\n\nFirst words [x](a.md#b) [[Other|label]] `[no](no.md)`\n"
    r = spark.createDataFrame([(t,)], "t string").select(M.front_value(F.col("t"), "title").alias("f"), M.links(F.col("t")).alias("l"), M.wikilinks(F.col("t")).alias("w"), M.first_paragraph(F.col("t")).alias("p")).first()
    assert r.f == "A page" and r.l == ["a.md#b"] and r.w == ["Other"] and r.p.startswith("First words")


def test_all_documents_have_headings_and_chunks(spark, tmp_path):
    fenced = "# One\n```sh\n# no heading\n```\n## Two\n~~~\n## none\n~~~\ntext"
    rows = [(1, "readme", "no heading"), (2, "confluence", fenced), (3, "jira", "plain"), (4, "qa_answer", "answer"), (5, "commit_log", "fix"), (6, None, "lost"), (7, "changelog", "# News\nold"), (8, "jira", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_headings for r in context.markdown_headings(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}
    assert sorted((r.doc_id, r.heading) for r in context.markdown_chunks(spark, str(tmp_path)).collect()) == [(1, ""), (2, "One"), (2, "Two"), (7, "News")]
    assert sorted(r.doc_id for r in context.plain_chunks(spark, str(tmp_path)).collect()) == [3, 4, 5, 6]
