"""Queries of the language, full-text, vector and hybrid search, and traversal, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.functions import jql as J
from lodegraph.operators import fusion as Z
from lodegraph.operators import graph as G
from lodegraph.operators import text as T
from lodegraph.operators import traverse as P
from lodegraph.operators import vectors as V
from lodegraph.plans.compile import compile_query
from lodegraph.plans.prelude import COMPONENTS, WITH, WITHR
from lodegraph.plans.structure import LAYER_SQL
from lodegraph.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_DEG = "d as (select node_id, count(*) as degree from (select source_id as node_id from e union all select target_id from e) group by 1)"
_OUT = "select n.node_id, symbol_name, symbol_type, rel_path, coalesce(degree, 0) as degree from n left join d on d.node_id = n.node_id"
_ORDER = "order by coalesce(degree, 0) desc, n.node_id"


def _jql(s, d, text, *extra, **kw):
    n, e = G.graph(s, d, extra)
    return compile_query(text, n, e, **kw)


# --- Query language -------------------------------------------------------------------------------------------------
@query("jql_type_connections", f"{WITH}, {_DEG} {_OUT} where symbol_type = 'class' and coalesce(degree, 0) > 10 {_ORDER} limit 50")
def jql_type_connections(s, d):
    return _jql(s, d, "type:class connections:>10 limit:50")


@query("jql_types_file_glob", f"{WITH}, {_DEG} {_OUT} where symbol_type in ('class', 'function') and rel_path like 'src/%/core/%' {_ORDER} limit 100")
def jql_types_file_glob(s, d):
    return _jql(s, d, "type:class OR type:function file:src/*/core/* limit:100")


@query("jql_name", f"{WITH}, {_DEG} {_OUT} where lower(symbol_name) like 'index%' {_ORDER} limit 500")
def jql_name(s, d):
    return _jql(s, d, "name:index* limit:500")


@query("jql_layer", f"{WITH}, {_DEG} {_OUT} where {LAYER_SQL} = 'infrastructure' and symbol_type = 'class' {_ORDER} limit 20")
def jql_layer(s, d):
    return _jql(s, d, "layer:infrastructure type:class")


@query("jql_text", f"{WITH}, {_DEG} {_OUT} where list_contains(regexp_split_to_array(lower(concat_ws(' ', symbol_name, signature, docstring, source_text)), '[^\\p{{L}}\\p{{N}}]+'), 'ledger') and symbol_type = 'method' {_ORDER} limit 200")
def jql_text(s, d):
    return _jql(s, d, "text:ledger type:method limit:200", "signature", "docstring", "source_text")


_REACH = """a as (select node_id from n where lower(symbol_name) = (select lower(min(symbol_name)) from n where symbol_type = 'class')), st as (select distinct source_id as h, target_id as t from e union select target_id, source_id from e),
r(node_id, hop) as (select node_id, 0 from a union select st.t, hop + 1 from r join st on st.h = r.node_id where hop < 3)"""


@query("jql_related", f"{WITHR}, {_REACH}, {_DEG} {_OUT} where n.node_id in (select node_id from r where hop > 0 and node_id not in (select node_id from a)) {_ORDER} limit 500")
def jql_related(s, d):
    first = G.nodes_view(table(s, d, "repo_nodes")).where("symbol_type = 'class'").agg(F.min("symbol_name")).first()[0]
    return _jql(s, d, f'related:"{first}" dir:both limit:500')


@query("jql_has_rel", f"{WITH}, {_DEG} {_OUT} where symbol_type = 'function' and n.node_id in (select source_id from e where rel_type in ('creates', 'constructs') union select target_id from e where rel_type in ('creates', 'constructs')) {_ORDER} limit 300")
def jql_has_rel(s, d):
    return _jql(s, d, "has_rel:constructs type:function limit:300")


@query("jql_has_any_rel", f"{WITH}, {_DEG} {_OUT} where symbol_type = 'method' and n.node_id in (select unnest([source_id, target_id]) from e where rel_type in ('creates', 'constructs', 'inheritance', 'inherits', 'extends')) {_ORDER} limit 300")
def jql_has_any_rel(s, d):
    return _jql(s, d, "has_rel:creates has_rel:EXTENDS type:method limit:300")


@query("jql_layer_any_case", f"{WITH}, {_DEG} {_OUT} where {LAYER_SQL} = 'core_type' and coalesce(degree, 0) >= 3 {_ORDER} limit 100")
def jql_layer_any_case(s, d):
    return _jql(s, d, "layer:Core_Type connections:>=3 limit:100")


@query("jql_or_strict_off", f"{WITH}, {_DEG} {_OUT} where symbol_type = 'struct' or rel_path like 'tests/%' {_ORDER} limit 500")
def jql_or_strict_off(s, d):
    return _jql(s, d, "type:struct OR file:tests limit:500", strict=False)


@query("natural_language", f"{WITH}, {_DEG} {_OUT} where symbol_type = 'class' and rel_path like 'web/%' and n.node_id in (select source_id from e where rel_type in ('inheritance', 'inherits', 'extends') union select target_id from e where rel_type in ('inheritance', 'inherits', 'extends')) {_ORDER} limit 20")
def natural_language(s, d):
    return _jql(s, d, J.parse_question("classes in web/ that extend").to_jql())


# --- Full text ------------------------------------------------------------------------------------------------------
def _bm25_sql(source: str, key: str, cols: dict[str, float], terms: list[str], where: str, keep: str = "") -> str:
    tok = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    k = f", {keep}" if keep else ""
    tf = [" + ".join(f"{w} * len(list_filter(w_{c}, lambda t: t = '{t}'))" for c, w in cols.items()) for t in terms]
    tfs = ", ".join(f"{x} as tf{i}" for i, x in enumerate(tf))
    dfs = ", ".join(f"sum(case when tf{i} > 0 then 1 else 0 end) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (nn - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    toks = ", ".join(f"{tok(c)} as w_{c}" for c in cols)
    length = " + ".join(f"len(w_{c})" for c in cols)
    return f"""tk as (select {key}{k}, {toks} from {source}), f as (select {key}{k}, {length} as dl, {tfs} from tk), t as (select count(*) as nn, avg(dl) as avgdl, {dfs} from f)
select {key}{k}, round({score}, 6) as score from f, t where {where} order by {score} desc, {key} limit 30"""


def _scored(df, key):
    return T.top(df, key, 30).withColumn("score", F.round("score", 6))


@query("bm25_documents", "with " + _bm25_sql("documents", "doc_id", {"text": 1.0}, ["ledger", "snapshot"], "tf0 > 0 and tf1 > 0"))
def bm25_documents(s, d):
    return _scored(T.bm25(table(s, d, "documents"), "doc_id", {"text": 1.0}, T.all_terms("ledger snapshot")), "doc_id")


@query("bm25_any_term", "with " + _bm25_sql("documents", "doc_id", {"text": 1.0}, ["quarantine", "beacon"], "tf0 > 0 or tf1 > 0", "lang"))
def bm25_any_term(s, d):
    return _scored(T.bm25(table(s, d, "documents"), "doc_id", {"text": 1.0}, T.parse_query("quarantine OR beacon"), ["lang"]), "doc_id")


_W = {"symbol_name": 10.0, "signature": 4.0, "docstring": 2.0, "source_text": 1.0}


@query("bm25_symbols_weighted", f"{WITH}, " + _bm25_sql("n", "node_id", _W, ["voucher"], "tf0 > 0 and symbol_type = 'function'", "symbol_type"))
def bm25_symbols_weighted(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"), "signature", "docstring", "source_text")
    return _scored(T.bm25(n, "node_id", _W, T.Term("voucher"), ["symbol_type"]).where("symbol_type = 'function'"), "node_id")


@query("fts_column_scoped", f"{WITH}, " + _bm25_sql("n", "node_id", {"docstring": 1.0}, ["cache"], "tf0 > 0"))
def fts_column_scoped(s, d):
    return _scored(T.bm25(G.nodes_view(table(s, d, "repo_nodes"), "docstring"), "node_id", {"docstring": 1.0}, T.Term("cache")), "node_id")


@query("fts_phrase_count", "select count(*) as n_docs from documents where contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') || ' ', ' by hand ')")
def fts_phrase_count(s, d):
    return table(s, d, "documents").where(T.matches(T.tokens(F.col("text")), T.Phrase(("by", "hand")))).agg(F.count(F.lit(1)).alias("n_docs"))


@query("fts_prefix", "select doc_id from documents where len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: starts_with(t, 'quarant'))) > 0")
def fts_prefix(s, d):
    return table(s, d, "documents").where(T.matches(T.tokens(F.col("text")), T.parse_query("quarant*"))).select("doc_id")


@query(
    "fts_near",
    """with p as (select doc_id, unnest(w) as t, unnest(range(len(w))) as i from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') as w from documents))
select distinct a.doc_id from p a join p b on a.doc_id = b.doc_id where a.t = 'cache' and b.t = 'queue' and abs(a.i - b.i) <= 11""",
)
def fts_near(s, d):
    return table(s, d, "documents").where(T.matches(T.tokens(F.col("text")), T.parse_query("cache NEAR/10 queue"))).select("doc_id")


@query(
    "fts_postings",
    """with p as (select doc_id, unnest(w) as term, len(w) as n_terms from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') as w from documents))
select doc_id, term, n_terms, count(*) as tf from p where term in ('secret', 'vault', 'beacon') group by 1, 2, 3""",
)
def fts_postings(s, d):
    return T.postings(table(s, d, "documents"), "doc_id", ["text"]).where(F.col("term").isin("secret", "vault", "beacon")).select("doc_id", "term", F.col("n_terms").cast("long").alias("n_terms"), "tf")


@query(
    "symbol_idf",
    f"{WITH}, t as (select regexp_split_to_array(lower(coalesce(symbol_name, '')), '[^\\p{{L}}\\p{{N}}]+') as w from n) select word, (select count(*) from t where list_contains(w, word)) as df, round(ln((select count(*) from t) / (1 + (select count(*) from t where list_contains(w, word)))), 6) as idf from (values ('constructor'), ('init'), ('nosuchname')) v(word)",
)
def symbol_idf(s, d):
    return T.inverse_frequency(G.nodes_view(table(s, d, "repo_nodes")), "symbol_name", ["constructor", "init", "nosuchname"]).withColumn("idf", F.round("idf", 6))


@query(
    "brute_force_names",
    f"""{WITH}, {_DEG}, r as (select n.node_id, case when lower(coalesce(symbol_name, '')) = 'cache' then 100.0 when contains(lower(coalesce(symbol_name, '')), 'cache') then 50.0
when contains(lower(coalesce(docstring, '')), 'cache') then 3.0 else 0.0 end as score, coalesce(degree, 0) as degree from n left join d on d.node_id = n.node_id) select * from r where score > 0 order by score desc, degree desc, node_id limit 40""",
)
def brute_force_names(s, d):
    n, e = G.graph(s, d, ("docstring",))
    got = G.with_degree(n, e).select("node_id", T.name_score(F.col("symbol_name"), F.col("docstring"), "cache").alias("score"), "degree")
    return got.where("score > 0").orderBy(F.desc("score"), F.desc("degree"), "node_id").limit(40)


@query("grep_lines", f"{WITH}, l as (select node_id, unnest(regexp_split_to_array(source_text, '\\r\\n|\\n|\\r')) as line, unnest(range(1, len(regexp_split_to_array(source_text, '\\r\\n|\\n|\\r')) + 1)) as line_no from n where symbol_type = 'module' and source_text is not null) select node_id, line_no, line from l where regexp_matches(line, 'logger\\.info.*cache')")
def grep_lines(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"), "source_text").where("symbol_type = 'module'")
    return T.grep(n, "node_id", "source_text", r"logger\.info.*cache").select("node_id", F.col("line_no").cast("long").alias("line_no"), "line")


# --- Vectors --------------------------------------------------------------------------------------------------------
@query("knn_l2", "with q as (select embedding as v from embeddings order by vec_id limit 1) select vec_id, round(list_distance(embedding::double[], v::double[]), 4) as distance from embeddings, q order by list_distance(embedding::double[], v::double[]), vec_id limit 10")
def knn_l2(s, d):
    v = table(s, d, "embeddings").withColumnRenamed("embedding", "e").select("vec_id", F.col("e").alias("embedding"))
    q = v.orderBy("vec_id").first().embedding
    return V.nearest(v, "vec_id", q, 10).withColumn("distance", F.round("distance", 4))


@query("knn_filtered", "with q as (select embedding as v from embeddings order by vec_id limit 1) select vec_id, round(list_distance(embedding::double[], v::double[]), 4) as distance from embeddings, q where label = 3 order by list_distance(embedding::double[], v::double[]), vec_id limit 10")
def knn_filtered(s, d):
    v = table(s, d, "embeddings")
    q = v.orderBy("vec_id").first().embedding
    return V.nearest(v.where("label = 3"), "vec_id", q, 10).withColumn("distance", F.round("distance", 4))


#: The search form: queries are the rows whose id is divisible by 50, against all rows.
@query(
    "knn_batch_cosine",
    """with q as (select vec_id as query, embedding as v from embeddings where vec_id % 50 = 0), r as (select query, vec_id, 1 - list_cosine_similarity(embedding, v) as dist from q, embeddings where query <> vec_id)
select query, vec_id, round(dist, 4) as distance, position from (select *, row_number() over (partition by query order by dist, vec_id) as position from r) where position <= 5""",
)
def knn_batch_cosine(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.batch_nearest(v, v.where("vec_id % 50 = 0"), "vec_id", 5).select("query", "vec_id", F.round("distance", 4).alias("distance"), F.col("position").cast("long").alias("position"))


# --- Fusion ---------------------------------------------------------------------------------------------------------
_A = "a as (select wiki_id as id, row_number() over (order by count(*) desc, wiki_id) as rank from n group by 1 qualify rank <= 30)"
_B = "b as (select wiki_id as id, row_number() over (order by count(distinct rel_path) desc, wiki_id) as rank from n where symbol_type <> 'module' group by 1 qualify rank <= 30)"


def _two_lists(s, d):
    n = G.nodes_view(table(s, d, "repo_nodes"))
    a = n.groupBy(F.col("wiki_id").alias("id")).agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    b = n.where("symbol_type <> 'module'").groupBy(F.col("wiki_id").alias("id")).agg(F.count_distinct("rel_path").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return Z.ranked(a, "id", "score"), Z.ranked(b, "id", "score")


@query("rrf_weighted", f"{WITH}, {_A}, {_B} select coalesce(a.id, b.id) as id, round(coalesce(0.4 / (60 + a.rank), 0) + coalesce(0.6 / (60 + b.rank), 0), 9) as score from a full join b on a.id = b.id")
def rrf_weighted(s, d):
    return Z.rrf(list(_two_lists(s, d)), "id", [0.4, 0.6]).withColumn("score", F.round("score", 9))


@query("rrf_plain", f"{WITH}, {_A}, {_B} select coalesce(a.id, b.id) as id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) as score from a full join b on a.id = b.id")
def rrf_plain(s, d):
    return Z.rrf(list(_two_lists(s, d)), "id").withColumn("score", F.round("score", 9))


@query("hybrid_search")
def hybrid_search(s, d):
    """BM25 over symbols and nearest vectors to the best hit's vector, fused 0.4 / 0.6."""
    n = G.nodes_view(table(s, d, "repo_nodes"), "signature", "docstring")
    words = T.top(T.bm25(n, "node_id", {"symbol_name": 10.0, "signature": 4.0, "docstring": 2.0}, T.Term("cache")), "node_id", 30)
    vec = table(s, d, "repo_vec").where("embedding is not null").groupBy("node_id").agg(F.max("embedding").alias("embedding"))
    q = vec.orderBy("node_id").first()
    near = V.nearest(vec, "node_id", q.embedding, 30) if q else vec.select("node_id", F.lit(0.0).alias("distance"))
    fused = Z.rrf([Z.ranked(words, "node_id", "score"), Z.ranked(near, "node_id", "distance", True)], "node_id", [0.4, 0.6])
    return fused.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "node_id").limit(20)


@query(
    "fused_documents",
    f"""{WITH}, l as (select lower(symbol_name) as name, node_id as doc, row_number() over (order by start_line desc nulls last, node_id) as rank, 'long' as list from n where symbol_type = 'class' qualify rank <= 40
union all select lower(symbol_name), node_id, row_number() over (order by node_id) as rank, 'first' from n where symbol_type = 'class' qualify rank <= 40)
select name, round(sum(1.0 / (60 + rank)), 9) as score, min(rank) as best_rank, (array_agg(doc order by rank, list, doc))[1] as doc, array_to_string(list_sort(list_distinct(list(list))), ',') as lists from l group by 1""",
)
def fused_documents(s, d):
    c = G.nodes_view(table(s, d, "repo_nodes")).where("symbol_type = 'class'").select("symbol_name", F.col("node_id").alias("doc"), "start_line")
    rank = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long").alias("rank")
    a = c.orderBy(F.desc_nulls_last("start_line"), "doc").limit(40).select("symbol_name", "doc", rank(F.desc_nulls_last("start_line"), "doc"))
    b = c.orderBy("doc").limit(40).select("symbol_name", "doc", rank("doc"))
    return Z.fuse_documents({"long": a, "first": b}).withColumn("score", F.round("score", 9))


@query(
    "diversified",
    f"""{WITH}, {_DEG}, r as (select wiki_id, n.node_id, coalesce(degree, 0) as degree, row_number() over (partition by wiki_id order by coalesce(degree, 0) desc, n.node_id) as turn from n left join d on d.node_id = n.node_id where symbol_type = 'class')
select wiki_id, node_id, degree, turn from r order by turn, degree desc, wiki_id, node_id limit 40""",
)
def diversified(s, d):
    n, e = G.graph(s, d)
    return Z.round_robin(G.with_degree(n.where("symbol_type = 'class'"), e), "wiki_id", "node_id", "degree", 40).withColumn("turn", F.col("turn").cast("long"))


@query("token_budget")
def token_budget(s, d):
    """Functions of each repository that fit into 2 000 estimated tokens, in order of degree."""
    from lodegraph.functions.scalars import token_estimate

    n, e = G.graph(s, d, ("source_text",))
    f = G.with_degree(n.where("symbol_type = 'function'"), e)
    rank = F.row_number().over(Window.partitionBy("wiki_id").orderBy(F.desc("degree"), "node_id"))
    return Z.within_budget(f.select("wiki_id", F.col("node_id").alias("id"), rank.cast("long").alias("rank"), token_estimate(F.col("source_text")).alias("tokens")), "wiki_id", 2000)


# --- Traversal ------------------------------------------------------------------------------------------------------
_SEED = "sd as (select node_id from n where symbol_type = 'class' order by node_id limit 5)"


def _seeds(n):
    return n.where("symbol_type = 'class'").select("node_id").orderBy("node_id").limit(5)


@query(
    "neighbours_out",
    f"""{WITHR}, {_SEED}, st as (select distinct source_id as h, target_id as t from e), r(seed, node_id, hop) as (select node_id, node_id, 0 from sd union select r.seed, st.t, hop + 1 from r join st on st.h = r.node_id where hop < 2)
select seed, node_id, min(hop) as hop from r where node_id <> seed group by 1, 2""",
)
def neighbours_out(s, d):
    n, e = G.graph(s, d)
    return P.reach(e, _seeds(n), 2, "out").withColumn("hop", F.col("hop").cast("long"))


@query(
    "neighbours_both",
    f"""{WITHR}, {_SEED}, st as (select distinct source_id as h, target_id as t from e union select target_id, source_id from e), r(seed, node_id, hop) as (select node_id, node_id, 0 from sd union select r.seed, st.t, hop + 1 from r join st on st.h = r.node_id where hop < 2)
select seed, node_id, min(hop) as hop from r where node_id <> seed group by 1, 2""",
)
def neighbours_both(s, d):
    n, e = G.graph(s, d)
    return P.reach(e, _seeds(n), 2, "both").withColumn("hop", F.col("hop").cast("long"))


@query(
    "relationships",
    f"""{WITHR}, {_SEED}, g as (select * from e where coalesce(confidence, 'EXTRACTED') in ('EXTRACTED', 'INFERRED')), r(node_id, hop) as (select node_id, 0 from sd union select g.target_id, hop + 1 from r join g on g.source_id = r.node_id where hop < 1)
select g.source_id, g.target_id, g.rel_type, min(r.hop) + 1 as hop from g join r on r.node_id = g.source_id group by 1, 2, 3""",
)
def relationships(s, d):
    n, e = G.graph(s, d)
    return P.relationships(e, _seeds(n), 2, "out", "INFERRED").withColumn("hop", F.col("hop").cast("long"))


@query("shortest_path")
def shortest_path(s, d):
    """From the first class to the last module: any shortest path, so checked against brute force in the tests."""
    n, e = G.graph(s, d)
    ends = n.agg(F.min(F.when(F.col("symbol_type") == "class", F.col("node_id"))).alias("a"), F.max(F.when(F.col("symbol_type") == "module", F.col("node_id"))).alias("b")).first()
    return P.shortest_path(e, ends.a, ends.b)


@query("components", f"{WITHR}, {COMPONENTS} select node_id, component from cp")
def components(s, d):
    return P.components(*G.graph(s, d))


@query("pagerank")
def pagerank(s, d):
    n, e = G.graph(s, d)
    return P.pagerank(e).select("node_id", F.round("rank", 9).alias("rank"))
