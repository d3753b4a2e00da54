"""Full-text search: tokens, positional postings, BM25 over weighted columns, and a small query algebra."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published BM25 parameters.
K1, B = 1.2, 0.75
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of a text; no stemming; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def postings(docs: DataFrame, key: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The inverted index: (key, col, term, tf, positions, n_terms) and the `keep` columns. `search_index` stores it by term, to search without a scan."""
    keep = keep or []
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("words")) for c in columns]))
    rows = docs.select(key, *keep, each.alias("x")).select(key, *keep, "x.col", F.size("x.words").alias("n_terms"), F.posexplode("x.words").alias("pos", "term"))
    return rows.groupBy(key, *keep, "col", "term", "n_terms").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


# --- Query algebra --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Prefix:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Near:
    """Both words with at most `within` words between them, in any order."""

    a: str
    b: str
    within: int = 10


@dataclass(frozen=True)
class And:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default_factory=tuple)


def all_terms(text: str) -> And:
    return And(tuple(Term(t) for t in query_terms(text)))


def any_prefix(text: str) -> Or:
    return Or(tuple(Prefix(t) for t in query_terms(text)))


def parse_query(text: str):
    """Words are AND-ed; "..." is a phrase, word* a prefix, OR between parts makes them alternatives, a NEAR/n b nearness."""
    alternatives = []
    for part in re.split(r"\s+OR\s+", text.strip()):
        items = []
        for m in re.finditer(r'"([^"]*)"|(\S+)\s+NEAR/(\d+)\s+(\S+)|(\S+)', part):
            if m[1] is not None:
                words = tuple(query_terms(m[1]))
                items += [Phrase(words)] if len(words) > 1 else [Term(w) for w in words]
            elif m[2]:
                a, b = query_terms(m[2]), query_terms(m[4])
                if a and b:
                    items.append(Near(a[0], b[0], int(m[3])))
            elif m[5].endswith("*"):
                items += [Prefix(w) for w in query_terms(m[5])]
            elif m[5] != "AND":
                items += [Term(w) for w in query_terms(m[5])]
        alternatives.append(items[0] if len(items) == 1 else And(tuple(items)))
    return alternatives[0] if len(alternatives) == 1 else Or(tuple(alternatives))


def matches(words: Column, query) -> Column:
    """Whether a token array satisfies a query. Stays in the JVM; no shuffle."""
    if isinstance(query, Term):
        return F.array_contains(words, query.word)
    if isinstance(query, Prefix):
        return F.exists(words, lambda t: t.startswith(query.word))
    if isinstance(query, Phrase):
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.contains(joined, F.lit(" " + " ".join(query.words) + " "))
    if isinstance(query, Near):
        at = lambda w: F.filter(F.transform(words, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())
        return F.exists(at(query.a), lambda i: F.exists(at(query.b), lambda j: (F.abs(i - j) <= query.within + 1) & (i != j)))
    if not query.parts:
        return F.lit(False)
    parts = [matches(words, p) for p in query.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(query, And) else out | p
    return out


def leaves(query) -> list:
    """Term and prefix leaves that are scored; the words of phrases and nearness count as terms."""
    if isinstance(query, (Term, Prefix)):
        return [query]
    if isinstance(query, Phrase):
        return [Term(w) for w in query.words]
    if isinstance(query, Near):
        return [Term(query.a), Term(query.b)]
    return list(dict.fromkeys(x for p in query.parts for x in leaves(p)))


# --- BM25 -----------------------------------------------------------------------------------------------------------
def bm25(docs: DataFrame, key: str, weights: dict[str, float], query, keep: list[str] | None = None, require: bool = True) -> DataFrame:
    """`key`, `keep` columns and `score` of documents that match a query.

    Term frequencies of the columns are summed with their weights, lengths are summed plainly. Document frequencies
    and the mean length come from all documents of `docs`; filter afterwards to narrow the result, beforehand to
    narrow the corpus. With require=False a document needs one scored term only. No explode and no shuffle of texts:
    one pass counts, a second one scores.
    """
    scored = leaves(query)
    arrays = {c: tokens(F.col(c)) for c in weights}
    base = docs.select(key, *[F.col(c) for c in (keep or []) if c != key], *[a.alias(f"_w_{c}") for c, a in arrays.items()])
    every = F.concat(*[F.col(f"_w_{c}") for c in weights])

    def hits(words: Column, leaf) -> Column:
        return F.size(F.filter(words, lambda t: (t == leaf.word) if isinstance(leaf, Term) else t.startswith(leaf.word)))

    tf = [sum((hits(F.col(f"_w_{c}"), leaf) * w for c, w in weights.items()), F.lit(0.0)) for leaf in scored]
    counted = base.withColumns({"_dl": F.size(every), **{f"_tf{i}": t for i, t in enumerate(tf)}})
    totals = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(scored))])
    joined = counted.where(matches(every, query) if require else F.greatest(*[F.col(f"_tf{i}") for i in range(len(scored))], F.lit(0.0)) > 0).crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(scored)):
        df, f = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return joined.select(key, *[c for c in (keep or []) if c != key], score.alias("score"))


def top(found: DataFrame, key: str, k: int) -> DataFrame:
    return found.orderBy(F.desc("score"), key).limit(k)


#: What the columns of a symbol weigh.
SYMBOL_WEIGHTS = {"symbol_name": 10.0, "signature": 4.0, "docstring": 2.0, "source_text": 1.0}
#: Columns that a search may be held to.
SEARCHABLE = tuple(SYMBOL_WEIGHTS)


def search_in_path(nodes: DataFrame, query, path: str, weights: dict[str, float] | None = None) -> DataFrame:
    """BM25 over the nodes of a folder; statistics come from all nodes, the filter stands before any limit. An empty path is an error."""
    if not (path or "").strip("/"):
        raise ValueError("a path is required")
    found = bm25(nodes, "node_id", weights or SYMBOL_WEIGHTS, query, ["rel_path", "symbol_name", "symbol_type", "language"])
    return found.where(F.col("rel_path").startswith(path.strip("/")))


def search_by_name(nodes: DataFrame, name: str, architectural: bool = True) -> DataFrame:
    """Symbols whose name holds the words of `name` in a row; the fallback where no symbol has the exact name."""
    words = tuple(query_terms(name))
    query = Phrase(words) if len(words) > 1 else And(tuple(Term(w) for w in words))
    some = nodes.where("is_architectural") if architectural else nodes
    return bm25(some, "node_id", {"symbol_name": 1.0}, query, ["symbol_name"])


def search_with_retry(docs: DataFrame, key: str, weights: dict[str, float], text: str, keep: list[str] | None = None) -> DataFrame:
    """The query as written; if nothing matches, any of its words as a prefix."""
    first = bm25(docs, key, weights, parse_query(text), keep)
    return first if first.limit(1).count() else bm25(docs, key, weights, any_prefix(text), keep)


def smart_query(text: str, intent: str = "general"):
    """A question as a query by what it is after: 'symbol' (the identifier's parts in its name), 'concept' or 'doc' (content words), 'general' (both, as prefixes)."""
    from lodegraph.functions.questions import keywords

    words = list(dict.fromkeys(t for w in keywords(text) for t in query_terms(w)))
    if not words:
        return any_prefix(text)
    if intent == "symbol":
        return Or(tuple(Term(w) for w in words))
    return Or(tuple((Term if intent in ("concept", "doc") else Prefix)(w) for w in words))


#: Columns that an intent weighs more.
INTENT_WEIGHTS = {"symbol": {"symbol_name": 10.0}, "doc": {"docstring": 4.0, "source_text": 1.0}}


def search_smart(nodes: DataFrame, text: str, intent: str = "general", types: list[str] | None = None, without: list[str] | None = None, language: str | None = None, path: str | None = None) -> DataFrame:
    """Symbols for a question, by intent, with filters before any limit: types, types left out, language, path."""
    found = bm25(nodes, "node_id", INTENT_WEIGHTS.get(intent, SYMBOL_WEIGHTS), smart_query(text, intent), ["symbol_name", "symbol_type", "language", "rel_path"])
    if types:
        found = found.where(F.col("symbol_type").isin(types))
    if without:
        found = found.where(~F.col("symbol_type").isin(without))
    if language:
        found = found.where(F.col("language") == language.lower())
    return found.where(F.col("rel_path").startswith(path.strip("/"))) if path else found


def low_value(query: Column) -> Column:
    """Whether a text is too common a name to search by: shorter than four characters, or a word without content."""
    from lodegraph.functions.questions import EMPTY_WORDS

    bare = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    return (F.length(bare) < 4) | bare.isin(*sorted(EMPTY_WORDS))


def score_norm(score: Column) -> Column:
    """Score brought to 0..1, growing with it."""
    return score / (1 + score)


def score_norm_compat(score: Column) -> Column:
    """1 / (1 + |score|), which falls as the match gets better; kept for callers of the older meaning."""
    return 1 / (1 + F.abs(score))


def inverse_frequency(docs: DataFrame, column: str, words: list[str]) -> DataFrame:
    """ln(N / (1 + df)) of each word."""
    w = tokens(F.col(column))
    counts = docs.select(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.array_contains("w", x).cast("long")).alias(f"d{i}") for i, x in enumerate(words)])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("word"), F.col(f"d{i}").alias("df")) for i, x in enumerate(words)]))
    return counts.select("n", each.alias("x")).select("x.word", "x.df", F.log(F.col("n") / (1 + F.col("x.df"))).alias("idf"))


def grep(docs: DataFrame, key: str, column: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(key, line_no, line) of every line that a regular expression finds."""
    lines = docs.select(key, F.posexplode(F.split(F.col(column), "\r\n|\n|\r")).alias("at", "line"))
    return lines.where(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)).select(key, (F.col("at") + 1).alias("line_no"), "line")


def name_score(name: Column, doc: Column, text: str) -> Column:
    """Brute-force score: 100 for the name itself, 50 for a part of it, else 10 a keyword in the name and 3 one in the doc."""
    low = text.lower()
    n, d = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(doc, F.lit("")))
    words = F.lit(0.0)
    for t in query_terms(text):
        words = words + F.when(F.contains(n, F.lit(t)), 10.0).when(F.contains(d, F.lit(t)), 3.0).otherwise(0.0)
    return F.when(n == low, 100.0).when(F.contains(n, F.lit(low)), 50.0).otherwise(words)
