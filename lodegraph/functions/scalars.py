"""Column functions: paths, names, hashes, predicates and classes. All stay inside whole-stage code generation."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph import schema as S


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


# --- Paths and names ------------------------------------------------------------------------------------------------
def dirname(path: Column) -> Column:
    """Folder of a path, '' at the root; null stays null."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Last extension in lower case, '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^./]+)$", 1))


def path_prefix(path: Column, depth: int) -> Column:
    """The first `depth` folders of a path without its file name; '' for root-level files."""
    folders = F.split(path, "/")
    return F.array_join(F.slice(folders, 1, F.least(F.lit(depth), F.size(folders) - 1)), "/")


def ancestor_dirs(path: Column) -> Column:
    """All folders above a file, nearest first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def name_tokens(name: Column) -> Column:
    """Words of an identifier: camel case, capitals and separators apart, lower case, no empty ones."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: t != "")


def snake_case(name: Column) -> Column:
    return F.array_join(name_tokens(name), "_")


def glob_regex(pattern: str) -> str:
    """Shell pattern as an anchored regular expression; '*' crosses '/'."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
        i += 1
    return f"^{out}$"


def matches_path(path: Column, pattern: str) -> Column:
    """Glob where the pattern has wildcards, else the path itself or anything below it."""
    if any(c in pattern for c in "*?["):
        return path.rlike(glob_regex(pattern))
    return (path == pattern) | path.startswith(pattern.rstrip("/") + "/")


def strip_test_stem(name: Column) -> Column:
    """File stem without its test_ / _test marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^(tests?[_.\-])", ""), r"([_.\-](tests?|spec))$", "")


def strip_test_class(name: Column) -> Column:
    return (
        F.when(name.startswith("Test"), F.substring(name, 5, 1_000_000))
        .when(name.rlike("Tests?$"), F.regexp_replace(name, "Tests?$", ""))
        .otherwise(name)
    )


def locality(a: Column, b: Column) -> Column:
    """1.0 in one top folder, 0.7 in two, 0.5 where a path is missing."""
    first = lambda p: F.element_at(F.split(p, "/"), 1)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(missing, 0.5).when(first(a) == first(b), 1.0).otherwise(0.7)


# --- Hashes and ids -------------------------------------------------------------------------------------------------
def normalised(text: Column) -> Column:
    """Line ends to \\n, trailing blanks of lines and blank edge lines gone: what is hashed."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lf, r"(?m)[ \t]+$", ""), r"^\n+", ""), r"\n+$", "")


def content_hash(text: Column) -> Column:
    """sha256 of the normalised text, '' for empty or null."""
    norm = normalised(F.coalesce(text, F.lit("")))
    return F.when(norm == "", "").otherwise(F.sha2(norm, 256))


def page_key(*parts: Column) -> Column:
    """First 16 hex digits of the sha256 of the parts joined by '|'; null counts as ''."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


_ACCENTED = "àáâãäåèéêëìíîïòóôõöøùúûüñçýÿßłš"
_PLAIN = "aaaaaaeeeeiiiioooooouuuuncyysls"


def slug(title: Column) -> Column:
    """Lower-case ASCII words joined by '-'."""
    plain = F.translate(F.lower(title), _ACCENTED, _PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.length(text)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def slug_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(jaccard(bigrams(a), bigrams(b)))


# --- Predicates and classes -----------------------------------------------------------------------------------------
def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike("(?i)" + "|".join(S.TEST_PATHS)), F.lit(False))


def is_doc_type(kind: Column) -> Column:
    return kind.isin(*S.DOC_TYPES) | kind.rlike("_(document|section|chunk)$")


def is_architectural_type(kind: Column) -> Column:
    return kind.isin(*S.ARCHITECTURAL_TYPES)


def is_vendored_path(path: Column) -> Column:
    return F.coalesce(any_of([path.ilike(p) for p in S.VENDORED_LIKE]), F.lit(False))


def confidence_rank(confidence: Column) -> Column:
    """3 for EXTRACTED (and null), 2 for INFERRED, 1 for AMBIGUOUS."""
    out = F.when(confidence.isNull(), 3)
    for name, rank in S.CONFIDENCE_RANK.items():
        out = out.when(confidence == name, rank)
    return out.otherwise(1)


def type_priority(kind: Column) -> Column:
    out = F.lit(0)
    for value in sorted(set(S.TYPE_PRIORITY.values())):
        out = F.when(kind.isin(*[k for k, v in S.TYPE_PRIORITY.items() if v == value]), value).otherwise(out)
    return out


def layer(kind: Column, name: Column, parent: Column, path: Column) -> Column:
    """Architectural layer of a symbol, by a cascade: kind, entry-point name, infrastructure path, nesting, public."""
    low = F.lower(name)
    entry = low.isin(*S.ENTRY_NAMES) | low.rlike("^(" + "|".join(S.ENTRY_NAMES) + ")_") | low.rlike("_(" + "|".join(S.ENTRY_NAMES) + ")$")
    parts = F.split(F.lower(F.coalesce(path, F.lit(""))), "/")
    within = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(kind.isin("constant", "macro"), "constant")
        .when(kind.isin("struct", "enum", "type_alias"), "core_type")
        .when((kind == "function") & entry, "entry_point")
        .when(within(S.INFRA_SEGMENTS), "infrastructure")
        .when(F.coalesce(parent, F.lit("")) != "", "internal")
        .when(within(S.INTERNAL_SEGMENTS), "internal")
        .otherwise("public_api")
    )


def token_estimate(text: Column) -> Column:
    """Tokens of a text by its length: one for four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


# --- Names of kinds and of federated nodes --------------------------------------------------------------------------
#: Languages and kinds of documentation by extension.
LANGUAGE_BY_EXTENSION = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "bash", "sql": "sql",
}
DOC_BY_EXTENSION = {
    "md": "markdown", "markdown": "markdown", "rst": "restructuredtext", "adoc": "asciidoc", "txt": "plaintext", "html": "html", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "config", "cfg": "config",
    "conf": "config", "properties": "config", "gradle": "build_config", "proto": "schema", "xsd": "schema", "tf": "infrastructure", "pdf": "pdf", "docx": "document",
}


def _mapped(path: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[extension(path)]


def language_by_path(path: Column) -> Column:
    """Language that an extension names; null for others."""
    return _mapped(path, LANGUAGE_BY_EXTENSION)


def doc_kind(path: Column) -> Column:
    """Kind of documentation that an extension names; null for others."""
    return _mapped(path, DOC_BY_EXTENSION)


def project_node_id(wiki_id: Column, node_id: Column) -> Column:
    """Id of a node among many repositories: wiki_id::node_id."""
    return F.concat_ws("::", wiki_id, node_id)


def split_project_node_id(project_id: Column) -> Column:
    """(wiki_id, node_id) of a federated id; a node id may hold '::' itself."""
    at = F.instr(project_id, "::")
    return F.struct(F.when(at > 0, F.substring(project_id, F.lit(1), at - 1)).alias("wiki_id"), F.when(at > 0, F.substring(project_id, at + 2, F.length(project_id))).otherwise(project_id).alias("node_id"))
