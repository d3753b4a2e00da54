"""Functions, methods and constructors paired with what documents them.

One recursive pattern a language family captures comments, annotations, signature and balanced body of a symbol
together; strings, comments and regular expressions inside the body are protected, so a bracket in them counts for
nothing. What was captured is then judged: documentation that says nothing beyond the symbol is dropped.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.batches import map_rows, spread

KINDS = ("function", "method", "constructor")

# --- Patterns -----------------------------------------------------------------------------------------------------
_C_ATOMS = r"""(?(DEFINE)
 (?<str> "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' | `(?:[^`\\]|\\.)*+` )
 (?<com> //[^\n]*+ | /\*(?:[^*]|\*(?!/))*+\*/ )
 (?<rex> (?<=[=(,:;!&|?{}\[\s]|return)/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+ )
 (?<par> \( (?: [^()"'`/{}]++ | (?&str) | (?&com) | (?&par) | (?&bra) | / )*+ \) )
 (?<bra> \{ (?: [^{}"'`/]++ | (?&str) | (?&com) | (?&rex) | (?&bra) | / | ['"`] )*+ \} )
)"""
_C_LIKE = regex.compile(
    _C_ATOMS + r"""
 (?<lead> (?: \s++ | (?&com) | @(?!interface\b)[\w.]++[ \t]*+(?:(?&par))?+ )*+ )
 (?<sig> (?: [^{};"'`/()]++ | (?&str) | (?&com) | (?&par) )++ )
 (?: (?<body> (?&bra) ) | ; | (?=\{) | \Z )""",
    regex.VERBOSE | regex.DOTALL,
)
_PYTHON = regex.compile(
    r"""(?(DEFINE)
 (?<str> [A-Za-z]{0,2}+(?: \"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3} | '{3}(?:[^'\\]|\\.|'(?!''))*+'{3} | "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' ) )
 (?<com> \#[^\n]*+ )
 (?<par> [(\[{] (?: [^()\[\]{}"'\#]++ | (?&str) | (?&com) | (?&par) )*+ [)\]}] )
)
 (?<lead> (?: \s++ | (?&com) | @[^\n("'\#]++(?:(?&par))?+[^\n]*+ )*+ )
 (?<sig> (?:async[ \t]++)?+def[ \t]++[\w]++ \s*+ (?:\[[^\]\n]*+\])?+ \s*+ (?&par) (?: [^:("'\#\[{]++ | (?&par) | (?&str) )*+ : )
 (?<gap> (?: \s++ | (?&com) )*+ )
 (?<doc> (?:(?&str))(?=[ \t]*+(?:[;\#\n\r]|\Z)) )?+
 (?<body> .*+ )""",
    regex.VERBOSE | regex.DOTALL,
)
_PY_COMMENT = regex.compile(r"#[^\n]*")
_C_COMMENT = regex.compile(r"(?<block>/\*.*?\*/)|(?<line>//[^\n]*)", regex.DOTALL)
_PY_STRINGS = regex.compile(r"""\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", regex.DOTALL)

# --- Fixed values: what documents nothing -------------------------------------------------------------------------
#: Stand-ins for documentation, compared in lower case without marks at their ends.
STAND_INS = frozenset(
    (
        "todo", "fixme", "tbd", "tba", "tbc", "xxx", "wip", "n/a", "na", "none", "placeholder", "undocumented", "stub", "empty", "docstring", "documentation", "description", "summary", "comment",
        "missing", "missing docs", "missing doc", "missing docstring", "missing documentation", "missing description", "no description", "no docs", "no documentation", "no docstring", "no comment", "not documented",
        "not documented yet", "no description available", "no description provided", "description goes here", "description here", "documentation goes here", "docs go here", "add description", "add description here", "add docs", "add documentation", "add docstring", "write docs", "write me", "document me", "document this",
        "insert description here", "to be documented", "to be done", "to do", "to be written", "needs docs", "needs documentation", "auto-generated method stub", "auto-generated constructor stub", "auto generated method stub", "autogenerated", "auto-generated", "generated method stub", "method stub",
        "non-javadoc", "inheritdoc", "see above", "see below", "lorem ipsum", "fill me in", "fill in", "coming soon", "self-explanatory", "self explanatory",
    )
)
#: Notes to tools: what such a comment begins with.
TOOL_NOTE = regex.compile(
    r"(?i)\s*(?:@ts-|ts-|eslint|prettier|istanbul|c8 |v8 |tslint|jshint|jslint|jscs|standard|nolint|go:|\+build|noinspection|checkstyle|nosonar|nopmd|sonar|noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|fmt:|yapf|isort|black:|autopep8|pragma|nosec|bandit|coverage|-\*-|vim:|ex:|cspell|spell-?checker|codespell|@formatter|webpack|@vite|deno-|biome|rome-|lint|lcov_excl|clang-|language=|#?region\b|#?endregion\b|suppress|globals?\s|exported\s|keep in sync|skipcq|@flow|@noflow|jsx|rollup|todo:? lint)"
)
_TAG_ONLY = regex.compile(r"^(?:[@:\\](?:param|arg|argument|parameter|type|rtype|return|returns|raises|throws|exception|see|since|author|version|deprecated|override|inheritdoc|ignore|internal|private|public|protected|static|async|constructor|class|method|function|memberof|name|kind)\b)[ \t]*(?:\{[^}]*\})?[ \t]*([\w.$*\[\]]*)[ \t]*:?[ \t]*(?:[-–][ \t]*)?(.*)$", regex.I)
_CODE = regex.compile(
    r"""^(?: [\w.\]\[$]+\((?:[^()]|\([^()]*\))*\)(?:\.[\w]+(?:\([^()]*\))?)*\s*;?\s*$ | .*[;{}]\s*$ | [\w.\[\], *]+\s*(?::=|[-+*/|&]?=(?!=))\s*\S.*$
 | (?:if|elif|for|while|else|try|except|with|def|class|switch|case)\b.*:\s*$ | (?:return|break|continue|pass|raise|throw|import|from|package|const|let|var)\b(?:\s+[\w.()\[\], '"+*=-]+)?;?\s*$ | @\w+(?:\(.*\))?\s*$ | [\])}]+[;,]?\s*$ )""",
    regex.X,
)
#: Words that say nothing of their own in documentation.
FILLER = frozenset((
    "a", "an", "the", "this", "that", "these", "it", "its", "of", "for", "to", "in", "on", "with", "and", "or", "is", "are", "be", "as", "by",
    "from", "at", "function", "functions", "func", "fn", "def", "method", "methods", "constructor", "constructors", "ctor", "init", "initializer",
    "initialiser", "procedure", "routine", "class", "struct", "object", "symbol", "helper", "operation", "param", "params", "parameter",
    "parameters", "arg", "args", "argument", "arguments", "return", "returns", "returned", "value", "values", "result", "results", "name", "kind",
    "new", "self", "none", "null", "void", "type", "default",
))
_WORD = regex.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PARTS = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|[^\W\d_a-zA-Z]+")


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ies", "ing", "ed", "es", "s", "er", "or"):
        if len(w) > len(end) + 2 and w.endswith(end):
            return (w[: -len(end)] + ("y" if end == "ies" else "")).rstrip("e")
    return w.rstrip("e")


def _own_words(*names: str | None) -> set[str]:
    return {_stem(p) for n in names if n for p in _PARTS.findall(n)} | {_stem(n) for n in names if n}


def clean_lines(comment: str) -> list[str]:
    """The lines of a comment or doc string without its marks."""
    t = comment.strip()
    for a, b in (("/**", "*/"), ("/*", "*/"), ('"""', '"""'), ("'''", "'''")):
        if t.startswith(a):
            t = t[len(a) : len(t) - len(b) if t.endswith(b) and len(t) >= len(a) + len(b) else None]
            break
    return [regex.sub(r"^\s*(?:///?|\*(?!\*)|\#+!?)?\s?", "", line).strip() for line in regex.split(r"\r\n|\n|\r", t)]


def says_something(comment: str, own: set[str], least: int = 2) -> str | None:
    """The documentation in a comment without notes to tools, rules, disabled code and bare tags; None if that leaves nothing of its own."""
    lines, code = [], 0
    for line in clean_lines(comment):
        if not line or TOOL_NOTE.match(line) or not _WORD.search(line):
            continue
        if _CODE.match(line):
            code += 1
            continue
        lines.append(line)
    if not lines:
        return None
    said: list[str] = []
    for line in lines:
        tag = _TAG_ONLY.match(line)
        said.append(tag[2] if tag else line)
    flat = regex.sub(r"^[\W_]+|[\W_]+$", "", regex.sub(r"\s+", " ", " ".join(said))).lower()
    bare = regex.sub(r"^(?:todo|fixme|xxx|tbd|hack)\b[\W_]*(?:\([^)]*\))?[\W_]*", "", flat)
    if flat in STAND_INS or bare in STAND_INS or not bare or (bare != flat and len(_WORD.findall(bare)) <= 4):
        return None
    if regex.fullmatch(r"(?:auto-?\s?generated|generated)\b.{0,24}\bstub", flat):
        return None
    words = [w for w in _WORD.findall(" ".join(said)) if w.lower() not in FILLER]
    fresh = [p for w in words for p in (_PARTS.findall(w) or [w]) if _stem(p) not in own and p.lower() not in FILLER]
    return "\n".join(lines) if len(fresh) >= least else None


def capture(text: str, python: bool) -> tuple[list[str], str, str]:
    """Comments that belong to the symbol (lead blocks, then a doc string), its signature and its body."""
    m = (_PYTHON if python else _C_LIKE).match(text)
    if m is None:
        return [], "", text
    comments: list[str] = []
    lead = m["lead"]
    if python:
        last, block = None, []
        for c in _PY_COMMENT.finditer(lead):
            if last is not None and lead[last : c.start()].count("\n") > 1:
                comments.append("\n".join(block))
                block = []
            block.append(c[0])
            last = c.end()
        if block:
            comments.append("\n".join(block))
        if m["doc"]:
            comments.append(regex.sub(r"^[A-Za-z]{0,2}(?=['\"])", "", m["doc"]))
    else:
        block, last = [], None
        for c in _C_COMMENT.finditer(lead):
            if block and (c["block"] or lead[last : c.start()].count("\n") > 1):
                comments.append("\n".join(block))
                block = []
            if c["block"]:
                comments.append(c[0])
            else:
                block.append(c[0])
            last = c.end()
        if block:
            comments.append("\n".join(block))
    return comments, m["sig"].strip(), m["body"] or ""


def _parameters(text: str | None) -> list[str]:
    try:
        got = json.loads(text or "[]")
    except ValueError:
        return []
    return [str(x.get("name", "") if isinstance(x, dict) else x) for x in got] if isinstance(got, list) else []


PAIRS = "node_id string, symbol_name string, language string, description string, described_in string, signature string, body string"


def _pairs(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {f.split()[0]: [] for f in PAIRS.split(", ")}
    for node, name, lang, path, text, doc, params, parent, stype in zip(*(cols[c] for c in ("node_id", "symbol_name", "language", "rel_path", "source_text", "docstring", "parameters", "parent_symbol", "symbol_type"))):
        python = (path or "").lower().endswith((".py", ".pyi")) or ("." not in (path or "").rsplit("/", 1)[-1] and (lang or "").lower() == "python")
        comments, sig, body = capture(text, python) if text else ([], "", "")
        own = _own_words(name, parent if (stype or "").lower() == "constructor" else None, *_parameters(params))
        least = 4 if (stype or "").lower() == "constructor" else 2  # a constructor's own name says nothing, so a bare phrase is only a label
        found = next(((s, "comment") for c in comments if (s := says_something(c, own, least))), None)
        if found is None and doc and (s := says_something(doc, own, least)):
            found = (s, "docstring")
        if found:
            for k, v in zip(out, (node, name, lang, found[0], found[1], sig, body)):
                out[k].append(v)
    return out


def documented(nodes: DataFrame) -> DataFrame:
    """Code-description pairs of every delivery of a function, method or constructor (any case of symbol_type).

    A description is the first comment, doc string or `docstring` value that says something of its own: at least two
    words (four for a constructor) beyond the symbol's name, kind and parameters, after notes to tools, rules, disabled code, bare tags and
    stand-ins are taken out. Null and empty texts are judged by `docstring` alone; a symbol whose body doesn't balance
    keeps its comments. Null docstring, parameters, language and path are allowed; extra columns are ignored.
    """
    rows = nodes.where(F.lower("symbol_type").isin(*KINDS)).select("node_id", "symbol_name", "language", "rel_path", "source_text", "docstring", "parameters", "parent_symbol", "symbol_type")
    return map_rows(spread(rows), _pairs, PAIRS)


def documented_ids(nodes: DataFrame) -> DataFrame:
    """The distinct node_id that `documented` pairs with a description."""
    return documented(nodes).select("node_id").distinct()


def documented_pairs(nodes: DataFrame) -> DataFrame:
    """One pair a node_id: redelivered rows carry the same content, so any one of equal node_id is kept."""
    return documented(nodes).dropDuplicates(["node_id"])
