"""The field-based query language: text to a plain query object. No Spark here.

A text is scanned once, character by character, into words; a word is `field`, operator and value, a connective, or
neither. Questions in plain words are read by `functions.questions`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from lodegraph.functions.questions import Question, keywords, parse_question  # noqa: F401  (one door for both languages)

INDEX_FIELDS = ("type", "layer", "file", "name", "text")
POST_FIELDS = ("related", "dir", "has_rel", "connections")
FIELDS = (*INDEX_FIELDS, *POST_FIELDS, "limit")
OPERATORS = ("", ">", ">=", "<", "<=", "!", "!=")
DEFAULT_LIMIT, MAX_LIMIT = 20, 500


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: str


@dataclass
class Query:
    clauses: list[Clause] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    any_of: bool = False

    def values(self, name: str) -> list[str]:
        return [c.value for c in self.clauses if c.field == name]

    def first(self, name: str) -> str | None:
        return next(iter(self.values(name)), None)

    @property
    def types(self) -> list[str]:
        return [v.lower() for v in self.values("type")]

    @property
    def layer(self) -> str | None:
        got = self.first("layer")
        return got.lower() if got else None

    @property
    def relations(self) -> list[str]:
        return [v.lower() for v in self.values("has_rel")]

    @property
    def text(self) -> str | None:
        got = self.values("text")
        return " ".join(got) if got else None

    @property
    def direction(self) -> str:
        return {"outgoing": "out", "incoming": "in", "out": "out", "in": "in"}.get((self.first("dir") or "both").lower(), "both")

    @property
    def connections(self) -> list[Clause]:
        return [c for c in self.clauses if c.field == "connections"]

    @property
    def is_empty(self) -> bool:
        return not self.clauses


@dataclass
class _Word:
    field: str | None = None
    op: str = ""
    value: str = ""


def _scan(text: str) -> Iterator[_Word]:
    """Words of a text. A quote right behind `field:` runs to the next quote; an unclosed one runs to the end."""
    at, end = 0, len(text)
    while at < end:
        if text[at].isspace():
            at += 1
            continue
        stop = at
        while stop < end and not text[stop].isspace() and text[stop] != ":":
            stop += 1
        name = text[at:stop]
        if stop == end or text[stop] != ":" or name not in FIELDS:
            while stop < end and not text[stop].isspace():
                stop += 1
            yield _Word(value=text[at:stop])
            at = stop
            continue
        at = stop + 1
        word = _Word(name)
        if at < end and text[at] == '"':
            close = text.find('"', at + 1)
            close = end if close < 0 else close
            word.value, at = text[at + 1 : close], close + 1
        else:
            stop = at
            while stop < end and not text[stop].isspace():
                stop += 1
            raw, at = text[at:stop], stop
            word.value = raw.lstrip("<>!=") if raw.startswith(("<", ">", "!")) else raw
            word.op = raw[: len(raw) - len(word.value)]
            if word.op not in OPERATORS:
                word.field = None
        yield word


def parse_jql(text: str) -> Query:
    """Clauses `field:value`, `field:"words"`, `field:>n`; AND is implied.

    Unknown fields, stray words and empty values are passed over. `!=` reads as equality, as callers of the language
    expect. OR, in any case, is noted; repeated `type:` is a set with or without it. The limit is held to 1..500, 20
    by default.
    """
    query = Query()
    for w in _scan(text):
        if w.field is None:
            query.any_of |= w.value.upper() == "OR"
        elif w.field == "limit":
            digits = w.value.removeprefix("-")
            if not w.op and digits.isdecimal():
                query.limit = max(1, min(MAX_LIMIT, int(w.value)))
        elif w.value:
            ordered = w.op in (">", ">=", "<", "<=")
            query.clauses.append(Clause(w.field, w.op if ordered else "match" if w.field == "text" else "=", w.value))
    return query


def is_jql(text: str) -> bool:
    """Whether a text has any known `field:` with a value."""
    return any(w.field and w.value for w in _scan(text))
