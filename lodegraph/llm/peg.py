"""Packrat parsing-expression grammars over strings of token kinds.

A grammar is text: `Rule <- choice / choice`, with sequences, `*`, `+`, `?`, `&` and `!` predicates, groups, 'literals',
token classes in capitals, `{Class}` for a bracketed part that was already parsed as that class, and the marks
HERE (no line break at this place), BREAK (a line break at this place) and END. Every rule is memoised by position, so
parsing takes linear time, and the furthest place where a terminal failed is kept.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

_LEX = re.compile(r"\s*(?:([A-Za-z_]\w*)\s*(<-)?|('[^']+')|(\{\w+\})|([/*+?&!()]))")
NEWLINE, STOP = "\n", "\0"
#: Calls that a parse may nest (they lie on the heap).
DEPTH = 300_000


class TooDeep(Exception):
    """A text nests deeper than DEPTH calls: there is no verdict on it."""


Matcher = Callable[[int], int]


class Grammar:
    """kinds: token text -> its character; classes: name -> characters it stands for; parts: {Class} -> its characters (they may grow)."""

    def __init__(self, text: str, kinds: Callable[[str], str], classes: dict[str, str], parts: dict[str, set[str]]):
        self._kind, self._classes, self._parts = kinds, classes, parts
        self._text, self._far, self._memos = "", 0, []
        self._rules: dict[str, Matcher] = {}
        trees = _read(text)
        for name in trees:  # rules may refer to later ones
            self._rules[name] = lambda i, n=name: self._compiled[n](i)
        self._compiled: dict[str, Matcher] = {}
        for name, tree in trees.items():
            self._compiled[name] = self._memoised(self._make(tree))

    def match(self, rule: str, text: str) -> tuple[bool, int]:
        """Whether `rule` matches all of `text` (line breaks at the end aside), and the furthest place reached."""
        self._text, self._far = text + STOP, 0
        for memo in self._memos:
            memo.clear()
        if sys.getrecursionlimit() < DEPTH:
            sys.setrecursionlimit(DEPTH)
        try:
            end = self._compiled[rule](0)
        except RecursionError:
            raise TooDeep from None
        if end >= 0:
            while self._text[end] == NEWLINE:
                end += 1
            if end == len(text):
                return True, end
        return False, min(max(self._far, end), len(text))

    def _memoised(self, f: Matcher) -> Matcher:
        memo: dict[int, int] = {}
        self._memos.append(memo)

        def g(i: int) -> int:
            got = memo.get(i)
            if got is None:
                got = memo[i] = f(i)
            return got

        return g

    def _terminal(self, chars) -> Matcher:
        def f(i: int) -> int:
            s = self._text
            while s[i] == NEWLINE:
                i += 1
            if s[i] in chars:
                return i + 1
            if i > self._far:
                self._far = i
            return -1

        return f

    def _make(self, tree) -> Matcher:
        op, *args = tree
        if op == "text":
            return self._terminal(frozenset(self._kind(args[0])))
        if op == "part":
            return self._terminal(self._parts.setdefault(args[0], set()))
        if op == "name":
            name = args[0]
            if name == "HERE":
                return lambda i: -1 if self._text[i] == NEWLINE else i
            if name == "BREAK":
                return lambda i: i if self._text[i] == NEWLINE else -1
            if name == "END":

                def end(i: int) -> int:
                    while self._text[i] == NEWLINE:
                        i += 1
                    if self._text[i] == STOP:
                        return i
                    if i > self._far:
                        self._far = i
                    return -1

                return end
            if name in self._classes:
                return self._terminal(frozenset(self._classes[name]))
            return self._rules[name]
        if op == "seq":
            parts = [self._make(t) for t in args[0]]

            def seq(i: int) -> int:
                for p in parts:
                    i = p(i)
                    if i < 0:
                        return -1
                return i

            return seq
        if op == "or":
            if all(t[0] in ("text", "name") and (t[0] == "text" or t[1] in self._classes) for t in args[0]):
                return self._terminal(frozenset("".join(self._kind(t[1]) if t[0] == "text" else self._classes[t[1]] for t in args[0])))
            choices = [self._make(t) for t in args[0]]

            def choose(i: int) -> int:
                for p in choices:
                    j = p(i)
                    if j >= 0:
                        return j
                return -1

            return choose
        inner = self._make(args[0])
        if op == "?":

            def maybe(i: int) -> int:
                j = inner(i)
                return i if j < 0 else j

            return maybe
        if op == "&":
            return lambda i: i if inner(i) >= 0 else -1
        if op == "!":

            def no(i: int) -> int:
                far = self._far
                j = inner(i)
                self._far = far
                return -1 if j >= 0 else i

            return no

        def many(i: int) -> int:
            j = inner(i)
            if op == "+" and j < 0:
                return -1
            while j > i:
                i = j
                j = inner(i)
            return i

        return many


def _read(text: str) -> dict[str, tuple]:
    tokens: list[tuple[str, str]] = []
    at = 0
    text = re.sub(r"(?m)#.*$", "", text)
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        name, arrow, lit, part, sign = m.groups()
        tokens.append(("rule", name) if arrow else ("name", name) if name else ("text", lit[1:-1]) if lit else ("part", part[1:-1]) if part else ("sign", sign))
        at = m.end()
    tokens.append(("rule", ""))
    pos = 0

    def choice():
        nonlocal pos
        options = [sequence()]
        while tokens[pos] == ("sign", "/"):
            pos += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence():
        items = []
        while tokens[pos][0] != "rule" and tokens[pos] not in (("sign", "/"), ("sign", ")")):
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefixed():
        nonlocal pos
        if tokens[pos] in (("sign", "&"), ("sign", "!")):
            sign = tokens[pos][1]
            pos += 1
            return (sign, prefixed())
        kind, value = tokens[pos]
        pos += 1
        if (kind, value) == ("sign", "("):
            tree = choice()
            if tokens[pos] != ("sign", ")"):
                raise ValueError("grammar: missing )")
            pos += 1
        else:
            tree = (kind, value)
        while tokens[pos] in (("sign", "*"), ("sign", "+"), ("sign", "?")):
            tree = (tokens[pos][1], tree)
            pos += 1
        return tree

    rules = {}
    while tokens[pos][1]:
        name = tokens[pos][1]
        pos += 1
        rules[name] = choice()
    return rules
