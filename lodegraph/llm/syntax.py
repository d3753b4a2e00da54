"""Which source files do not parse, where and why.

A file is cut into tokens by one compiled pattern and becomes a string of token kinds, one character each. Parts in
braces are parsed from the inside out by the packrat grammar of the language; a parsed part stands as one character
for the classes it parsed as. Lists of statements or members are checked by lines: a line that is a list of its own is
parsed once and then known by its kinds, in all files of a worker. A file is valid when the grammar consumes it to
its end; otherwise the furthest place reached is reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm import grammars
from lodegraph.llm.batches import map_rows, spread
from lodegraph.llm.peg import Grammar, TooDeep

EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go"}
#: Known lines are forgotten when so many are held.
MEMO = 400_000
BAD = "\x01"

# --- Fixed values: reserved words and operators ---------------------------------------------------------------------
_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let enum"
_JAVA_RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_GO_RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_PY_RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_JS_OPS = "... => ?. ** ++ -- === !== == != <= && || ?? << += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ ? : = @"
_JAVA_OPS = "... -> :: ++ -- == != <= >= && || << += -= *= /= %= <<= &= |= ^= { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ ? : = @"
_GO_OPS = "... := <- ++ -- == != <= >= && || << >> &^ += -= *= /= %= <<= >>= &= |= ^= &^= { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ : ="
_PY_OPS = "... -> := ** // << >> == != <= >= += -= *= /= %= **= //= <<= >>= &= |= ^= @= ( ) [ ] { } . ; , < > + - * / % & | ^ ~ : = @"
_ASSIGN = "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??= = >>= &^= //= @="
_NUMBER = r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[nlLi]?|0[bB][01_]+[nlLi]?|0[oO][0-7_]+[ni]?|(?:\d[\d_]*(?:\.(?![\w.])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[nlLfFdDijJ]?"
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"


def _alternatives(ops: str) -> str:
    return "|".join(re.escape(o) for o in sorted(set(ops.split()), key=lambda o: (-len(o), o)))


class Kinds(dict):
    """Token text -> its kind: '' for what the grammar doesn't see, NAME and other classes as letters, else a character of its own."""

    def __init__(self, words: str, ops: str, grammar: str, classify: Callable[[str], str | None]):
        super().__init__()
        self.reserved = words.split()
        self._of: dict[str, str] = {}
        for w in [*self.reserved, *sorted(set(ops.split()))]:
            self.code(w)
        in_grammar = sorted(set(re.findall(r"'([A-Za-z_]\w*)'", grammar)) - set(self.reserved))
        self.contextual = [self.code(w) for w in in_grammar]
        self._classify = classify
        self.update(self._of)

    def code(self, text: str) -> str:
        if text not in self._of:
            self._of[text] = chr(0xE000 + len(self._of))
        return self._of[text]

    def known(self, text: str) -> str:
        if text not in self._of:
            raise KeyError(f"grammar uses {text!r}, which the lexer doesn't know")
        return self._of[text]

    def __missing__(self, token: str) -> str:
        kind = self._classify(token)
        if kind is None:
            kind = BAD
        if len(token) <= 40:
            if len(self) > MEMO:
                self.clear()
                self.update(self._of)
            self[token] = kind
        return kind


@dataclass
class Failure:
    """at: code points from the start."""

    at: int
    cause: str


class Language:
    """Lexer, grammar and the classes that a part in braces may parse as."""

    pattern: re.Pattern
    kinds: Kinds
    top: str

    def tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def kinds_of(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.tokens(text)))

    def offset(self, text: str, index: int) -> int:
        """Where in the text the token of a place in its kinds begins."""
        n = 0
        for m in self.pattern.finditer(text):
            n += len(self.kinds[m[0]])
            if n > index:
                return m.start()
        return len(text)

    def check(self, text: str) -> int | None:
        """None if valid, else where parsing ends."""
        raise NotImplementedError


#: Parts that were parsed before stand in a text of kinds as characters from this one on.
FIRST_PART = chr(0xF0000)


class Braced(Language):
    #: Classes that are lists of lines, so that lines may be checked one by one, and the rule of such a line.
    by_line: dict[str, str]
    classes: tuple[str, ...]
    union = True

    def __init__(self, grammar: Grammar, parts: dict[str, set[str]], pattern: str, kinds: Kinds, top: str):
        self.grammar, self.parts, self.kinds, self.top = grammar, parts, kinds, top
        self.pattern = re.compile(pattern)
        self._braces = re.compile("[" + kinds.code("{") + kinds.code("}") + "]")
        self._open = kinds.code("{")
        self._part_of: dict[frozenset, str] = {}
        self._lines: dict[tuple[str, str], bool] = {}
        self._split = re.compile("[" + kinds.code("(") + kinds.code(")") + kinds.code("[") + kinds.code("]") + kinds.code(";") + "]")
        self._semi, self._up = kinds.code(";"), kinds.code("(") + kinds.code("[")
        self._whole: dict[tuple[str, str], tuple[bool, int]] = {}

    def part(self, found: frozenset) -> str:
        got = self._part_of.get(found)
        if got is None:
            got = self._part_of[found] = chr(ord(FIRST_PART) + len(self._part_of))
            for c in found:
                self.parts[c].add(got)
        return got

    def _line(self, rule: str, line: str) -> bool:
        got = self._lines.get((rule, line))
        if got is None:
            if len(line) > 60 and (pieces := self._statements(line)) is not None:
                got = all(self._line(rule, p) for p in pieces)
            if not got:
                got = self.grammar.match(rule, line)[0]
            if len(self._lines) > MEMO:
                self._lines.clear()
            self._lines[rule, line] = got
        return got

    def _statements(self, line: str) -> list[str] | None:
        """A line cut after each semicolon outside of brackets; None if there is nothing to cut."""
        out, depth, at = [], 0, 0
        for m in self._split.finditer(line):
            c = m[0]
            if c == self._semi:
                if depth == 0 and m.end() < len(line):
                    out.append(line[at : m.end()])
                    at = m.end()
            else:
                depth += 1 if c in self._up else -1
        if not out:
            return None
        return [*out, line[at:]]

    def parse(self, rule: str, flat: str) -> tuple[bool, int]:
        line_rule = self.by_line.get(rule)
        if line_rule and all(self._line(line_rule, x) for x in flat.split("\n") if x):
            return True, len(flat)
        if len(flat) < 200:
            got = self._whole.get((rule, flat))
            if got is None:
                if len(self._whole) > MEMO:
                    self._whole.clear()
                got = self._whole[rule, flat] = self.grammar.match(rule, flat)
            return got
        return self.grammar.match(rule, flat)

    def candidates(self, head: str, before: str, around: tuple[str, ...]) -> tuple[str, ...]:
        """Classes that a part may parse as, from the line before its brace, the last kind before it, and what is around it."""
        raise NotImplementedError

    def check(self, text: str) -> int | None:
        failed = self.check_kinds(self.kinds_of(text))
        return None if failed is None else self.offset(text, failed)

    def check_kinds(self, kinds: str) -> int | None:
        stack: list[tuple[list[str], list[int], tuple[str, ...]]] = []
        flat: list[str] = []  # pieces of the part being read
        begins: list[int] = []  # where each piece begins in kinds
        expect: tuple[str, ...] = ()
        at = 0
        for m in self._braces.finditer(kinds):
            i = m.start()
            if i > at:
                flat.append(kinds[at:i])
                begins.append(at)
            at = i + 1
            if m[0] == self._open:
                # The line before the brace, and the last kind that is no line break.
                tail = "".join(flat[-6:])
                bare = tail.rstrip("\n")
                head = tail[tail.rfind("\n", 0, len(bare)) + 1 :].lstrip("\n")
                stack.append((flat, begins, expect))
                expect = self.candidates(head, bare[-1:], expect)
                flat, begins = [], []
            else:
                if not stack:
                    return i
                inner = "".join(flat)
                found = []
                far = -1
                for c in (*expect, *(x for x in self.classes if x not in expect)):
                    if found and (c not in expect or not self.union):
                        break
                    ok, reached = self.parse(c, inner)
                    if ok:
                        found.append(c)
                    elif reached > far and c in expect:
                        far = reached
                if not found:
                    return self._place(flat, begins, max(far, 0), i)
                flat, begins, expect = stack.pop()
                flat.append(self.part(frozenset(found)))
                begins.append(i)
        if stack:
            return len(kinds)
        if at < len(kinds):
            flat.append(kinds[at:])
            begins.append(at)
        ok, far = self.parse(self.top, "".join(flat))
        return None if ok else self._place(flat, begins, far, len(kinds))

    @staticmethod
    def _place(flat: list[str], begins: list[int], far: int, end: int) -> int:
        for piece, begin in zip(flat, begins):
            if far < len(piece):
                return begin + far
            far -= len(piece)
        return end


# --- ECMAScript and TypeScript --------------------------------------------------------------------------------------
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`\"']|" + _STRING + r"|\{[^{}]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*`"
_REGEX = r"/(?![*/\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_BEFORE_REGEX = r"(?:(?:=>|\.\.\.|[=(,:;!&|?{}\[+*%~^<>-]|(?<![\w$.])(?:return|typeof|case|in|of|else|do|void|delete|new|throw|await|yield)(?![\w$]))[^\S\n]*)"


#: The head of a statement, behind which a slash begins a regular expression rather than divides.
_HEAD = r"(?<![\w$.])(?:if|while|for|with)[^\S\n]*\((?:[^()\n/\"'`]|\((?:[^()\n/\"'`]|\([^()\n/\"'`]*\))*\))*\)[^\S\n]*"


class Script(Braced):
    by_line = {"Block": "StmtList", "ClassBody": "ClassBody", "Module": "Module", "TypeBody": "TypeBody"}

    def __init__(self, types: bool):
        text = _merge(grammars.ECMASCRIPT, grammars.TYPESCRIPT) if types else grammars.ECMASCRIPT
        text += "\nBlock <- StmtList\nField <- Expr END\n"
        self.classes = ("Block", "Object", "ClassBody", "SwitchBody", "Specs") + (("TypeBody", "EnumBody", "Module") if types else ())
        k = Kinds(_JS_RESERVED, _JS_OPS, text, self._classify)
        name = "a" + "".join(k.contextual)
        classes = {
            "NAME": name, "KEYWORD": "".join(map(k.code, _JS_RESERVED.split())), "STR": "s", "NUM": "0", "TPL": "t", "RE": "r", "PRIV": "p", "NEVER": "",
            "ASSIGNOP": "".join(k.code(o) for o in _ASSIGN.split() if o in _JS_OPS.split()),
            "BINOP": "".join(map(k.code, "|| && ?? | ^ & == != === !== < <= << + - * / % **".split())), "UNARYOP": "".join(map(k.code, "! ~ + -".split())),
        }
        parts: dict[str, set[str]] = {c: set() for c in (*self.classes, "Pattern")}
        pattern = rf"//[^\n]*|/\*[\s\S]*?\*/|\n|(?<![^\n]){_REGEX}|{_BEFORE_REGEX}{_REGEX}|{_HEAD}{_REGEX}|{_STRING}|{_TEMPLATE}|#?(?:[^\W\d]|\$)[\w$]*|{_NUMBER}|\?\.(?!\d)|{_alternatives(_JS_OPS.replace('?. ', ''))}|\S"
        super().__init__(Grammar(text, k.known, classes, parts), parts, pattern, k, "Module")
        self.types = types
        c = k.code
        self._after = frozenset(map(c, (")", "=>", "else", "try", "do", "finally", "catch")))
        self._value = frozenset(map(c, ("=", "(", ",", "[", "?", "return", "||", "&&", "??", "in", "of", "...", "+", "!", "throw", "default", "case")))
        self._typeish = frozenset(map(c, ("|", "&", "<", "as", "keyof", "readonly", "satisfies", "extends"))) if types else frozenset(map(c, ("|", "&")))
        self._head = {w: c(w) for w in ("class", "import", "export", "switch", "=", ":", "enum", *(("interface", "namespace", "module", "global", "type", "declare") if types else ()))}

    def _classify(self, t: str) -> str | None:
        c = t[0]
        if c == "\n":
            return "\n"
        if t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return "\n" if "\n" in t else ""
        if c in "\"'":
            return "s" if len(t) > 1 else None
        if c == "`":
            return self._template(t) if len(t) > 1 else None
        if c == "#":
            return "p" if len(t) > 1 else None
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "0"
        if t[-1] == "/" or (len(t) > 2 and "/" in t):  # an operator or word and the regular expression after it
            at = t.find("/")
            head = t[:at].strip()
            return (self.kinds_of(head) if head else "") + "r"
        return "a" if c.isalpha() or c in "_$" or ord(c) > 127 and c.isidentifier() else None

    def _template(self, t: str) -> str | None:
        for field in _fields(t[1:-1], "${"):
            if field is None or self.check_field(field) is False:
                return None
        return "t"

    def check_field(self, text: str) -> bool:
        kinds = self.kinds_of(text).replace("\n", "")
        if self.kinds.code("{") in kinds:
            return kinds.count(self.kinds.code("{")) == kinds.count(self.kinds.code("}"))
        return self.grammar.match("Field", kinds)[0]

    def check(self, text: str) -> int | None:
        if text.startswith("#!"):
            text = "//" + text[2:]
        return super().check(text)

    def candidates(self, head: str, before: str, around: tuple[str, ...]) -> tuple[str, ...]:
        h = self._head
        if h["class"] in head and before not in self._after:
            return ("ClassBody",)
        if (h["import"] in head[:1] or before == h["export"] or h["export"] in head[:1] and self.types and before == h["type"]) and h["="] not in head:
            return ("Specs", "Module", "Block") if self.types else ("Specs",)
        if before in self._after:
            return ("SwitchBody", "Block") if h["switch"] in head else ("Block",)
        if self.types:
            if h["interface"] in head:
                return ("TypeBody", "Block")
            if h["enum"] in head:
                return ("EnumBody",)
            if h["namespace"] in head or h["module"] in head or before == h["global"]:
                return ("Module",)
            if before in self._typeish or before == h[":"]:
                return ("Object", "TypeBody")
            if before == h["="] and h["type"] in head:
                return ("TypeBody",)
            if before in self._value:
                return ("Object", "TypeBody")
            return ("Block",)
        if before in self._value or before == h[":"]:
            return ("Object",) if before != h[":"] else ("Object", "Block")
        return ("Block", "Object") if before in self._typeish else ("Block",)


def _merge(base: str, more: str) -> str:
    """`base` with the rules that `more` redefines replaced and its new ones added."""
    rules: dict[str, str] = {}
    for text in (base, more):
        for m in re.finditer(r"(?m)^(\w+) <-(.*(?:\n(?!\w+ <-).*)*)", text):
            rules[m[1]] = m[2]
    return "\n".join(f"{n} <-{body}" for n, body in rules.items())


def _fields(body: str, opener: str) -> Iterator[str | None]:
    """Texts of the fields in a template; None for one that doesn't end."""
    at = 0
    while (at := body.find(opener, at)) >= 0:
        slashes = len(body[:at]) - len(body[:at].rstrip("\\"))
        if slashes % 2:
            at += 1
            continue
        depth, i = 1, at + len(opener)
        while i < len(body) and depth:
            depth += {"{": 1, "}": -1}.get(body[i], 0)
            i += 1
        yield body[at + len(opener) : i - 1] if not depth else None
        at = i


# --- Java -----------------------------------------------------------------------------------------------------------
class Java(Braced):
    by_line = {"Block": "StmtList", "ClassBody": "ClassBody"}
    classes = ("Block", "ClassBody", "EnumBody", "SwitchBody", "ArrayInit")

    def __init__(self):
        text = grammars.JAVA + "\nBlock <- StmtList\n"
        k = Kinds(_JAVA_RESERVED, _JAVA_OPS, text, self._classify)
        k.contextual.append(k.code("when"))
        k["when"] = k.code("when")
        classes = {
            "NAME": "a" + "".join(k.contextual), "LITERAL": "s0" + "".join(map(k.code, ("true", "false", "null"))), "NAMEWHEN": k.code("when"),
            "MODIFIER": "".join(map(k.code, "public protected private static abstract final native synchronized transient volatile strictfp".split())),
            "PRIMITIVE": "".join(map(k.code, "boolean byte short int long float double void char".split())),
            "ASSIGNOP": "".join(k.code(o) for o in _ASSIGN.split() if o in _JAVA_OPS.split()),
            "BINOP": "".join(map(k.code, "|| && | ^ & == != < <= >= << + - * / %".split())), "UNARYOP": "".join(map(k.code, "+ - ++ -- ! ~".split())),
        }
        parts: dict[str, set[str]] = {c: set() for c in self.classes}
        pattern = rf'//[^\n]*|/\*[\s\S]*?\*/|\n|"""[ \t\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]+?)\'|(?:[^\W\d]|\$)[\w$]*|{_NUMBER}|{_alternatives(_JAVA_OPS)}|\S'
        super().__init__(Grammar(text, k.known, classes, parts), parts, pattern, k, "Unit")
        c = k.code
        self._h = {w: c(w) for w in ("class", ".", "interface", "record", "enum", "new", "switch", ")", "]", "=", "(", ",", "->", "@", "default")}
        self._class = re.compile(f"(?:^|[^{c('.')}]){c('class')}")

    def _classify(self, t: str) -> str | None:
        c = t[0]
        if c == "\n":
            return "\n"
        if t.startswith(("//", "/*")):
            return ""
        if c in "\"'":
            return "s" if len(t) > 1 else None
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "0"
        return "a" if c.isalpha() or c in "_$" else None

    def candidates(self, head: str, before: str, around: tuple[str, ...]) -> tuple[str, ...]:
        h = self._h
        if before in (h["]"], h["default"]):
            return ("ArrayInit",)
        if before == h[")"] or before == h["->"]:
            if h["switch"] in head and before == h[")"]:
                return ("SwitchBody", "Block")
            if h["record"] in head:
                return ("ClassBody", "Block")
            return ("Block", "ClassBody") if h["new"] in head else ("Block",)
        if self._class.search(head) or h["interface"] in head or h["record"] in head:
            return ("ClassBody",)
        if h["enum"] in head:
            return ("EnumBody",)
        if before in (h["="], h["("], h[","]) or before == "" and around == ("ArrayInit",):
            return ("ArrayInit",)
        return ("Block",)


# --- Go -------------------------------------------------------------------------------------------------------------
class Go(Braced):
    by_line = {"Block": "StmtList"}
    classes = ("Block", "Literal", "StructBody", "InterfaceBody", "SwitchBody", "SelectBody")
    union = False

    def __init__(self):
        text = grammars.GO + "\nBlock <- StmtList\n"
        k = Kinds(_GO_RESERVED, _GO_OPS, text, self._classify)
        classes = {
            "NAME": "a", "LITERAL": "0s", "STR": "s", "NEVER": "",
            "BINOP": "".join(map(k.code, "|| && == != < <= > >= + - % ^ / << >> &^".split())), "UNARYOP": "".join(map(k.code, "+ - ! ^ ~".split())),
            "OPASSIGN": "".join(k.code(o) for o in _GO_OPS.split() if o.endswith("=") and o not in ("==", "!=", "<=", ">=", "=", ":=")),
        }
        parts: dict[str, set[str]] = {c: set() for c in self.classes}
        pattern = rf"//[^\n]*|/\*[\s\S]*?\*/|\n|\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|[^\W\d]\w*|{_NUMBER}|{_alternatives(_GO_OPS)}|\S"
        super().__init__(Grammar(text, k.known, classes, parts), parts, pattern, k, "File")
        c = k.code
        # The language's rule of semicolons: one is set at the end of a line after these.
        last = "a0s" + "".join(map(c, ("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")))
        self._auto = re.compile(f"(?<=[{last}])\n")
        self._typed = re.compile(f"{re.escape(c(']'))}{re.escape(c('*'))}*a(?:{re.escape(c('.'))}a)?$")
        self._h = {w: c(w) for w in ("if", "for", "switch", "select", "func", "else", "struct", "interface", "(", ")", "[", "]", "case", "default", ";", ",", ":")}

    def _classify(self, t: str) -> str | None:
        c = t[0]
        if c == "\n":
            return "\n"
        if t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return "\n" if "\n" in t else ""
        if c in "\"'`":
            return "s" if len(t) > 1 else None
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return "0"
        return "a" if c.isalpha() or c == "_" else None

    def check(self, text: str) -> int | None:
        raw = self.kinds_of(text if text.endswith("\n") else text + "\n")
        kinds = self._auto.sub(self._h[";"] + "\n", raw)
        failed = self.check_kinds(kinds)
        if failed is None:
            return None
        added = [m.start() + k for k, m in enumerate(self._auto.finditer(raw))]  # places of the semicolons that were set
        return self.offset(text, failed - sum(1 for x in added if x < failed))

    def candidates(self, head: str, before: str, around: tuple[str, ...]) -> tuple[str, ...]:
        h = self._h
        if before == h["struct"]:
            return ("StructBody", "Literal")
        if before == h["interface"]:
            return ("InterfaceBody",)
        if around[:1] == ("Literal",) and before in ("", h[","], h[":"]) or before in (h[","], h["("], h["["]):
            return ("Literal",)
        depth, at = 0, 0
        for i in range(len(head) - 1, -1, -1):  # what follows the last bracket that is still open
            c = head[i]
            if c in (h[")"], h["]"]):
                depth += 1
            elif c in (h["("], h["["]):
                depth -= 1
                if depth < 0:
                    at = i + 1
                    break
        own = head[at:]
        last = own.rpartition(h[";"])[2]  # of several statements in a line the one at hand
        func = last.rfind(h["func"])
        if func >= 0 and not (before == "a" and any(c >= FIRST_PART for c in last[func:])):  # unless its body is there already
            return ("Block", "Literal")
        if self._typed.search(own):  # a composite literal may stand in a header where its type is spelled out
            return ("Literal", "Block")
        if at == 0:
            for word, classes in (("switch", ("SwitchBody", "Block")), ("select", ("SelectBody",)), ("if", ("Block", "Literal")), ("for", ("Block", "Literal")), ("else", ("Block",))):
                if h[word] in own:
                    return classes
            if before in ("", h[";"]) or own == "":
                return ("Block", "Literal")
        return ("Literal", "Block")


#: A number that a word of the language follows without a space ends where the word begins.
_BEFORE_WORD = r"(?:\d[\d_]*\.?\d*|\.\d+)(?=(?:and|else|for|if|in|is|not|or)\b)"
#: Whole numbers with leading zeros, which Python doesn't have.
_ZERO_LED = re.compile(r"0[0_]*[1-9][\d_]*")

# --- Python ---------------------------------------------------------------------------------------------------------
class Python(Language):
    """Logical lines are parsed by the grammar (each shape once); suites by reducing the string of line classes."""

    def __init__(self):
        text = grammars.PYTHON
        self.kinds = k = Kinds(_PY_RESERVED, _PY_OPS, text, self._classify)
        c = k.code
        classes = {
            "NAME": "a" + "".join(k.contextual), "STR": "s", "NUM": "0",
            "AUGASSIGN": "".join(c(o) for o in "+= -= *= /= %= **= //= <<= >>= &= |= ^= @=".split()),
            "COMPARE": "".join(map(c, "== != < <= > >=".split())), "BINOP": "".join(map(c, "| ^ & << >> + - * / // % @".split())),
        }
        self.grammar = Grammar(text, k.known, classes, {})
        string = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + _STRING
        self.pattern = re.compile(rf"\#[^\n]*|\\\n|\n[ \t\f]*|(?:[rRbBuUfFtT]{{1,2}})?(?:{string})|[^\W\d]\w*|{_BEFORE_WORD}|{_NUMBER}|{_alternatives(_PY_OPS)}|[^\s]")
        self._open, self._close = "".join(map(c, "([{")), "".join(map(c, ")]}"))
        self._brackets = re.compile("[" + re.escape(self._open + self._close) + "]")
        self._shape: dict[str, tuple[str, int]] = {}
        self._words = {c(w): x for w, x in (("if", "i"), ("elif", "e"), ("else", "l"), ("for", "w"), ("while", "w"), ("try", "t"), ("except", "x"), ("finally", "n"), ("with", "u"), ("def", "d"), ("class", "d"), ("async", "?"), ("@", "@"), ("match", "m"), ("case", "c"))}
        self._fields: dict[str, bool] = {}
        # Reductions of suites, from the innermost out: '>' and '<' are the deeper and the shallower margin.
        self._reduce = [(re.compile(p), r) for p, r in (
            (r"s{2,}", "s"), (r">s<", "B"), (r"@+dB", "s"), (r"(?<!@)dB", "s"), (r"uB", "s"), (r"wB(?:lB)?(?!l)", "s"), (r"iB(?:eB)*(?:lB)?(?![el])", "s"),
            (r"tB(?:(?:xB)+(?:lB)?(?:nB)?|nB)(?![xln])", "s"), (r"m>(?:cB)+<", "s"),
        )]
        self._suites = Grammar(
            "File <- Stmt* END\nSuite <- 'B' / '>' Stmt+ '<'\n"
            "Stmt <- 's' / '@'+ 'd' Suite / 'd' Suite / 'u' Suite / 'w' Suite ( 'l' Suite )? / 'i' Suite ( 'e' Suite )* ( 'l' Suite )? / 't' Suite ( ( 'x' Suite )+ ( 'l' Suite )? ( 'n' Suite )? / 'n' Suite ) / 'm' '>' ( 'c' Suite )+ '<'\n",
            lambda t: t, {}, {},
        )

    def _classify(self, t: str) -> str | None:
        c = t[0]
        if c == "#" or t == "\\\n":
            return ""
        if c == "\n":
            return "\n"
        if t[-1] in "\"'":
            if len(t) < 2:
                return None
            prefix = t[: min(x for x in (t.find('"'), t.find("'")) if x >= 0)].lower()
            if "".join(sorted(prefix)) not in ("", "r", "b", "u", "f", "br", "fr", "t", "rt"):
                return None
            if "f" in prefix and "{" in t or "f" in prefix and "}" in t:
                return "s" if self._fstring(t[len(prefix) :]) else None
            return "s"
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return None if _ZERO_LED.fullmatch(t) else "0"
        return "a" if c.isalpha() or c == "_" else None

    def _fstring(self, quoted: str) -> bool:
        q = 3 if quoted[:3] in ('"""', "'''") else 1
        return self._spec(quoted[q:-q], 0)

    def _spec(self, body: str, level: int) -> bool:
        i = 0
        while i < len(body):
            ch = body[i]
            if level == 0 and body[i : i + 2] in ("{{", "}}"):
                i += 2
                continue
            if ch == "}":
                return False
            if ch != "{":
                i += 1
                continue
            depth, j, quote, colon, end = 0, i + 1, "", -1, -1
            while j < len(body):
                x = body[j]
                if quote:
                    quote = "" if x == quote else quote
                elif x in "\"'":
                    quote = x
                elif x in "([{":
                    depth += 1
                elif x in ")]}":
                    if x == "}" and depth == 0:
                        end = j
                        break
                    depth -= 1
                elif depth == 0 and colon < 0 and (x == ":" and body[j + 1 : j + 2] != "=" or x == "!" and body[j + 1 : j + 2] != "="):
                    colon = j
                j += 1
            if end < 0:
                return False
            field = body[i + 1 : colon if colon >= 0 else end].strip()
            if field.endswith("=") and not field.endswith(("==", "!=", "<=", ">=")):
                field = field[:-1]
            if field not in self._fields:
                if len(self._fields) > MEMO:
                    self._fields.clear()
                self._fields[field] = self.grammar.match("Field", self.kinds_of(field).replace("\n", ""))[0]
            if not self._fields[field]:
                return False
            if colon >= 0 and body[colon] == ":" and not self._spec(body[colon + 1 : end], level + 1):
                return False
            i = end + 1
        return True

    def shape(self, line: str) -> tuple[str, int]:
        """Class of a logical line ('' if it doesn't parse) and the furthest place."""
        got = self._shape.get(line)
        if got is None:
            ok, far = self.grammar.match("Line", line)
            kind = "s"
            if not ok and line[0] == self.kinds.code("@"):
                ok, far = self.grammar.match("Decorator", line)
                kind = "@"
            elif ok:
                first = self._words.get(line[0], "s")
                if first == "?":
                    first = self._words.get(line[1], "s")
                if first != "s" and self.grammar.match("Open", line)[0]:
                    kind = first
                elif first != "s" and self.grammar.match("Header", line)[0]:
                    kind = first + "B"
            got = (kind if ok else "", far)
            if len(self._shape) > MEMO:
                self._shape.clear()
            self._shape[line] = got
        return got

    def check(self, text: str) -> int | None:
        tokens = self.tokens(text)
        if tokens and text[:1] in " \t\f" and text.strip():
            first = re.match(r"(?:[ \t\f]*(?:\#[^\n]*)?\n)*([ \t\f]*)", text)
            if first[1].strip("\f"):
                return first.end()
        kinds = "".join(map(self.kinds.__getitem__, tokens))
        widths = [t for t in tokens if t[0] == "\n"]
        lines = kinds.split("\n")
        out: list[str] = []
        margins = [0]
        i, n, begin = 0, len(lines), 0
        deeper = False
        while i < n:
            line = lines[i]
            margin = widths[i - 1] if i else ""
            at = begin
            begin += len(line) + 1
            i += 1
            if not line:
                continue
            if self._brackets.search(line):
                depth = 0
                scanned = 0
                while True:
                    for m in self._brackets.finditer(line, scanned):
                        depth += 1 if m[0] in self._open else -1
                        if depth < 0:
                            return self.offset(text, at + m.start())
                    if depth == 0:
                        break
                    if i >= n:
                        return len(text)
                    scanned = len(line) + 1
                    line += "\n" + lines[i]
                    begin += len(lines[i]) + 1
                    i += 1
            width = len(margin.replace("\n", "").rpartition("\f")[2].expandtabs(8))
            if width != margins[-1]:
                if width > margins[-1]:
                    if not deeper:
                        return self.offset(text, at)
                    margins.append(width)
                    out.append(">")
                else:
                    while margins[-1] > width:
                        margins.pop()
                        out.append("<")
                    if margins[-1] != width or deeper:
                        return self.offset(text, at)
            elif deeper:
                return self.offset(text, at)
            kind, far = self.shape(line)
            if not kind:
                return self.offset(text, at + far)
            out.append(kind)
            deeper = kind in "ielwtxnudmc"
        if deeper:
            return len(text)
        out.append("<" * (len(margins) - 1))
        return None if self._reduced("".join(out)) else self._suite_failure(text, "".join(out), lines)

    def _reduced(self, classes: str) -> bool:
        while True:
            before = classes
            for pattern, to in self._reduce:
                classes = pattern.sub(to, classes)
            if classes == before:
                break
        return classes in ("", "s") or self._suites.match("File", classes)[0]

    def _suite_failure(self, text: str, classes: str, lines: list[str]) -> int:
        far = self._suites.match("File", classes)[1]
        nth = sum(c not in "<>B" for c in classes[:far])
        begin, depth = 0, 0
        for line in lines:
            at = begin
            begin += len(line) + 1
            if not line:
                continue
            if depth == 0:
                if nth == 0:
                    return self.offset(text, at)
                nth -= 1
            depth += sum(1 if m[0] in self._open else -1 for m in self._brackets.finditer(line))
        return len(text)


_MADE: dict[str, Language] = {}


def language(name: str) -> Language:
    if name not in _MADE:
        _MADE[name] = {"python": Python, "javascript": lambda: Script(False), "typescript": lambda: Script(True), "java": Java, "go": Go}[name]()
    return _MADE[name]


_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t].*)?$")
_MARKUP = re.compile(r"\s*(?:<!doctype|<html|<\?xml|<\?php|\#!\s*/(?:usr/)?bin/(?!env (?:python|node)|python|node)|\{\s*\"|#{1,6} \w|---\n|%PDF|PK\x03)", re.I)


def claimed(path: str | None) -> str | None:
    """The language that a path's extension names; None without a grammar for it."""
    name = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


def _fits(lang: str, text: str) -> bool:
    try:
        return language(lang).check(text) is None
    except TooDeep:
        return False


def failure(lang: str, source: str) -> Failure | None:
    """Why a text isn't valid source, and where; None if it is valid."""
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    text = text[1:] if text.startswith("﻿") else text
    try:
        at = language(lang).check(text)
    except TooDeep:
        return Failure(0, "too_deep")
    if at is None:
        return None
    line = text[text.rfind("\n", 0, at) + 1 :].split("\n", 1)[0]
    before = text[: text.rfind("\n", 0, at) + 1].rstrip("\n").rsplit("\n", 1)[-1]
    if _CONFLICT.match(line) or _CONFLICT.match(before) or len(_CONFLICT.findall(text)) >= 3:
        cause = "merge_conflict"
    elif _MARKUP.match(text):
        cause = "other_content"
    elif any(_fits(other, text) for other in ("python", "java", "go", "typescript") if other != lang and not (lang == "javascript" and other == "typescript")):
        cause = "other_language"
    elif not text[at:].strip() or text[at:].count("\n") <= 1 and at > len(text) - 200:
        cause = "truncated_end"
    elif not text[:at].strip() or text[:1] in " \t}":
        cause = "truncated_start"
    else:
        cause = "syntax"
    return Failure(at, cause)


JUDGED = "wiki_id string, rel_path string, language string, valid boolean, fail_at bigint, fail_line int, cause string"


def _judge(cols: dict[str, list]) -> dict[str, list]:
    langs = [claimed(p) for p in cols["rel_path"]]
    out: dict[str, list] = {"wiki_id": cols["wiki_id"], "rel_path": cols["rel_path"], "language": langs, "valid": [], "fail_at": [], "fail_line": [], "cause": []}
    for lang, text in zip(langs, cols["source_text"]):
        bad = failure(lang, text) if lang and text is not None else None
        out["valid"].append(None if lang is None or text is None or (bad and bad.cause == "too_deep") else bad is None)
        out["fail_at"].append(bad and bad.at)
        out["fail_line"].append(bad and text.replace("\r\n", "\n").replace("\r", "\n").count("\n", 0, bad.at) + 1)
        out["cause"].append(bad and bad.cause)
    return out


def judge_files(nodes: DataFrame) -> DataFrame:
    """Every delivery of a file ('module' row, any case) with its verdict.

    `language` is the one the extension names. Files of other extensions, null texts and texts nested too
    deep to parse (cause 'too_deep') have no verdict (null); an
    empty text is judged like any other (a Go file needs its package clause). Positions count code points after line
    ends are brought to '\\n'. Extra columns are ignored; an empty table gives no rows.
    """
    files = nodes.where(F.lower("symbol_type") == "module").select("wiki_id", "rel_path", "source_text")
    return map_rows(spread(files), _judge, JUDGED)


def invalid_files(nodes: DataFrame) -> DataFrame:
    """One row an invalid file; of several deliveries the one that fails first in the text is told."""
    bad = judge_files(nodes).where("not valid")
    return bad.groupBy("wiki_id", "rel_path").agg(F.min(F.struct("fail_at", "fail_line", "cause", "language")).alias("f")).select("wiki_id", "rel_path", "f.language", "f.fail_at", "f.fail_line", "f.cause")


def invalid_rates(nodes: DataFrame) -> DataFrame:
    """Judged files, invalid ones and their share for each repository and claimed language; each file counts once."""
    files = judge_files(nodes).where("valid is not null").groupBy("wiki_id", "rel_path", "language").agg(F.min("valid").alias("valid"))
    return files.groupBy("wiki_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("rate")
    )
