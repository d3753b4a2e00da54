"""Questions in plain words as structured filters.

Every word gets a class, written as one letter; a question is then a short string of letters, and the phrases that
matter (a place, a relation with its object, a kind) are regular expressions over that string. What a phrase has used
is blanked out before the next one is sought; the words left over are the text to search for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# --- Fixed values: vocabulary of the natural-language front end -------------------------------------------------------
TYPE_WORDS = {
    "class": "class", "classes": "class", "function": "function", "functions": "function", "func": "function", "funcs": "function", "method": "method", "methods": "method", "interface": "interface", "interfaces": "interface",
    "struct": "struct", "structs": "struct", "enum": "enum", "enums": "enum", "constant": "constant", "constants": "constant", "trait": "trait", "traits": "trait", "module": "module_doc", "modules": "module_doc",
}
FOLDER_WORDS = ("module", "modules", "package", "packages", "directory", "folder", "dir", "file")
RELATION_WORDS = {
    "inherits": "inheritance", "inherit": "inheritance", "extends": "inheritance", "extend": "inheritance", "extending": "inheritance", "subclass": "inheritance", "subclasses": "inheritance", "inheritance": "inheritance",
    "implements": "implementation", "implement": "implementation", "implementing": "implementation", "implementation": "implementation", "composition": "composition", "composes": "composition", "composed": "composition",
    "aggregation": "aggregation", "aggregates": "aggregation", "calls": "calls", "call": "calls", "calling": "calls", "invokes": "calls", "imports": "imports", "import": "imports", "importing": "imports", "exports": "exports", "export": "exports",
    "defines": "defines", "define": "defines", "defining": "defines", "contains": "contains", "contain": "contains", "decorates": "decorates", "decorator": "decorates", "annotates": "annotates", "assigns": "assigns", "returns": "returns",
    "parameter": "parameter", "reads": "reads", "writes": "writes", "references": "references", "reference": "references", "ref": "references", "uses": "uses", "use": "uses", "using": "uses", "uses_type": "uses_type",
    "creates": "creates", "create": "creates", "instantiates": "instantiates", "constructs": "creates", "specializes": "specializes", "declares": "declares", "defines_body": "defines_body", "overrides": "overrides",
    "hides": "hides", "captures": "captures", "alias_of": "alias_of", "alias": "alias_of",
}
INTENT_WORDS = {
    "architecture": "architecture", "architectural": "architecture", "structure": "architecture", "overview": "architecture", "implementation": "implementation", "detail": "implementation",
    "security": "security", "auth": "security", "authentication": "security", "integration": "integration", "integrates": "integration", "debugging": "debugging", "debug": "debugging", "bug": "debugging",
}
PLACE_WORDS = ("in", "from", "under", "inside", "within", "of")

# --- Closed word classes of English: words that carry no content of their own -----------------------------------------
ARTICLES = ("a", "an", "the")
RELATIVES = ("that", "which", "who", "whom", "whose")
QUESTION_WORDS = ("how", "what", "when", "where", "why")
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them", "my", "your", "his", "her", "its", "our", "their", "this", "these", "those", "there", "here")
AUXILIARIES = ("am", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "has", "have", "had", "can", "could", "may", "might", "must", "shall", "should", "will", "would")
PREPOSITIONS = ("about", "after", "as", "at", "before", "between", "by", "during", "for", "into", "on", "over", "through", "to", "with", "without")
CONJUNCTIONS = ("and", "but", "if", "nor", "or", "so", "than", "then", "because", "while")
QUANTIFIERS = ("all", "any", "both", "each", "every", "few", "many", "more", "most", "much", "no", "not", "some", "such")
ADVERBS = ("also", "just", "only", "too", "very")
REQUESTS = ("find", "get", "give", "list", "please", "show", "tell", "work", "works")
EMPTY_WORDS = frozenset((*ARTICLES, *RELATIVES, *QUESTION_WORDS, *PRONOUNS, *AUXILIARIES, *PREPOSITIONS, *PLACE_WORDS, *CONJUNCTIONS, *QUANTIFIERS, *ADVERBS, *REQUESTS))

#: Word classes: / path, P place word, D article, Q relative, M both kind and folder (module), T kind, F folder, R relation, S empty, W content.
_WORD = re.compile(r"[\w./*]*\w[\w./*]*")
_PLACE = re.compile(r"PD?(?:[MF](?P<after>[WTR/])|(?P<path>/)|(?P<before>W)[MF]|(?P<alone>W)(?![WTR]))|[FM](?P<named>W)(?=$|[QRPS])")
_RELATION = re.compile(r"R(?:[SDQP]*(?P<object>[WTMF/]))?")


def word_class(word: str) -> str:
    low = word.lower()
    if "/" in word or "*" in word or re.fullmatch(r"\w+(\.\w+)+", word):
        return "/"
    for letter, known in (("D", ARTICLES), ("Q", RELATIVES), ("P", PLACE_WORDS)):
        if low in known:
            return letter
    if low in TYPE_WORDS:
        return "M" if low in FOLDER_WORDS else "T"
    if low in FOLDER_WORDS:
        return "F"
    if low in RELATION_WORDS:
        return "R"
    return "S" if low in EMPTY_WORDS else "W"


@dataclass
class Question:
    words: list[str] = field(default_factory=list)
    type: str | None = None
    path: str | None = None
    relation: str | None = None
    related: str | None = None
    intent: str = "general"

    @property
    def has_filters(self) -> bool:
        return any((self.type, self.path, self.relation, self.related))

    def to_jql(self) -> str:
        quote = lambda v: f'"{v}"' if " " in v else v
        parts = []
        if self.type:
            parts.append(f"type:{self.type}")
        if self.path:
            parts.append("file:" + (self.path if re.search(r"[*?]", self.path) else self.path.rstrip("/") + "/*"))
        if self.related:
            parts.append("related:" + quote(self.related))
        if self.relation:
            parts.append(f"has_rel:{self.relation}")
        if self.words:
            parts.append("text:" + quote(" ".join(self.words)))
        return " ".join(parts)


def parse_question(text: str) -> Question:
    """A question as filters: a place, a relation with its object, a kind, an intent, and the content words left.

    The first phrase of each sort counts. A question without content gives an empty result.
    """
    words = [w.strip(".") for w in _WORD.findall(text)]
    letters = "".join(map(word_class, words))
    q = Question()

    def use(found: re.Match, group: str | None = None) -> str:
        nonlocal letters
        at = found.start(group) if group else found.start()
        letters = letters[: found.start()] + "." * len(found[0]) + letters[found.end() :]
        return words[at]

    place = _PLACE.search(letters)
    if place:
        q.path = use(place, place.lastgroup)
    relation = _RELATION.search(letters)
    if relation:
        q.relation = RELATION_WORDS[words[relation.start()].lower()]
        named = use(relation, relation.lastgroup)
        q.related = named if relation.lastgroup else None
    kind = re.search("[TM]", letters)
    if kind:
        q.type = TYPE_WORDS[use(kind).lower()]
    left = [w.lower() for w, c in zip(words, letters) if c in "WR/"]
    q.intent = next((INTENT_WORDS[w] for w in left if w in INTENT_WORDS), "general")
    q.words = [w for w in left if len(w) > 1]
    return q


def keywords(text: str, parts: bool = True) -> list[str]:
    """Content words of a query in order and once each; with `parts`, compound identifiers also come taken apart."""
    out: list[str] = []
    for w in re.findall(r"\w+", text):
        pieces = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", w) if parts else []
        out += [x.lower() for x in (w, *pieces)]
    return [w for w in dict.fromkeys(out) if len(w) > 1 and w not in EMPTY_WORDS]
