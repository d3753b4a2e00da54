"""Source files that nobody wrote by hand here: generated, minified, vendored, or data kept as code.

Character trigram models of names decide. Identifiers train one model a language: mangled names have a high cross-entropy
under it (minified). Names that only a counter tells apart have a low diversity (generated), names with next to no
control words around them and literals for the rest are data. A second pair of models is trained on the names files go
by (folders, packages, types, words of the head comment) in foreign and in other files: a file one of whose names reads
much more like the foreign ones is vendored, wherever it lies.

Folders of third-party code and head comments that state a copy label the files the foreign model is trained on. What a
file declares of itself (those, and statements that it is generated) is a verdict only where no model has one; a column
says which of the two told.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.batches import map_rows, spread

# --- Fixed values -------------------------------------------------------------------------------------------------
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go"}
#: Folders that hold third-party code by convention.
VENDOR_FOLDERS = ("vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external", "externals", "_vendor", "_vendored", "contrib/upstream", "deps", "Godeps/_workspace", "site-packages", "jspm_packages")
_VENDOR_PATH = re.compile("(?:^|/)(?:" + "|".join(VENDOR_FOLDERS) + ")(?=/[^/]+/)")
#: How a head comment states that the file is a copy of something else, or that a tool wrote it.
VENDORED_HEAD = re.compile(r"(?i)^(?:upstream(?: source| project)?\s*:\s*[a-z]|[a-z][\w.-]*?\s+v?\d+(?:\.\d+){1,3}\s*(?:[-–|].*\b(?:unmodified|vendored|imported|do not reformat|bundle)\b.*|$)|(?:vendored|imported|copied|taken)\s+(?:unmodified\s+)?from\s+[a-z])")
GENERATED_HEAD = re.compile(r"(?i)^(?:@generated\b|<auto-?generated\s*/?>|(?:this (?:file|code) (?:was|is) |code |auto(?:matically)?[- ]?)generated\b)")
_COMMENT_LINE = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+/?|--|;+|<!--)?\s?(.*?)\s*(?:\*/|-->)?\s*$")
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_LITERAL = re.compile(r"""0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[\[\]{},:]""")
_COMMENT = re.compile(r"(\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')|/\*.*?\*/|//[^\n]*|(?m:^[ \t]*#[^\n]*)|\"\"\".*?\"\"\"|'''.*?'''", re.DOTALL)
_DECLARED = re.compile(r"\b(?:def|function|func|class|interface|struct|type|const|let|var|enum)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_$][\w$]*)|\b(?:public|private|protected|static)\b[\w<>\[\], ]*?\s([A-Za-z_$][\w$]*)\s*\(")
_TYPES = re.compile(r"\b(?:class|interface|struct|enum|type)\s+([A-Za-z_$][\w$]*)")
#: So many plain words in a row make a sentence, which is about something, rather than a line of names.
_SENTENCE = re.compile(r"(?:\b[a-z]+[, ]+){6}")
_VERSION = re.compile(r"[-@]?v?\d+(?:\.\d+)+$")
_PACKAGE = re.compile(r"^\s*package\s+([\w.]+)", re.M)
_COUNTER = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

SYMBOLS = "_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789$"
_INDEX = np.zeros(256, np.int64)
_INDEX[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)
BASE = len(SYMBOLS) + 1  # 0 marks the ends of a name

#: Verdicts. Cross-entropy in bits a character above the language's mean from which names count as mangled, the share
#: of such names, and the characters a line that no hand writes; names a template makes at least and their diversity;
#: share of literals and control words at most of a data file; bits a character by which one name of a file must read
#: more like those of foreign files than like the others; counts added to each trigram.
EXCESS_BITS, MANGLED_SHARE, LONG_LINE = 1.0, 0.3, 160
TEMPLATE_NAMES, TEMPLATE_COUNTERS, DIVERSITY = 6, 4, 0.4
DATA_SHARE, DATA_CONTROL = 0.55, 2
FOREIGN_BITS, SMOOTHING = 1.5, 0.1
LANGUAGES = ("python", "javascript", "typescript", "java", "go")


def language_of(path: str | None, language: str | None) -> str:
    ext = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    found = EXTENSIONS.get(ext) or (language or "").strip().lower()
    return found if found in LANGUAGES else "other"


def trigrams(names: list[str]) -> np.ndarray:
    """Trigram codes of all names, one for each character and one for the end, name after name."""
    text = "".join("\n\n" + n + "\n" for n in names)
    codes = _INDEX[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    sizes = np.array([len(n) + 1 for n in names])
    first = np.cumsum(sizes + 2) - sizes - 2  # a name's first trigram begins at its two start marks
    at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return ((a * BASE + b) * BASE + c)[at]


def entropies(names: list[str], logp: np.ndarray) -> np.ndarray:
    """Mean bits a character of each name under a model."""
    if not names:
        return np.empty(0)
    code = trigrams(names)
    sizes = np.array([len(n) + 1 for n in names])
    owner = np.repeat(np.arange(len(names)), sizes)
    return np.bincount(owner, -logp[code], len(names)) / sizes


def model(counts: np.ndarray) -> np.ndarray:
    """log2 P(third | first two) of every trigram, smoothed with SMOOTHING counts."""
    rows = (counts + SMOOTHING).reshape(-1, BASE)
    return np.log2(rows / rows.sum(1, keepdims=True)).ravel()


def head_lines(text: str) -> list[str]:
    """The comment lines a file begins with, without their marks."""
    out = []
    for line in io.StringIO(text):
        line = line.removesuffix("\n")
        s = line.strip()
        if s and not s.startswith(("//", "#", "/*", "*", "--", "<!--")):
            break
        m = _COMMENT_LINE.match(line)
        out.append(m[1] if m else s)
    return out


def identifiers(text: str) -> list[str]:
    return list(dict.fromkeys(_IDENT.findall(text)))


def _prose(string: str) -> bool:
    return string.count(" ") > 3 and sum(c.isalpha() or c == " " for c in string) > 0.9 * len(string)


def literal_share(text: str) -> float:
    # A string of several words is prose for people, not data.
    bare = re.sub(r"\s+", "", _COMMENT.sub(lambda m: "x" if m[1] and _prose(m[1]) else m[1] or "", text))
    return sum(map(len, _LITERAL.findall(bare))) / max(1, len(bare))


def diversity(text: str) -> tuple[int, float]:
    """Declared names with a counter (none where few counters differ), and distinct templates (first word and shape) a declared name."""
    names = [a or b for a, b in _DECLARED.findall(text)]
    if not names:
        return 0, 1.0
    counters = {c for n in names for c in _COUNTER.findall(n)[-1:]}
    counted = [n for n in names if _COUNTER.search(n)] if len(counters) >= TEMPLATE_COUNTERS else []
    shapes = {(_WORDS.findall(n) or [n])[0] + "#" + re.sub(r"[A-Za-z]+", "w", _COUNTER.sub("0", n)) for n in names}
    return len(counted), len(shapes) / len(names)


def declared(path: str | None, text: str, head: list[str]) -> str | None:
    """What a file says of itself by its folder or head comment: vendored, generated, or None."""
    if _VENDOR_PATH.search(path or "") or text.lstrip().startswith("/*!") or any(VENDORED_HEAD.match(x) for x in head):
        return "vendored"
    return "generated" if any(GENERATED_HEAD.match(x) for x in head) else None


def identities(path: str | None, text: str, head: list[str]) -> list[str]:
    """Lower-case names a file goes by: its folders without the conventional ones, packages, types, words of its head comment outside of sentences."""
    folders = _VENDOR_PATH.sub("", path or "").split("/")[:-1]
    names = [re.sub(r"\W", "_", _VERSION.sub("", f)) for f in folders]
    names += _TYPES.findall(text)
    names += [x for p in _PACKAGE.findall(text) for x in p.split(".")]
    names += [w for line in head if not _SENTENCE.search(line) for w in _IDENT.findall(line)]
    return list(dict.fromkeys(n.lower() for n in names if len(n) > 2))


class Models:
    """Trigram models: identifiers of each language, and names of foreign and of other files."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = {lang: model(counts[lang]) for lang in (*LANGUAGES, "other") if lang in counts}
        # The mean bits a character of what a model was trained on, from its counts.
        self.mean = {lang: float(-(counts[lang] * m).sum() / max(1, counts[lang].sum())) for lang, m in self.names.items()}
        self.foreign = model(counts["foreign"]) - model(counts["own"]) if "foreign" in counts and "own" in counts else None

    def mangled_share(self, lang: str, names: list[str]) -> float:
        if lang not in self.names or len(names) < 8:
            return 0.0
        return float(np.mean(entropies(names, self.names[lang]) > self.mean[lang] + EXCESS_BITS))

    def foreign_bits(self, names: list[str]) -> float:
        """By how many bits a character the most foreign name reads more like those of foreign files."""
        if self.foreign is None or not names:
            return 0.0
        return float(-entropies(names, self.foreign).min())


def judge(path: str | None, language: str | None, text: str, head: list[str], models: Models) -> str | None:
    """What the models make of a file: minified, generated, data, vendored, or None (written by hand here)."""
    lang = language_of(path, language)
    if len(text) / (text.count("\n") + 1) > LONG_LINE and models.mangled_share(lang, identifiers(text)) >= MANGLED_SHARE:
        return "minified"
    counted, div = diversity(text)
    if counted >= TEMPLATE_NAMES and div <= DIVERSITY:
        return "generated"
    if len(text) >= 200 and len(_CONTROL.findall(text)) <= DATA_CONTROL and literal_share(text) >= DATA_SHARE:
        return "data"
    if models.foreign_bits(identities(path, text, head)) > FOREIGN_BITS:
        return "vendored"
    return None


_CONTROL = re.compile(r"\b(?:return|if|for|while|def|func|function|switch|try)\b")
MODELS = (*LANGUAGES, "other", "own", "foreign")
_TRAINED = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's files: at most BASE^3 numbers a model, whatever the data."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("rel_path", "language", "source_text"))):
            head = head_lines(text)
            foreign = declared(path, text, head) == "vendored"
            names = identities(path, text, head)
            for kind, some in ((language_of(path, language), identifiers(text)), ("foreign" if foreign else "own", names)):
                if some:
                    code, n = np.unique(trigrams(some), return_counts=True)
                    if kind not in sums:
                        sums[kind] = np.zeros(BASE**3, np.int64)
                    sums[kind][code] += n
    for kind, table in sums.items():
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(code + MODELS.index(kind) * BASE**3), pa.array(table[code])], schema=_TRAINED)


def train(files: DataFrame) -> Models:
    """Models of all files. What reaches the driver is bounded by alphabet and languages: at most len(MODELS) * BASE^3 pairs of numbers."""
    counts: dict[str, np.ndarray] = {}
    summed = files.mapInArrow(_count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = np.asarray(summed["code"]), np.asarray(summed["n"])
    for i, kind in enumerate(MODELS):
        own = code // BASE**3 == i
        if own.any():
            counts[kind] = np.zeros(BASE**3, np.int64)
            counts[kind][code[own] % BASE**3] = n[own]
    return Models(counts)


FOUND = "wiki_id string, rel_path string, reason string, told_by string"


def not_handwritten(nodes: DataFrame) -> DataFrame:
    """One row a file (wiki_id, rel_path of a 'module' row, any case) that was not written by hand there, why, and what told.

    Reasons: minified, generated, vendored, data; told by names (the models) or by declaration. A file delivered several times counts once; if any delivery is
    judged so, it is. Null or empty texts are judged by the names of their folders alone. Null paths and languages are
    allowed (the language falls back to the column). Extra columns are ignored. An empty table gives no rows. Only
    verdicts are shuffled.
    """
    files = spread(nodes.where(F.lower("symbol_type") == "module").select("wiki_id", "rel_path", "language", F.coalesce("source_text", F.lit("")).alias("source_text")))
    models = nodes.sparkSession.sparkContext.broadcast(train(files))

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = []
        for w, p, lang, t in zip(cols["wiki_id"], cols["rel_path"], cols["language"], cols["source_text"]):
            head = head_lines(t)
            told = judge(p, lang, t, head, models.value)
            said = None if told else declared(p, t, head)
            if told or said:
                found.append((w, p, told or said, "names" if told else "declaration"))
        return {c: [x[i] for x in found] for i, c in enumerate(("wiki_id", "rel_path", "reason", "told_by"))}

    best = F.max(F.struct("told_by", "reason")).alias("b")
    return map_rows(files, run, FOUND).groupBy("wiki_id", "rel_path").agg(best).select("wiki_id", "rel_path", "b.reason", "b.told_by")
