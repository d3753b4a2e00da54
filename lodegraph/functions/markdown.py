"""Markdown: front matter, links, wiki links, headings, code fences, and chunks. Column functions where SQL can say it, one table function for chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = r"(?ms)^(```|~~~).*?^\1[^\n]*$"


def without_code(text: Column) -> Column:
    """Text without fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(text, _FENCE, ""), r"`[^`\n]*`", "")


def front_matter(text: Column) -> Column:
    """The block between --- lines at the top, '' without one."""
    return F.regexp_extract(text, r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)


def front_value(text: Column, key: str) -> Column:
    """A scalar of the front matter without quotes; null where it is missing."""
    raw = F.regexp_extract(front_matter(text), rf"(?m)^{key}:[ \t]*(.+?)[ \t]*$", 1)
    return F.when(raw != "", F.regexp_replace(raw, r"""^["']|["']$""", ""))


def links(text: Column) -> Column:
    """Targets of inline links outside code, anchors kept."""
    return F.regexp_extract_all(without_code(text), F.lit(r"(?<!\!)\[[^\]\n]*\]\(([^)\s]+)[^)]*\)"), 1)


def wikilinks(text: Column) -> Column:
    """Targets of [[page|label]] links, labels and anchors cut."""
    return F.transform(F.regexp_extract_all(without_code(text), F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), 1), F.trim)


def link_kind(target: Column) -> Column:
    return F.when(target.rlike("(?i)^(https?|mailto|ftp):"), "external").when(target.startswith("#"), "anchor").when(target.rlike(r"(?i)\.(png|jpe?g|gif|svg|pdf|zip)(#|\?|$)"), "attachment").otherwise("internal")


def headings(text: Column) -> Column:
    """Heading lines outside code."""
    return F.regexp_extract_all(F.regexp_replace(text, _FENCE, ""), F.lit(r"(?m)^(#{1,6}[ \t]+[^\n]+?)[ \t]*$"), 1)


def first_paragraph(text: Column) -> Column:
    """The first block of prose after front matter and headings."""
    body = F.regexp_replace(text, r"(?s)^---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", "")
    prose = F.filter(F.split(F.regexp_replace(body, _FENCE, ""), r"\r?\n\s*\r?\n"), lambda p: (F.trim(p) != "") & ~F.trim(p).rlike(r"^(#|\||[-*] |\d+\. |<|\[)"))
    return F.trim(F.get(prose, F.lit(0)))


def diagrams(text: Column) -> Column:
    """Bodies of mermaid blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^```mermaid[^\n]*\n(.*?)^```"), 1)


#: Estimated tokens above which a section is cut again at third-level headings; lines of a plain text chunk.
SECTION_TOKENS, PLAIN_LINES = 2000, 30
CHUNKS = "chunk_id string, chunk_no int, heading string, text string"


def chunk(text: str, key: str) -> list[tuple[str, int, str, str]]:
    """Chunks at first and second level headings outside fences, at third level ones where a section is too long.

    A text without headings is one chunk. Ids hash the key, the number and the heading, so they stay while these do.
    """

    def cut(lines: list[str], level: str) -> list[tuple[str, list[str]]]:
        parts, fence = [("", [])], False
        for line in lines:
            if line.lstrip().startswith(("```", "~~~")):
                fence = not fence
            if not fence and re.match(rf"#{{{level}}}\s+\S", line):
                parts.append((line.lstrip("#").strip(), []))
            parts[-1][1].append(line)
        return [(h, ls) for h, ls in parts if any(x.strip() for x in ls)]

    out = []
    for heading, lines in cut(text.splitlines(), "1,2"):
        whole = "\n".join(lines)
        parts = cut(lines, "3") if len(whole) / 4 > SECTION_TOKENS else [(heading, lines)]
        out += [(h or heading, "\n".join(ls)) for h, ls in parts]
    return [(hashlib.sha256(f"{key}|{i}|{h}".encode()).hexdigest()[:16], i, h, t) for i, (h, t) in enumerate(out)]


def chunk_plain(text: str, key: str, lines: int = PLAIN_LINES) -> list[tuple[str, int, str, str]]:
    """Chunks of a fixed number of lines."""
    rows = text.splitlines()
    parts = ["\n".join(rows[i : i + lines]) for i in range(0, len(rows), lines)]
    return [(hashlib.sha256(f"{key}|{i}".encode()).hexdigest()[:16], i, "", t) for i, t in enumerate(parts)]


def chunks(docs: DataFrame, key: str, column: str, plain: bool = False) -> DataFrame:
    """One row a chunk of each text; null and blank texts have none."""
    kind = dict(docs.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, *c) for k, t in zip(pdf[key], pdf[column]) if t and t.strip() for c in (chunk_plain if plain else chunk)(t, str(k))]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "chunk_no", "heading", "text"])

    return docs.select(key, column).mapInPandas(run, f"{key} {kind}, {CHUNKS}")
