"""Cut oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

All boundaries of all texts of a batch lie in one sorted array. Every boundary is joined to its farthest legal successor
(the best boundary that a piece starting `overlap` before it can reach); the successor table is then squared again and
again, and each squaring marks twice as many of the greedy cuts. No text is walked piece by piece.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.batches import latest, map_rows, spread

LIMIT, OVERLAP = 4000, 200
#: Ranks of boundaries; a piece ends at the best rank in the last half of its reach, there at the farthest place.
HARD, SPACE, SENTENCE, LINE, BLANK = range(5)
_MARKS = re.compile(r"(?P<line>(?:\r\n|\n|\r)(?P<more>(?:[ \t]*(?:\r\n|\n|\r))*))|(?P<end>[.!?;](?=\s))|(?P<space>[ \t\f\v  - 　]+)")
_LINE = re.compile(r"\r\n|\n|\r")

PIECES = "node_id string, piece_no int, n_pieces int, start_at int, end_at int, start_line int, end_line int, piece string"


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end (0 and the length included) and their ranks.

    Where natural boundaries lie farther apart than a step, hard ones are set every step in between.
    """
    at, rank = [0], [BLANK]
    step = limit - overlap
    for m in _MARKS.finditer(text):
        p = m.end()
        r = (BLANK if m["more"] else LINE) if m["line"] else SENTENCE if m["end"] else SPACE
        while p - at[-1] > step:
            at.append(at[-1] + step)
            rank.append(HARD)
        if p > at[-1]:
            at.append(p)
            rank.append(r)
        elif r > rank[-1]:
            rank[-1] = r
    while len(text) - at[-1] > step:
        at.append(at[-1] + step)
        rank.append(HARD)
    if len(text) > at[-1]:
        at.append(len(text))
        rank.append(BLANK)
    else:
        rank[-1] = BLANK
    return np.array(at, np.int64), np.array(rank, np.int8)


def _farthest(mask: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it where mask holds, -1 before the first."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def successors(at: np.ndarray, rank: np.ndarray, owner_end: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary the place where the piece after it starts, and the boundary where that piece ends.

    `at` ascends over all texts (each text shifted beyond the one before). A piece starts at the best boundary of rank
    LINE or more at most `overlap` before the cut, else at any boundary there, else exactly `overlap` before it.
    """
    n = len(at)
    own = np.arange(n)
    lo = np.searchsorted(at, at - overlap, "left")
    first_line = np.full(n + 1, n)
    lines = np.where(rank >= LINE, own, n)
    first_line[:n] = np.minimum.accumulate(lines[::-1])[::-1]
    start = at[np.where(first_line[lo] < own, first_line[lo], lo)]
    start = np.where(start == at, at - overlap, start)
    reach = np.minimum(np.searchsorted(at, start + limit, "right") - 1, owner_end)
    half = np.maximum(at[own], start + limit // 2)
    succ = np.full(n, -1)
    for r in (BLANK, LINE, SENTENCE, SPACE):
        best = _farthest(rank >= r)[reach]
        ok = (best > own) & (at[np.maximum(best, 0)] > half) & (succ < 0)
        succ = np.where(ok, best, succ)
    succ = np.where(succ < 0, reach, succ)
    succ = np.where(reach == owner_end, owner_end, succ)  # what is left fits
    return start, succ


def cut(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """(start, end) of each piece of each text; a text within the limit is one piece, an empty one none.

    `overlap` must be less than half of `limit`, so that every cut lies farther than it from the text's beginning.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half of the limit")
    if not texts:
        return []
    ats, ranks, ends, firsts = [], [], [], []
    base = size = 0
    gap = 2 * limit + overlap
    for t in texts:
        a, r = boundaries(t, limit, overlap)
        firsts.append(size)
        size += len(a)
        ends.append(np.full(len(a), size - 1))
        ats.append(a + base)
        ranks.append(r)
        base += len(t) + gap
    at, rank, end = np.concatenate(ats), np.concatenate(ranks), np.concatenate(ends)
    start, succ = successors(at, rank, end, limit, overlap)
    # A text's first boundary has no piece before it: its piece starts there.
    first = np.array(firsts)
    start[first] = at[first]
    reach = np.minimum(np.searchsorted(at, at[first] + limit, "right") - 1, end[first])
    lead = np.full(len(first), -1)
    for r in (BLANK, LINE, SENTENCE, SPACE):
        best = _farthest(rank >= r)[reach]
        lead = np.where((lead < 0) & (best > first) & (at[np.maximum(best, 0)] > at[first] + limit // 2), best, lead)
    succ[first] = np.where(reach == end[first], end[first], np.where(lead < 0, reach, lead))

    cuts = np.zeros(len(at), bool)
    cuts[first] = True
    jump = succ.copy()
    while True:  # squaring: after k rounds the 2^k nearest cuts of every text are marked
        more = cuts.copy()
        more[jump[cuts]] = True
        if (more == cuts).all():
            break
        cuts, jump = more, jump[jump]
    out: list[list[tuple[int, int]]] = []
    for i, t in enumerate(texts):
        a, b = firsts[i], int(end[firsts[i]])
        shift = int(at[a])
        marked = np.flatnonzero(cuts[a : b + 1]) + a
        out.append([(int(start[c]) - shift, int(at[succ[c]]) - shift) for c in marked if c != b])
    return out


def _line_range(starts: np.ndarray, s: int, e: int, lo: int | None, hi: int | None) -> tuple[int | None, int | None]:
    if lo is None:
        return None, None
    a = lo + int(np.searchsorted(starts, s, "right")) - 1
    b = lo + int(np.searchsorted(starts, max(s, e - 1), "right")) - 1
    return (a, b) if hi is None else (min(a, hi), min(b, hi))


def _pieces(cols: dict[str, list], limit: int, overlap: int) -> dict[str, list]:
    out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
    for node, text, a, b, spans in zip(cols["node_id"], cols["source_text"], cols["start_line"], cols["end_line"], cut(cols["source_text"], limit, overlap)):
        starts = np.array([0, *(m.end() for m in _LINE.finditer(text))])
        known = [x for x in (a, b) if x is not None]
        lo = min(known) if len(known) == 2 else a if a is not None else max(1, b - len(starts) + 1) if b is not None else None
        hi = max(known) if len(known) == 2 else b
        for k, (s, e) in enumerate(spans):
            first, last = _line_range(starts, s, e, lo, hi)
            for name, v in zip(out, (node, k, len(spans), s, e, first, last, text[s:e])):
                out[name].append(v)
    return out


def oversized(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    return nodes.where(F.length("source_text") > limit).select("node_id", "source_text", "start_line", "end_line", "indexed_at")


def split_nodes(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True) -> DataFrame:
    """Pieces of every node whose source_text has more than `limit` code points.

    Each piece has at most `limit` code points and starts at most `overlap` before the end of the piece before, at a
    line start where there is one, at another boundary where there is none, else `overlap` before; so consecutive pieces
    always share text (with overlap > 0), and the pieces cover the text without a gap. Null, empty and short texts give no rows.
    `start_line`/`end_line` of a piece are counted from the node's lower line number (swapped numbers are put in
    order) and never leave the node's range, also where the text has more lines than the range; with only the end
    known lines are counted back from it, with neither they are null. Redelivered nodes (same node_id) count once,
    the latest `indexed_at` wins; with once=False each delivery is cut. Extra columns are ignored.
    """
    rows = oversized(nodes, limit)
    rows = latest(rows, ["node_id"], "indexed_at") if once else spread(rows)
    return map_rows(rows.drop("indexed_at"), lambda c: _pieces(c, limit, overlap), PIECES)
