"""Held-out evaluation passages inside training text, whole or in part, reformatted or lightly edited.

Texts and passages are brought to plain words (markup, case, layout, look-alike characters and soft breaks undone).
Word trigrams of the passages are the seeds. One pass over all documents counts in how many each seed occurs; a second
joins documents to items by seeds that are rare for the item, and scores each such pair by Smith-Waterman alignment of
words, however large the corpus is and whatever else of the item is in it. Both passes are map-side: what leaves a task is counts of the seeds of the items, and the results.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.batches import spread

#: Share of a passage's words that must align; seeds of an item count as rare up to this quantile of their frequencies.
SHARE, RARE = 0.5, 0.8
#: Distinct seeds rare for the item that a document must hold before the pair is aligned.
LEAST_SEEDS = 2
#: Alignment: scores of a match, a mismatch and a gap word, so that a stretch needs well over half of its words (sentences of one template don't align);
#: stretches taken together, and matches that a later stretch must have.
MATCH, MISMATCH, GAP = 2, -3, -2
STRETCHES, STRETCH_WORDS = 5, 5
#: Items of one broadcast, and the words they may have together; more items run in further passes.
BLOCK, BLOCK_WORDS = 50_000, 5_000_000

# --- Fixed values: letters of other scripts that look like Latin ones -----------------------------------------------
_CYRILLIC = str.maketrans("аеорсухівѕјԁһкмтнАЕОРСУХІВЅЈКМТН", "aeopcyxibsjdhkmtnaeopcyxibsjkmtn")
#: Greek capitals look like other letters than their small forms do, so these hold in Latin text only.
_GREEK = str.maketrans("αοριυνκτεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopiuvkteabezhikmnoptyx")
_GREEK_LETTER, _LATIN_LETTER = re.compile("[Ͱ-Ͽ]"), re.compile("[A-Za-z]")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿︀-️̀-ͯ]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_SOFT = re.compile(r"(?<=[A-Za-z])[-‐‑]\s*\n[\s>#*/]*(?=[a-z])")
#: A word: a run of letters and digits; in scripts written without spaces each character is one.
_WORDS = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


def words(text: str) -> list[str]:
    """The plain words of a text, lower case, in order."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).translate(_CYRILLIC)
        if len(_GREEK_LETTER.findall(text)) < len(_LATIN_LETTER.findall(text)):
            text = text.translate(_GREEK)
    if "\n" in text:
        text = _SOFT.sub("", text)
    return _WORDS.findall(text.casefold())


@dataclass
class Seeds:
    """Vocabulary and seeds of a block of items. seeds: sorted codes; owner rows (seed, item) by seed."""

    vocab: dict[str, int]
    items: list[tuple[int, np.ndarray]]
    codes: np.ndarray
    pair_seed: np.ndarray
    pair_item: np.ndarray

    def encode(self, text: str) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seed indices found in a text, and where."""
        if len(ids) < 3:
            return np.empty(0, int), np.empty(0, int)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        if not len(at) or not len(self.codes):
            return np.empty(0, int), np.empty(0, int)
        code = _code(a[at], b[at], c[at], len(self.vocab) + 1)
        pos = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[pos] == code
        return pos[ok], at[ok]


def _code(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return (a * n + b) * n + c


def build_seeds(passages: list[tuple[int, str]]) -> Seeds:
    vocab: dict[str, int] = {}
    items = []
    for item, text in passages:
        items.append((item, np.array([vocab.setdefault(w, len(vocab) + 1) for w in words(text)], np.int64)))
    n = len(vocab) + 1  # at most 2^21 words, so a code fits 63 bits
    if n > 1 << 21:
        raise ValueError("too many distinct words in a block of items; lower BLOCK")
    codes, owners = [], []
    for k, (_, ids) in enumerate(items):
        own = np.unique(_code(ids[:-2], ids[1:-1], ids[2:], n)) if len(ids) >= 3 else np.empty(0, np.int64)
        codes.append(own)
        owners.append(np.full(len(own), k))
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    unique, seed = np.unique(flat, return_inverse=True)
    order = np.argsort(seed, kind="stable")
    return Seeds(vocab, items, unique, seed[order], (np.concatenate(owners) if owners else np.empty(0, int))[order])


def rare_seeds(seeds: Seeds, df: np.ndarray) -> np.ndarray:
    """Whether the seed of each (seed, item) pair is rare: not among the most frequent ones of its item.

    What is common is judged within the item, so an item that leaked into a third of all documents keeps its seeds.
    """
    freq, item = df[seeds.pair_seed], seeds.pair_item
    order = np.lexsort((freq, item))
    n = np.bincount(item, minlength=len(seeds.items))
    first = np.cumsum(n) - n
    last = first + np.floor(np.maximum(n - 1, 0) * RARE).astype(int)
    bound = np.zeros(len(n), df.dtype)
    bound[n > 0] = freq[order][last[n > 0]]
    return freq <= bound[item]


def align(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Matched (item word, document word) places of the best local alignment.

    m words of an item gain at most MATCH * m, so no alignment with a positive score covers more than
    m + MATCH * m / -GAP = 2 m words of the document. Blocks of 4 m words that overlap by half hold each of them whole, and
    the memory needed depends on the item alone.
    """
    m, n = len(item), len(doc)
    best, out = 0, []
    for at in range(0, max(1, n - 2 * m), 2 * m):
        score, got = _align(item, doc[at : at + 4 * m])
        if score > best:
            best, out = score, [(i, j + at) for i, j in got]
    return out


def _align(item: np.ndarray, doc: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    m, n = len(item), len(doc)
    # Column j is kept higher by -GAP * j, so that gaps along a row cost nothing and become a running maximum.
    lift = -GAP * np.arange(n + 1, dtype=np.int32)
    step = np.where(doc == item[:, None], MATCH - GAP, MISMATCH - GAP).astype(np.int32)
    h = np.empty((m + 1, n + 1), np.int32)
    h[0], h[:, 0] = lift, 0
    up = np.empty(n, np.int32)
    for i in range(m):
        row = h[i + 1, 1:]
        np.add(h[i, :-1], step[i], out=row)
        np.add(h[i, 1:], GAP, out=up)
        np.maximum(row, up, out=row)
        np.maximum(row, lift[1:], out=row)
        np.maximum.accumulate(row, out=row)
    h -= lift
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    top, out = int(h[i, j]), []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
            if same:
                out.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return top, out[::-1]


def in_order(item: np.ndarray, doc: np.ndarray) -> int:
    """Length of the longest common subsequence: the most words that stretches in order can match. One step of bit operations a word."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    open_bits = full
    for w in doc.tolist():
        at = places.get(w)
        if at is not None:
            hit = open_bits & at
            open_bits = (open_bits + hit | open_bits - hit) & full
    return len(item) - open_bits.bit_count()


class _Part:
    """A part of an item against a part of a document; aligned when first asked for."""

    def __init__(self, item: np.ndarray, doc: np.ndarray):
        self.item, self.doc, self.most = item, doc, in_order(item, doc)

    @cached_property
    def matches(self) -> list[tuple[int, int]]:
        return align(self.item, self.doc)


def matched_words(item: np.ndarray, doc: np.ndarray, need: float = 0) -> int:
    """Words of the item that align in order over at most STRETCHES stretches.

    The best stretch splits item and document; what lies before both and after both is searched for further ones. Each
    part is aligned once. A pair that can't come to `need` words any more is given up, so below `need` the number is only
    known to be below it.
    """
    total = 0
    parts = [_Part(item, doc)]
    for k in range(STRETCHES):
        least = STRETCH_WORDS if k else 1
        parts = [p for p in parts if p.most >= least]
        if not parts or total + sum(p.most for p in parts) < need:
            break
        best = max(parts, key=lambda p: len(p.matches))
        if len(best.matches) < least:
            break
        total += len(best.matches)
        (i0, j0), (i1, j1) = best.matches[0], best.matches[-1]
        parts.remove(best)
        parts += [_Part(best.item[:i0], best.doc[:j0]), _Part(best.item[i1 + 1 :], best.doc[j1 + 1 :])]
    return total


def near(doc: np.ndarray, at: np.ndarray, reach: int, apart: int) -> np.ndarray:
    """The words of a document within `reach` of any seed; far parts hold no seed of this item and are left out.

    In the place of a part left out stand words that match nothing, as many as the part has or `apart` if it has more:
    with more of them than an item has words no alignment bridges the gap, as none does in the whole document.
    """
    if len(doc) <= 4 * reach:
        return doc
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, np.maximum(at - reach, 0), 1)
    np.add.at(edge, np.minimum(at + reach, len(doc)), -1)
    kept = np.cumsum(edge)[:-1] > 0
    since = np.arange(len(doc)) - np.maximum.accumulate(np.where(kept, np.arange(len(doc)), -1))
    return np.where(kept, doc, -1)[kept | (since <= apart)]


def leaks_of(text: str, seeds: Seeds, rare: np.ndarray) -> list[tuple[int, int, int]]:
    """(item_id, matched words, words of the item) for each item that leaked into the text."""
    ids = seeds.encode(text)
    hit, at = seeds.hits(ids)
    if len(hit) < LEAST_SEEDS:
        return []
    found = np.unique(hit)
    lo, hi = np.searchsorted(seeds.pair_seed, found), np.searchsorted(seeds.pair_seed, found, "right")
    pairs = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
    many = np.bincount(seeds.pair_item[pairs], rare[pairs], len(seeds.items))
    out = []
    for k in np.flatnonzero(many >= LEAST_SEEDS):
        item, passage = seeds.items[k]
        own = np.isin(hit, seeds.pair_seed[pairs[seeds.pair_item[pairs] == k]])
        window, need = near(ids, at[own], 2 * len(passage), len(passage) + 1), SHARE * len(passage)
        n = matched_words(passage, window, need)
        if n >= need:
            out.append((item, n, len(passage)))
    return out


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int32()), ("item_words", pa.int32())])


def find_leaks(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """One row a (doc_id, item_id): at least half of the passage's words align with the document in order.

    Copies of a document are rows of their own. Null, empty and blank texts and passages match nothing; a passage of
    fewer than three words has no seed and is found nowhere. Repeated rows of one id yield a pair once. Tables without
    rows give none. Items are read in blocks (BLOCK, BLOCK_WORDS), so what is held and broadcast is bounded however many
    there are; each block costs two passes over the documents.
    """
    spark = docs.sparkSession
    bare = docs.where("text is not null").select("doc_id", "text")
    items = evals.where("passage is not null").select("item_id", "passage").distinct().orderBy("item_id", "passage").toLocalIterator(prefetchPartitions=False)
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, matched_words int, item_words int")
    spread_docs = spread(bare)
    for block in _blocks((r.item_id, r.passage) for r in items):
        out = out.unionByName(_block(spread_docs, spark.sparkContext.broadcast(build_seeds(block))))
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def _blocks(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most BLOCK items and about BLOCK_WORDS words (by their characters); one list is held at a time."""
    block, size = [], 0
    for item, passage in items:
        if block and (len(block) == BLOCK or size + len(passage) > 6 * BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append((item, passage))
        size += len(passage)
    if block:
        yield block


def _block(docs: DataFrame, seeds) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        total = np.zeros(len(s.codes), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[np.unique(s.hits(s.encode(text))[0])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["seed", "n"])

    # As many rows as there are distinct seeds of a block of items, whatever the corpus.
    df = np.zeros(max(1, len(seeds.value.codes)), np.int64)
    for r in docs.mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        df[r.seed] = r.n
    rare = docs.sparkSession.sparkContext.broadcast(rare_seeds(seeds.value, df))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, r = seeds.value, rare.value
        for batch in batches:
            got = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in leaks_of(t, s, r)]
            cols = list(zip(*got)) if got else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, FOUND)], schema=FOUND)

    return docs.mapInArrow(find, "doc_id bigint, item_id bigint, matched_words int, item_words int")
