"""Fill containers of a fixed token capacity: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.batches import map_rows, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents of one randomised group: what one task packs. A group leaves about one container partly filled.
GROUP_DOCS = 10_000
#: Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ITEMS = "doc_id bigint, piece_no int, n_tokens int, start_at bigint, end_at bigint"
PACKED = "container_id bigint, doc_id bigint, piece_no int, n_tokens int, start_at bigint, end_at bigint"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, path: str, capacity: int) -> list[tuple[int, int, int]]:
    """(tokens, start, end) of a text: itself where it fits, else runs of at most `capacity` of its tokens.

    A cut never falls inside a character; offsets are code points, and the pieces joined give the text.
    """
    enc = encoding(path)
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(len(tokens), 0, len(text))]
    raw = text.encode("utf-8", "surrogatepass")
    is_start = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([np.cumsum(is_start) - is_start, [len(text)]])
    ends = np.cumsum([len(b) for b in enc.decode_tokens_bytes(tokens)])
    whole = np.append(is_start, True)[ends]  # a cut after this token is one between characters
    out, at, char = [], 0, 0
    while at < len(tokens):
        to = min(at + capacity, len(tokens))
        while to > at + 1 and not whole[to - 1]:
            to -= 1
        end = int(chars[ends[to - 1]])
        out.append((to - at, char, end))
        at, char = to, end
    return out


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; `sizes` descend. A tree of room left finds the first container that fits in log time."""
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    where = np.empty(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < size:
                k += 1
        where[i] = k - leaves
        room[k] -= size
        k //= 2
        while k:
            left, right = room[2 * k], room[2 * k + 1]
            best = left if left >= right else right
            if room[k] == best:
                break
            room[k] = best
            k //= 2
    return where


def items(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Token counts of every non-blank text, oversized texts as pieces. Null, empty and blank texts are no items."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [(d, k, n, a, b) for d, t in zip(cols["doc_id"], cols["text"]) if t and not t.isspace() for k, (n, a, b) in enumerate(pieces(t, path, capacity))]
        return dict(zip(("doc_id", "piece_no", "n_tokens", "start_at", "end_at"), map(list, zip(*rows)))) if rows else {c.split()[0]: [] for c in ITEMS.split(", ")}

    return map_rows(spread(docs.select("doc_id", "text")), run, ITEMS)


def pack(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row an item or piece with its container; no container holds more than `capacity` tokens.

    Groups are drawn by a hash of doc_id, one for every `group_docs` rows of the table, so no group grows with the
    data and no source or repository dominates one. Repeated rows are items of their own. Ties go by doc_id and piece.
    Only five numbers an item are shuffled. An empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    grouped = items(docs, path, capacity).withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        pdf["container_id"] = pdf["grp"].astype("int64") * 2**32 + first_fit_decreasing(pdf["n_tokens"].to_numpy(), capacity)
        return pdf[[c.split()[0] for c in PACKED.split(", ")]]

    return grouped.groupBy("grp").applyInPandas(run, PACKED)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least number of containers any packing needs, and the share of room that is used."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("max_used"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
