"""Exact substring dedup by suffix arrays.

Byte windows that start at two places are repeated, and every byte that a repeated
window covers goes. Windows are dealt to shards by content (``anchors``): a shard
holds whole groups of regions that may share windows, so no suffix of a shard has to
be looked for in another one. Each shard is sorted by Larsson-Sadakane refinement in
numpy, from 8 bytes by doubling to the window's length, refining only what is still
tied; Kasai's walk, taken over all regions in step, gives the common prefixes of
neighbours.

A null or empty text has no windows and stays as it is. A text repeated whole goes
whole if it is at least a window long. Rows that repeat an id are documents of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import anchors

LENGTH = 200
GRAM = 64
WORD = 8


def spelled(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, big-endian, zeros behind the end."""
    padded = np.r_[data, np.zeros(WORD, np.uint8)]
    out = np.zeros(len(data), np.uint64)
    for i in range(WORD):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def byte_units(text: bytes) -> np.ndarray:
    return anchors.mix(spelled(np.frombuffer(text, np.uint8))[: max(0, len(text) - WORD + 1)])


def sorted_prefixes(words: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Suffixes with ``length`` bytes left in their region, sorted by these bytes.

    ``words`` are the 8 bytes at each place, ``left`` the bytes left there. A
    suffix's rank is the place of the first suffix that is equal so far; doubling
    sorts ties by the rank of what follows. A suffix takes part as long as its
    region goes on, and once it is alone in its rank it is sorted.
    """
    rank = np.zeros(len(words), np.int64)
    some = np.flatnonzero(left >= WORD)
    order = some[np.argsort(words[some], kind="stable")]
    _number(rank, order, words[order])
    depth = WORD
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        order = order[left[order] >= depth]
        tied = np.r_[False, rank[order[1:]] == rank[order[:-1]]]
        tied[:-1] |= tied[1:].copy()
        places = np.flatnonzero(tied)
        some = order[places]
        key = (rank[some].astype(np.uint64) << np.uint64(32)) | rank[some + step].astype(np.uint64)
        by_key = np.argsort(key, kind="stable")
        order[places] = some[by_key]
        # ranks of the ties: the old rank plus the place within it
        head = rank[order[places]]
        new_rank = np.r_[True, head[1:] != head[:-1]]
        new_key = np.r_[True, key[by_key][1:] != key[by_key][:-1]]
        at = np.arange(len(places))
        first_of_rank = np.maximum.accumulate(np.where(new_rank, at, 0))
        first_of_key = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[order[places]] = head + first_of_key - first_of_rank
    return order


def _number(rank: np.ndarray, order: np.ndarray, keys: np.ndarray) -> None:
    new = np.r_[True, keys[1:] != keys[:-1]] if len(order) else np.empty(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def common_prefixes(
    words: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray, length: int
) -> np.ndarray:
    """Bytes, up to ``length``, that each sorted suffix shares with the one before it.

    Kasai's walk: from one place of a region to the next, the common prefix loses at
    most its first byte if the neighbour's next suffix is still the earlier of the
    two; else it is counted anew. All regions walk at once, eight bytes at a time.
    """
    place = np.full(len(words) + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    shared = np.zeros(len(order), np.int64)
    active = np.argsort(-n, kind="stable")
    sizes = n[active]
    here = first[active]
    known = np.zeros(len(active), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        alive = int(np.searchsorted(-sizes, -t, "left"))
        i = here[:alive] + t
        p = place[i]
        j = order[np.maximum(p - 1, 0)]
        have = known[:alive].copy()
        have[p == 0] = 0
        open_ = np.flatnonzero((p > 0) & (have < length))
        while len(open_):
            a, b, h = i[open_], j[open_], have[open_]
            differ = words[a + h] ^ words[b + h]
            equal = _leading_zero_bytes(differ)
            have[open_] = np.minimum(h + equal, length)
            open_ = open_[(equal == WORD) & (have[open_] < length)]
        shared[p] = have
        next_j = place[j + 1]
        follows = (p > 0) & (next_j >= 0) & (place[i + 1] >= 0) & (next_j < place[i + 1])
        known[:alive] = np.where(follows, np.maximum(have - 1, 0), 0)
    return shared


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), WORD, np.int64)
    for byte in range(WORD - 1, -1, -1):
        out[(x >> np.uint64(8 * (WORD - 1 - byte))) & np.uint64(0xFF) != 0] = byte
    return out


def repeated(contents: list[bytes], n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every window of some regions in turn, whether another one is equal."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    first = np.cumsum(sizes) - sizes
    left = np.repeat(first + sizes, sizes) - np.arange(len(data))
    words = np.r_[spelled(data), np.zeros(LENGTH + WORD, np.uint64)]
    suffixes = sorted_prefixes(words[: len(data)], left, LENGTH)
    shared = common_prefixes(words, suffixes, first, n, LENGTH)
    hit = np.zeros(len(data), bool)
    equal = shared >= LENGTH
    hit[suffixes[equal]] = True
    hit[suffixes[np.flatnonzero(equal) - 1]] = True
    return hit[left >= LENGTH]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in spans]


SEARCH = anchors.Search(
    windows=anchors.Windows(
        length=LENGTH, gram=GRAM, size=len, units=byte_units, spell=WORD - 1
    ),
    cut=_cut,
    index=repeated,
    first_stays=False,
)


def removed_runs(docs: DataFrame) -> DataFrame:
    """did, sum, more, text and spans of every row; ``anchors.merged`` turns spans into byte runs."""
    texts = anchors.keyed(docs)
    return anchors.joined(texts, anchors.repeated_windows(texts, SEARCH))


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in runs:
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return b"".join(out)


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to the characters that lie in them whole."""
    out = []
    for start, end in runs:
        while start < end and text[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digested(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, spans):
            data = text.encode()
            runs = anchors.merged([] if found is None else found, LENGTH)
            kept = kept_bytes(data, runs)
            rows.append(
                (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
            )
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = removed_runs(docs).select("did", digested("text", "spans").alias("r"))
    return found.select(anchors.doc_id().alias("doc_id"), "r.*")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, all columns kept, n_chars counted anew.

    A character stays if any of its bytes does. Documents of which nothing is left
    keep their row, with an empty text; a null text stays null.
    """
    names = docs.columns

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            data = text.encode()
            runs = anchors.merged([] if found is None else found, LENGTH)
            out.append(kept_bytes(data, whole_characters(data, runs)).decode())
        return pd.Series(out, dtype=object)

    texts = anchors.keyed(docs)
    spans = anchors.repeated_windows(texts, SEARCH)
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
        F.coalesce("doc_id", F.lit(anchors.NULL_ID)).cast("long").alias("did"),
        *anchors.text_sums(F.coalesce("text", F.lit(""))),
    )
    # only texts with spans go to the workers
    judged = rows.join(spans, ["did", "sum", "more"], "left")
    changed = judged.select(
        "_row",
        F.when(F.col("spans").isNull(), F.col("_row")["text"])
        .otherwise(cut(F.coalesce(F.col("_row")["text"], F.lit("")), F.col("spans")))
        .alias("_text"),
        F.col("spans").isNotNull().alias("_cut"),
    )
    new = {"text": F.col("_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_cut"), F.length("_text").cast("long")).otherwise(
            F.col("_row")["n_chars"]
        )
    return changed.select(*[new.get(n, F.col("_row")[n]).alias(n) for n in names])
