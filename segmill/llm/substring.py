"""Exact dedup of word windows by FM-indexes.

A window of 20 words goes if its words also start earlier: in a document with a
smaller id, or earlier in the same one. Windows are dealt to shards by content
(``anchors``). A shard's regions become one sequence of word numbers with an
FM-index over it; the shard's documents stream through backward search, which gives
the matching statistics before every place, and windows that reach the threshold
are reported unless they are the earliest of their interval.

A null or empty text has no words. Of rows that repeat id and text none is earlier
than the other; rows that repeat an id only are ordered by a hash of their text. A
null id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import anchors
from segmill.llm.fm_index import FMIndex, matching

LENGTH = 20
GRAM = 6
MAX_WORDS = 500_000


class _Hashes(dict):
    """Hash of each word, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = _Hashes()


def word_units(text: bytes) -> np.ndarray:
    found = text.split()
    return np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))


def count_words(text: bytes) -> int:
    return len(text.split())


def later_repeats(contents: list[bytes], n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every window of some regions in turn, whether its words also start earlier.

    ``order`` gives each region's place among all of them by document and start.
    """
    numbers: dict[bytes, int] = {}
    symbols: list[int] = []
    for content in contents:
        symbols += [numbers.setdefault(w, len(numbers) + 1) for w in content.split()]
        symbols.append(0)
    sequence = np.array(symbols, np.int64)
    sizes = n + LENGTH  # words of a region and its separator
    first = np.cumsum(sizes) - sizes
    region = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
    starts = first[region] + inside
    index = FMIndex(sequence, LENGTH)
    matched, low, high = matching(index, sequence, starts + LENGTH, LENGTH)
    hit = matched == LENGTH
    when = np.full(len(sequence), np.iinfo(np.int64).max)
    width = int(n.max(initial=0)) + 1
    when[starts] = order[region] * width + inside
    out = np.zeros(len(region), bool)
    if hit.any():
        interval, of_window = np.unique(low[hit], return_inverse=True)
        ends = np.zeros(len(interval), np.int64)
        ends[of_window] = high[hit]
        sorted_when = np.r_[when[index.suffixes], np.iinfo(np.int64).max]
        earliest = np.minimum.reduceat(sorted_when, np.c_[interval, ends].ravel())[::2]
        out[hit] = when[starts[hit]] > earliest[of_window]
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    found = text.split()
    return [b" ".join(found[a:b]) for a, b in spans]


SEARCH = anchors.Search(
    windows=anchors.Windows(length=LENGTH, gram=GRAM, size=count_words, units=word_units),
    cut=_cut,
    index=later_repeats,
    first_stays=True,
)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digested(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, spans):
            found_words = text.encode().split()
            kept: list[bytes] = []
            at = 0
            for start, end in anchors.merged([] if found is None else found, LENGTH):
                kept += found_words[at:start]
                at = end
            kept += found_words[at:]
            rows.append(
                (
                    len(found_words),
                    len(found_words) - len(kept),
                    hashlib.sha256(b" ".join(kept)).hexdigest(),
                )
            )
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    texts = anchors.keyed(docs)
    spans = anchors.repeated_windows(texts, SEARCH)
    found = anchors.joined(texts, spans).select("did", digested("text", "spans").alias("r"))
    return found.select(anchors.doc_id().alias("doc_id"), "r.*")
