"""Token counts of texts by byte-pair merging, without the tokens.

A piece (a match of the split pattern) starts as a linked list of one symbol per byte.
A heap holds its adjacent pairs that a merge joins, by rank and then place. Popping
the least pair and joining it changes two neighbours at most, which come back onto the
heap; a popped pair whose symbols have changed since is passed over. A piece of n
bytes and m merges has n - m tokens, so nothing is listed: no ids leave the merging.

The vocabulary file is that of the public ``tokenizers`` library: byte-level BPE with
its merges in order of rank. Strings of its special tokens inside a text are one token
each, as is that library's default; no begin or end token is added, nothing is
truncated or padded.

Null texts count as empty: no bytes, no tokens. A piece may be as long as its text
and takes memory in proportion to its own length. Repeated rows are counted each, a
null id is carried through, an empty table gives an empty result, and columns of the
input other than the id and the text do not matter, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.bpe import BLANKS, WHITE

MAX_CACHED = 500_000
KEPT_CHARS = 64
LIMIT = 512

# Fixed value: how byte-level BPE splits a text where the file says ``use_regex``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files.

    Printable characters of Latin-1 stand for themselves; the other bytes, in order,
    for the characters from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Ranks of the pairs of symbols that are merged, and what each pair becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, splitting = stored["model"], stored.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or splitting.get("type") != "ByteLevel" or not splitting.get("use_regex", True):
            raise ValueError("not a byte-level BPE vocabulary")
        if splitting.get("add_prefix_space") or stored.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("a prefix space, a normalizer or whole-word lookups are not handled")
        vocabulary = model["vocab"]
        self.of_byte = [0] * 256
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        self.n_symbols = len(vocabulary)
        # left * n_symbols + right -> rank of the merge, and what each rank makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocabulary[left] * self.n_symbols + vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        added = stored.get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take blanks or words with them are not handled")
        self.special = [t["content"] for t in added]

    def tokens(self, piece: bytes) -> int:
        """Initial symbols minus merges. A heap entry is rank * n + place of the left symbol."""
        n = len(piece)
        rank_of, size, made = self.ranks.get, self.n_symbols, self.made
        symbols = [self.of_byte[b] for b in piece]
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] * size + symbols[i + 1])
            if rank is not None:
                heap.append(rank * n + i)
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merged = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            # stale: one of the two has been merged away or into something else
            if j == n or symbols[i] < 0 or rank_of(symbols[i] * size + symbols[j]) != rank:
                continue
            merged += 1
            joined = symbols[i] = made[rank]
            symbols[j] = -1
            following = after[i] = after[j]
            if following < n:
                before[following] = i
                found = rank_of(joined * size + symbols[following])
                if found is not None:
                    heappush(heap, found * n + i)
            leading = before[i]
            if leading >= 0:
                found = rank_of(symbols[leading] * size + joined)
                if found is not None:
                    heappush(heap, found * n + leading)
        return n - merged


class _Kept(dict):
    """What ``count`` gives for the short keys met so far, up to ``MAX_CACHED`` of them."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[key] = n
        return n


class _Blanks(Exception):
    """White space beside a blank: the pattern has to split the text as a whole."""


class Counter:
    """Token counts of whole texts.

    A lone blank between two words always opens the match of the second, so a text
    falls apart at its blanks and most words are lookups.
    """

    def __init__(self, path: str):
        merges = Merges(path)
        self.of_piece = _Kept(lambda piece: merges.tokens(piece.encode()))
        self.of_word = _Kept(self._word)
        self.split = regex.compile(
            SPLIT.replace("[^\\s", "[^" + WHITE).replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
        )
        longest_first = sorted(merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None

    def count(self, text: str) -> int:
        if not self.special:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1] in BLANKS):
                raise _Blanks
            return self._pieces(first) + sum(map(self.of_word.__getitem__, rest))
        except _Blanks:
            return self._pieces(text)

    def _word(self, word: str) -> int:
        if not word or word[0] in BLANKS or word[-1] in BLANKS:
            raise _Blanks
        return self._pieces(" " + word)

    def _pieces(self, text: str) -> int:
        return sum(map(self.of_piece.__getitem__, self.split.findall(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker, kept between tasks."""
    return Counter(path)


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        worker = counter(path)
        return pd.Series([worker.count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        counted(text).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
