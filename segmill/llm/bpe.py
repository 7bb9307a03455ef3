"""Byte-level BPE as a finite-state transducer, and streaming decode.

The transducer reads the bytes of a piece (a match of the split pattern). A state
is the set of token prefixes that the bytes read last may be the beginning of; the
sets are determinised when a text first reaches them and kept, so a byte is one
table lookup afterwards, which also names the tokens that may end there. Two facts
tell which of them does: what a piece encodes to up to a token's end is the
encoding of that prefix, and two tokens may stand side by side exactly if no merge
across their border would have come first. So each place has one last token, found
from the places one token back. A place behind which no token prefix is open any
more cannot be revised: look-ahead is bounded by the longest token, and tokens that
all open places share are emitted.

Null texts count as empty and encode to no tokens. Texts of any length run in
linear time. Repeated rows are encoded each; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAIRS = 500_000
MAX_CACHED = 700_000
DECODE_CHUNK = 65_536

# White space as Unicode defines it, for the split pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

BLANKS = frozenset(c for c in map(chr, range(0x3001)) if regex.fullmatch(f"[{WHITE}]", c))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Lazily determinised transducer of a rank table, for one piece at a time.

    States are numbered as they are made. ``open[state]`` is the longest open
    prefix, which determines the shorter ones; ``moves[state][byte]`` is the next
    state and the (length, rank) of the tokens that may end there, longest first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.starts = {token[:i] for token in ranks for i in range(1, len(token))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.open: list[bytes] = [b""]
        self.moves: list[dict[int, tuple]] = [{}]

    def half(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; none for a token that no merge makes."""
        if rank not in self.halves:
            token = self.token[rank]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                ranked = [
                    (self.ranks[joined], i)
                    for i in range(len(parts) - 1)
                    if (joined := parts[i] + parts[i + 1]) in self.ranks
                ]
                if not ranked or min(ranked)[0] >= rank:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            made = len(parts) == 2 and len(token) > 1
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if made else None
        return self.halves[rank]

    def reachable(self, rank: int) -> bool:
        return self.length[rank] == 1 or self.half(rank) is not None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two tokens.

        The merges of both are undone from the last one back. As long as a merge
        across the border would have come before the merge undone last, the border
        would not have stood.
        """
        bound = 1 << 60
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < bound:
                return False
            if left > right and self.half(left):
                bound, left = left, self.half(left)[1]
            elif self.half(right):
                # merges of equal rank run from the left, so one across the border comes first
                bound, right = right + 1, self.half(right)[0]
            elif self.half(left):
                bound, left = left, self.half(left)[1]
            else:
                return True

    def _move(self, state: int, byte: int) -> tuple:
        read = self.open[state] + bytes((byte,))
        ends, longest = [], None
        for i in range(len(read)):
            tail = read[i:]
            rank = self.ranks.get(tail)
            if rank is not None and self.reachable(rank):
                ends.append((len(tail), rank))
            if longest is None and tail in self.starts:
                longest = tail
        longest = longest or b""
        number = self.numbers.get(longest)
        if number is None:
            number = self.numbers[longest] = len(self.open)
            self.open.append(longest)
            self.moves.append({})
        move = self.moves[state][byte] = (number, tuple(ends))
        return move

    def tokens(self, piece: bytes, block: int = 4096) -> Iterator[list[int]]:
        """Ranks of a piece in groups, each as soon as no open place can revise it."""
        moves, pairs = self.moves, self.pairs
        if len(pairs) > MAX_PAIRS:
            pairs.clear()
        last = [-1]  # the token that ends at each place since the last settled one
        state = 0
        for start in range(0, len(piece), block):
            at = len(last)
            for byte in piece[start : start + block]:
                move = moves[state].get(byte)
                if move is None:
                    move = self._move(state, byte)
                state, ends = move
                for length, rank in ends:
                    if length > at:
                        continue
                    key = (last[at - length], rank)
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = key[0] < 0 or self.may_follow(*key)
                    if fits:
                        last.append(rank)
                        break
                else:
                    raise ValueError("the rank table lacks a single byte")
                at += 1
            if start + block < len(piece):
                done = self._shared(last, len(self.open[state]))
                if done:
                    yield self._back(last, done)
                    last = last[done:]
        yield self._back(last, len(last) - 1)

    def _back(self, last: list[int], place: int) -> list[int]:
        """Tokens from the first place up to one of the others."""
        out = []
        while place > 0:
            out.append(last[place])
            place -= self.length[last[place]]
        out.reverse()
        return out

    def _shared(self, last: list[int], behind: int) -> int:
        """The last place that the encodings of all open places go through."""
        places = set(range(max(0, len(last) - 1 - behind), len(last)))
        while len(places) > 1:
            place = max(places)
            places.remove(place)
            if place > 0:
                places.add(place - self.length[last[place]])
        return places.pop()

    def encode(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else [t for some in self.tokens(piece) for t in some]


class _Words(dict):
    """Ids, as packed bytes, of a blank and a word behind it; made when first asked for."""

    def __init__(self, codec: "Codec"):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if not word or word[0] in BLANKS or word[-1] in BLANKS:
            raise _Blanks
        if len(self) > MAX_CACHED:
            self.clear()
        ids = self[word] = self.codec.pieces(" " + word)
        return ids


class _Blanks(Exception):
    """More than one blank in a row: the text has to be split as a whole."""


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.transducer = Transducer(ranks)
        self.split = regex.compile(
            pattern.replace("[^\\s", "[^" + WHITE).replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
        )
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.words = _Words(self)
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> bytes:
        """Packed ids of a text, one match of the pattern after the other."""
        out = []
        for piece in self.split.findall(text):
            ids = self.cache.get(piece)
            if ids is None:
                ranks = self.transducer.encode(piece.encode())
                ids = struct.pack(f"<{len(ranks)}I", *ranks)
                if len(piece) < 64:
                    if len(self.cache) > MAX_CACHED:
                        self.cache.clear()
                    self.cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text.

        No match of the pattern goes on past a blank between two words: a lone
        blank always opens the match of the word behind it. So a text falls apart
        at its blanks, and most words are lookups. Where blanks meet, the pattern
        splits the whole text.
        """
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1] in BLANKS):
                raise _Blanks
            return self.pieces(first) + b"".join(map(self.words.__getitem__, rest))
        except _Blanks:
            return self.pieces(text)

    def decode(self, ids: bytes, chunk: int = DECODE_CHUNK) -> Iterator[bytes]:
        """Bytes of packed ids, chunk by chunk, each ending at the end of a character."""
        tail = Utf8Tail()
        look_up = self.bytes_of.__getitem__
        for at in range(0, len(ids), 4 * chunk):
            some = np.frombuffer(ids[at : at + 4 * chunk], dtype="<u4").tolist()
            yield tail.feed(b"".join(map(look_up, some)))
        yield tail.rest()


class Utf8Tail:
    """Incremental UTF-8 state: holds back the bytes of a character still to come.

    Between chunks the state is the lead byte read and how many continuation bytes
    it still needs, that is, at most three bytes.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def length(lead: int) -> int:
        if lead < 0x80:
            return 1
        if 0xC2 <= lead < 0xE0:
            return 2
        if 0xE0 <= lead < 0xF0:
            return 3
        return 4 if 0xF0 <= lead < 0xF5 else 1

    def feed(self, data: bytes) -> bytes:
        """The characters completed so far; bytes that are no UTF-8 pass as they are."""
        data = self.held + data
        back = 1
        while back <= min(3, len(data)) and 0x80 <= data[-back] < 0xC0:
            back += 1
        open_from = len(data)
        if back <= min(3, len(data)) and self.length(data[-back]) > back:
            open_from = len(data) - back
        self.held = data[open_from:]
        return data[:open_from]

    def rest(self) -> bytes:
        held, self.held = self.held, b""
        return held


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker, kept between tasks."""
    return Codec(path, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id, ``n_tokens`` and ``ids``, the token ids packed as little-endian 32-bit numbers."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        worker = codec(path, pattern)
        return pd.Series([worker.encode(t) if isinstance(t, str) else b"" for t in texts])

    rows = docs.select(F.col(id_column), encoded(F.col(text_column)).alias("ids"))
    return rows.select(id_column, (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, digest of the ids and digest of the bytes that the ids decode to.

    Ids stay with the worker that made them: they are digested, decoded chunk by
    chunk, and not written anywhere.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        worker = codec(path, pattern)
        rows = []
        for text in texts:
            ids = worker.encode(text) if isinstance(text, str) else b""
            decoded = hashlib.sha256()
            for part in worker.decode(ids):
                decoded.update(part)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digested("text").alias("r")).select("doc_id", "r.*")
