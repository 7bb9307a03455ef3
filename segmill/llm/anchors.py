"""Content-defined shards for finding repeated windows of a fixed length.

A window (200 bytes, 20 words) is keyed by the least hash of the short grams in it.
Equal windows have equal keys wherever they lie, so an index over the regions of one
key sees every repeat of its windows, and no index has to be searched for texts that
cannot be in it. Neighbouring windows mostly share a key; a run of them is a region.

1. Every text lists its regions: key, hash of the content, place.
2. Keys that come once are dropped, unless the region may repeat itself. Regions of equal
   content are folded by an aggregate: each counts as repeated from its second place on,
   and only the earliest is kept for the index, if its key has other contents too.
3. Where a key has several contents, or one that may repeat itself, these are cut out
   of their texts and indexed together (suffix array, FM-index), which finds the
   windows they share.
4. Windows found are gathered by text.

Copies within a batch of rows are folded before the first shuffle, so a text with
very many copies does not come as often as there are copies. A key with more than
``MAX_REGIONS`` contents (a passage in very many texts) is not indexed as one: its
windows are keyed anew by their whole content, where equal ones meet by aggregation.

Texts are keyed by (did, sum, more): the id, with a stand-in for null, and 128 bits of
hash of the text that tell rows apart that repeat an id or have none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.session import materialize

MAX_REGIONS = 16_384
BLOCK_UNITS = 1 << 20
NULL_ID = -(1 << 63)
# Bits kept of the first half of a text's hash; a test takes none, so that all texts collide in it.
SUM_MASK = -1

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base of the running hash and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place on, by doubling."""
    h, done = units, 1
    while done < k:
        step = min(done, k - done)
        h = mix(h[:-step] * _M2 + h[step:])
        done += step
    return h


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima over blocks of w."""
    n = len(h)
    padded = np.full((-(-n // w) + 1) * w, np.uint64(2**64 - 1))
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` units, keyed by their least gram of ``gram`` units.

    ``size`` counts the units of a text and ``units`` hashes them. A unit may be
    hashed with the ``spell`` units behind it, as bytes are; the last ``spell`` units
    then have no hash of their own.
    """

    length: int
    gram: int
    size: Callable[[bytes], int]
    units: Callable[[bytes], np.ndarray]
    spell: int = 0

    def regions(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, content hash, start, n, inner) of the regions of a text; n windows each.

        ``inner`` tells that the key's gram comes twice, as it does in a region that
        repeats a window of its own.
        """
        n_windows = self.size(text) - self.length + 1
        units = self.units(text) if n_windows > 0 else None
        parts = [
            self._block(units[at : at + BLOCK_UNITS + self.length - 1], at)
            for at in range(0, max(0, n_windows), BLOCK_UNITS)
        ]
        if not parts:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, bool))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _block(self, units: np.ndarray, at: int) -> tuple:
        units = units[: BLOCK_UNITS + self.length - 1 - self.spell]
        grams = gram_hashes(units, self.gram - self.spell)
        width = self.length - self.gram + 1
        least = least_in_window(grams, width)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        n = np.diff(np.r_[first, len(least)])
        if n.max() > width:
            # texts that repeat themselves have long runs: cut to the usual length
            pieces = -(-n // width)
            which = np.repeat(np.arange(len(first)), pieces)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.minimum(n[which] - nth * width, width)
            first = first[which] + nth * width
        up, down = POWERS.upto(len(units) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(units * up[: len(units)], dtype=np.uint64)]
        end = first + n + self.length - 1 - self.spell
        content = mix((sums[end] - sums[first]) * down[first] + n.astype(np.uint64))
        around = np.lib.stride_tricks.sliding_window_view(grams, width)
        key = least[first][:, None]
        leftmost = first + (around[first] == key).argmax(axis=1)
        last = first + n - 1
        rightmost = last + width - 1 - (around[last][:, ::-1] == key).argmax(axis=1)
        return (
            least[first].view(np.int64),
            content.view(np.int64),
            (first + at).astype(np.int32),
            n.astype(np.int32),
            leftmost != rightmost,
        )

    def window_keys(self, text: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each of the n windows of a region's text."""
        units = self.units(text)
        size = self.length - self.spell
        up, down = POWERS.upto(len(units) + 1)
        out = []
        for u in (units, mix(units + _M1)):
            sums = np.r_[np.uint64(0), np.cumsum(u * up[: len(u)], dtype=np.uint64)]
            out.append(mix((sums[size : size + n] - sums[:n]) * down[:n]).view(np.int64))
        return out[0], out[1]


@dataclass(frozen=True)
class Search:
    """What differs between byte and word windows.

    ``cut`` takes the units [start, end) of a text as bytes. ``index`` gets regions
    (contents, numbers of windows, places in order) and gives, for every window of
    each, whether it counts as repeated. ``first_stays``: whether the earliest of
    equal windows is kept.
    """

    windows: Windows
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    index: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
    first_stays: bool


REGION = "key long, content long, did long, sum long, more long, start int, n int, inner boolean, twin boolean"


def text_sums(text: Column) -> list[Column]:
    """A hash of the text in two independent halves: 128 bits, as many rows may share an id or have none."""
    return [
        F.xxhash64(text).bitwiseAND(F.lit(SUM_MASK)).alias("sum"),
        F.xxhash64(F.lit("more"), text).alias("more"),
    ]


def keyed(docs: DataFrame) -> DataFrame:
    """did, sum, more and text (null: empty) of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("did"),
        *text_sums(text),
        text.alias("text"),
    )


def list_regions(texts: DataFrame, search: Search) -> DataFrame:
    """Step 1. Copies within a batch are listed as one wholly repeated region each."""
    windows, first_stays = search.windows, search.first_stays

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["did", "sum", "more"], kind="stable")
            seen: dict[str, int] = {}
            copies: list[int] = []
            repeated: set[int] = set()
            columns = [[], [], [], [], [], [], []]
            for i, (did, text) in enumerate(zip(batch["did"], batch["text"])):
                first = seen.setdefault(text, i)
                # a row that repeats id and text is no later than the first
                same = first != i and first_stays and batch["did"].iloc[first] == did
                if first != i and not same:
                    copies.append(i)
                    repeated.add(first)
                    continue
                key, content, start, n, inner = windows.regions(text.encode())
                for column, values in zip(
                    columns,
                    (key, content, np.full(len(key), i), start, n, inner, np.full(len(key), first)),
                ):
                    column.append(values)
            if columns[0]:
                key, content, row, start, n, inner, first = (np.concatenate(c) for c in columns)
                twin = np.isin(first, list(repeated)) if not first_stays else np.zeros(len(key), bool)
                yield pd.DataFrame(
                    {
                        "key": key,
                        "content": content,
                        "did": batch["did"].to_numpy()[row],
                        "sum": batch["sum"].to_numpy()[row],
                        "more": batch["more"].to_numpy()[row],
                        "start": start,
                        "n": n,
                        "inner": inner,
                        "twin": twin,
                    }
                )
            if copies:
                row = np.array(copies)
                did = batch["did"].to_numpy()[row]
                sizes = [windows.size(t.encode()) for t in batch["text"].iloc[row]]
                n = np.array(sizes) - windows.length + 1
                out = pd.DataFrame(
                    {
                        "key": mix(did.astype(np.uint64) * _M1 + row.astype(np.uint64)).view(np.int64),
                        "content": 0,
                        "did": did,
                        "sum": batch["sum"].to_numpy()[row],
                        "more": batch["more"].to_numpy()[row],
                        "start": 0,
                        "n": n,
                        "inner": False,
                        "twin": True,
                    }
                )
                yield out[out["n"] > 0]

    return texts.mapInPandas(run, REGION)


PLACE = ["did", "sum", "more", "start"]


def shared_regions(listed: DataFrame) -> DataFrame:
    """Regions that may hold a repeated window: their key comes again, or their gram does in them.

    Most regions are alone with their key, so only keys are counted over all of them. Those
    kept are written, so that a hot one's regions can be split in the join.
    """
    counted = listed.groupBy("key").agg(F.count("*").alias("regions"), F.max(F.col("inner") | F.col("twin")).alias("own"))
    shared = materialize(counted.where("regions > 1 or own").select("key"), "keys")
    return listed.join(shared, "key", "left_semi")


def fold_regions(regions: DataFrame) -> DataFrame:
    """Step 2: one row per key and content, with its least place and whether it comes again.

    An aggregate with map-side combining: a passage in very many texts is one row per
    task before the shuffle.
    """
    return regions.groupBy("key", "content").agg(
        F.min(F.struct(*PLACE)).alias("first"),
        F.first("n").alias("n"),
        F.max("inner").alias("inner"),
        ((F.count("*") > 1) | F.max("twin")).alias("again"),
    )


def repeated_regions(regions: DataFrame, contents: DataFrame, first_stays: bool) -> DataFrame:
    """(did, sum, more, start, n) of regions of which all windows are repeated.

    The join is by key and content, whose rows on the left can be split at will.
    """
    again = contents.where("again").select("key", "content", "first")
    found = regions.select("key", "content", *PLACE, "n", "twin").join(again, ["key", "content"])
    if first_stays:
        # rows that repeat id and text are not earlier than each other; a copy's own region
        # is alone with its key, but its text came earlier
        found = found.where((F.struct(*PLACE) != F.col("first")) | F.col("twin"))
    return found.select(*PLACE, "n")


def cut_regions(texts: DataFrame, wanted: DataFrame, search: Search) -> DataFrame:
    """Regions with their content, cut out of their texts."""
    lists = wanted.groupBy("did", "sum", "more").agg(
        F.collect_list(F.struct("start", "n", "full", "key")).alias("wanted")
    )
    length, cut = search.windows.length, search.cut

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for did, total, more, text, regions in zip(
                batch["did"], batch["sum"], batch["more"], batch["text"], batch["wanted"]
            ):
                spans = [(r["start"], r["start"] + r["n"] + length - 1) for r in regions]
                for r, content in zip(regions, cut(text.encode(), spans)):
                    rows.append((r["key"], did, total, more, r["start"], r["n"], r["full"], content))
            yield pd.DataFrame(
                rows, columns=["key", "did", "sum", "more", "start", "n", "full", "text"]
            )

    return texts.join(lists, ["did", "sum", "more"]).mapInPandas(
        run, "key long, did long, sum long, more long, start int, n int, full boolean, text binary"
    )


INDEX_BYTES = 2 << 20


def search_regions(regions: DataFrame, search: Search) -> DataFrame:
    """Step 3: (did, sum, more, start, n) runs of windows found repeated by the index.

    Whole groups of a key are indexed together, about ``INDEX_BYTES`` at a time.
    """
    index = search.index

    def indexed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "did", "sum", "more", "start"])
        order = np.empty(len(rows), np.int64)
        order[np.lexsort((rows["start"], rows["more"], rows["sum"], rows["did"]))] = np.arange(len(rows))
        n = rows["n"].to_numpy().astype(np.int64)
        hit = index(list(rows["text"]), n, order)
        # runs of hits within a region
        region = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
        hit &= ~rows["full"].to_numpy()[region]
        first = hit & np.r_[True, ~(hit[:-1] & (region[1:] == region[:-1]))]
        last = hit & np.r_[~(hit[1:] & (region[1:] == region[:-1])), True]
        r, a, b = region[first], at[first], at[last]
        return pd.DataFrame(
            {
                "did": rows["did"].to_numpy()[r],
                "sum": rows["sum"].to_numpy()[r],
                "more": rows["more"].to_numpy()[r],
                "start": (rows["start"].to_numpy()[r] + a).astype(np.int32),
                "n": (b - a + 1).astype(np.int32),
            }
        )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            key = batch["key"].to_numpy()
            upto = np.r_[0, np.cumsum(batch["text"].map(len).to_numpy())]
            at = 0
            # cut before a new group, as soon as enough has come together
            for i in np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]):
                if i == 0 and (not held or held[-1]["key"].iloc[-1] == key[0]):
                    continue
                if size + upto[i] - upto[at] >= INDEX_BYTES:
                    held.append(batch.iloc[at:i])
                    yield indexed(pd.concat(held, ignore_index=True))
                    held, size, at = [], 0, i
            held.append(batch.iloc[at:])
            size += int(upto[-1] - upto[at])
            held = [h for h in held if len(h)]
        if held:
            yield indexed(pd.concat(held, ignore_index=True))

    together = regions.repartition("key").sortWithinPartitions("key", "did", "sum", "more", "start")
    return together.mapInPandas(run, "did long, sum long, more long, start int, n int")


def search_crowded(regions: DataFrame, search: Search) -> DataFrame:
    """Step 3 for keys with very many contents: equal windows meet by their content."""
    windows, first_stays = search.windows, search.first_stays

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (*windows.window_keys(text, n), np.arange(start, start + n))
                for start, n, text in zip(batch["start"], batch["n"], batch["text"])
            ]
            if found:
                one, two, start = (np.concatenate(x) for x in zip(*found))
                rest = batch[["did", "sum", "more", "full"]]
                out = rest.loc[rest.index.repeat(batch["n"])].reset_index(drop=True)
                yield out.assign(one=one, two=two, start=start.astype(np.int32))

    single = regions.mapInPandas(
        run, "one long, two long, did long, sum long, more long, start int, full boolean"
    ).distinct()
    first = F.min(F.struct("did", "sum", "more", "start")).alias("first")
    met = single.groupBy("one", "two").agg(F.count("*").alias("times"), first).where("times > 1")
    repeated = single.join(met, ["one", "two"]).where(~F.col("full"))
    if first_stays:
        repeated = repeated.where(F.struct("did", "sum", "more", "start") != F.col("first"))
    return repeated.select("did", "sum", "more", "start", F.lit(1).alias("n"))


def repeated_windows(texts: DataFrame, search: Search) -> DataFrame:
    """(did, sum, more, spans) of the texts with repeated windows; spans of (start, n) windows.

    ``texts`` comes from ``keyed``. Joins with it use its columns as they are, so
    that one shuffle of the texts serves them all.
    """
    listed = materialize(list_regions(texts, search), "listed")
    regions = materialize(shared_regions(listed), "regions")
    contents = materialize(fold_regions(regions), "contents")
    groups = contents.groupBy("key").agg(F.count("*").alias("contents"), F.max("inner").alias("any_inner"))
    # one region stands for its content in the index
    full = F.lit(False) if search.first_stays else F.col("again")
    groups = materialize(groups.where("contents > 1 or any_inner"), "groups")
    counted = contents.join(groups, "key").select(
        "key", "first.*", "n", full.alias("full"), "contents"
    )
    few = counted.where(F.col("contents") <= MAX_REGIONS)
    many = counted.where(F.col("contents") > MAX_REGIONS)
    spans = (
        repeated_regions(regions, contents, search.first_stays)
        .unionByName(search_regions(cut_regions(texts, few, search), search))
        .unionByName(search_crowded(cut_regions(texts, many, search), search))
    )
    # rows that repeat id and text find the same spans: a set is no longer than one text's
    return spans.groupBy("did", "sum", "more").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def merged(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal unit ranges [start, end) that some windows cover."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans):
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def joined(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text with its spans, null where it has none."""
    return texts.join(spans, ["did", "sum", "more"], "left")


def doc_id() -> Column:
    """The id that ``did`` stands for."""
    return F.when(F.col("did") != NULL_ID, F.col("did"))
