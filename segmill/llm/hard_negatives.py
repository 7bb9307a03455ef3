"""Hard negatives by zone maps over blocks in Hilbert-curve order.

**Blocks.** Vectors become whole numbers and are laid out by label and then along a
Hilbert curve through all their dimensions (two bits each, by the quartiles of a normal
vector of the same length), so neighbours on it mostly are neighbours in space. A block
is up to ``BLOCK`` of them in that order: one row of a Parquet table, with the least and
greatest value per dimension beside its packed vectors. A label is never more than its
blocks, however many rows it holds.

**Reading.** Anchors go in chunks of up to ``CHUNK``, taken from the blocks in order. By
interval arithmetic a block's zone bounds its inner products with an anchor from both
sides. An anchor needs a block only if the bounds meet one of its windows of scores and
the upper one reaches what ``k`` vectors in other blocks are sure to have: those of
blocks that lie in the window as a whole, from the greatest lower bound down. Blocks
that an anchor of a chunk needs are read for the chunk and compared as one matrix
product; what is returned is exact, whatever the bounds leave out.

The first pass looks for the anchors' positives, in blocks of their own label and a
window without ends. Their scores make the windows of the second, in blocks of other
labels. Blocks of a chunk are dealt into slices of about ``SLICE``, each a group of its
own; a task keeps the ``k`` best per window as it goes, and those of the slices are
merged last.

Rows with a null label, a null vector or a null or non-finite component take no part,
not even as anchors. A null vec_id is no anchor and comes last among ties. Vectors of
different lengths are not compared. Rows that repeat a vec_id are rows of their own,
as candidates, anchors and each other's positives. Scores are 64-bit integers; where a product might pass
2**53, they are computed as such, else in doubles, which are exact there. An anchor
without positives, or with a window nothing lies in, gives no rows, and an empty table
gives an empty result. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.session import materialize

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
# A negative's score lies between these hundredths of its positive's.
LEAST, MOST = 30, 90
BLOCK = 1024
CHUNK = 2048
SLICE = 16
SLAB = 512
NO_ID = (1 << 63) - 1
NO_BLOCK = -1

_QUARTILE = 0.6744897501960817  # of the normal distribution


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and dims of the rows that take part, with the packed vector and its place on the curve."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    fit = embeddings.where(F.col("label").isNotNull() & e.isNotNull() & ~F.coalesce(odd, F.lit(True)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, rows in batch.groupby(batch["embedding"].map(len)):
                values = np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), dims)
                whole = np.floor(SCALE * values).astype(np.int64)
                yield pd.DataFrame(
                    {
                        "vec_id": rows["vec_id"],
                        "label": rows["label"],
                        "dims": dims,
                        "curve": curve_keys(whole),
                        "vector": [v.tobytes() for v in whole.astype(np.int16)]
                        if np.array_equal(whole, whole.astype(np.int16))
                        else [v.tobytes() for v in whole],
                    }
                )

    kept = fit.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        "embedding",
    )
    return kept.mapInPandas(run, "vec_id long, label long, dims int, curve binary, vector binary")


def curve_keys(vectors: np.ndarray) -> list[bytes]:
    """Place of each vector on a Hilbert curve of two bits per dimension, as sortable bytes."""
    n, dims = vectors.shape
    if not dims:
        return [b""] * n
    norm = np.sqrt(np.mean(np.square(vectors, dtype=np.float64), axis=1, keepdims=True))
    cuts = np.array([-_QUARTILE, 0.0, _QUARTILE])
    return along_curve(np.searchsorted(cuts, vectors / np.where(norm > 0, norm, 1), side="right"))


def along_curve(cells: np.ndarray) -> list[bytes]:
    """Sortable place of each cell, four to a dimension: Skilling's transform of all rows at once."""
    axes = cells.astype(np.uint8).T.copy()
    dims = len(axes)
    # undo the turns of the upper bit
    for d in range(dims):
        set_ = (axes[d] & 2) > 0
        swap = np.where(set_, 0, (axes[0] ^ axes[d]) & 1).astype(np.uint8)
        axes[0] ^= np.where(set_, 1, swap).astype(np.uint8)
        axes[d] ^= swap
    # Gray code
    for d in range(1, dims):
        axes[d] ^= axes[d - 1]
    axes ^= (axes[-1] >> 1) & 1
    planes = np.concatenate([(axes >> 1) & 1, axes & 1]).T
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def vectors_of(packed: Iterable[bytes], dims: int) -> np.ndarray:
    """Rows of packed vectors, as 64-bit integers; each row says by its length how wide it is."""
    packed = list(packed)
    if not dims:
        return np.empty((len(packed), 0), np.int64)
    if all(len(p) == 2 * dims for p in packed):
        return np.frombuffer(b"".join(packed), np.int16).reshape(-1, dims).astype(np.int64)
    kinds = [np.int16 if len(p) == 2 * dims else np.int64 for p in packed]
    return np.array([np.frombuffer(p, k) for p, k in zip(packed, kinds)], np.int64)


def narrow(whole: np.ndarray) -> bytes:
    """Whole numbers in 16 bits where they fit, else in 64."""
    small = whole.astype(np.int16)
    return (small if np.array_equal(small, whole) else whole).tobytes()


def widened(data: bytes, n: int, dims: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * n * dims else np.int64
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, dims)


BLOCKS = "block long, label long, dims int, n int, ids binary, vectors binary, low binary, high binary"


def build_blocks(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks with their zones, written once. A block has one label and one vector length."""
    order = ["dims", "label", "curve", "vec_id"]
    laid = whole_vectors(embeddings).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        made = 0
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            edges = block_edges(rows)
            held = rows.iloc[edges[-2] :] if len(rows) else None
            if len(edges) > 2:
                yield packed_blocks(rows, edges[:-1], (task << 32) + made)
                made += len(edges) - 2
        if held is not None and len(held):
            yield packed_blocks(held, np.array([0, len(held)]), (task << 32) + made)

    def block_edges(rows: pd.DataFrame) -> np.ndarray:
        kind = rows[["dims", "label"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]).any(axis=1)]) if len(rows) else np.array([0])
        ends = np.r_[starts[1:], len(rows)]
        return np.r_[np.concatenate([np.arange(a, max(b, a + 1), block) for a, b in zip(starts, ends)]), len(rows)]

    def packed_blocks(rows: pd.DataFrame, edges: np.ndarray, number: int) -> pd.DataFrame:
        out = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            part = rows.iloc[a:b]
            dims = int(part["dims"].iloc[0])
            whole = vectors_of(part["vector"], dims)
            ids = part["vec_id"].to_numpy(np.int64)
            zone = (narrow(whole.min(axis=0)), narrow(whole.max(axis=0)))
            out.append((number + i, part["label"].iloc[0], dims, b - a, ids.tobytes(), narrow(whole), *zone))
        return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return materialize(laid.mapInPandas(run, BLOCKS), "blocks")


CHUNKS = "chunk long, dims int, n int, labels binary, ids binary, homes binary, vectors binary"


def anchor_chunks(blocks: DataFrame, every: int = ANCHOR_EVERY, chunk: int = CHUNK) -> DataFrame:
    """Vectors whose id is divisible by ``every``, in chunks of neighbouring ones.

    Those of a block stay together, so a chunk passes ``chunk`` only if they alone do.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        made, n, dims = 0, 0, None
        held: list[tuple] = []

        def together() -> pd.DataFrame:
            labels, ids, homes, vectors = (np.concatenate(x) for x in zip(*held))
            parts = (labels.tobytes(), ids.tobytes(), homes.tobytes(), narrow(vectors))
            row = ((task << 32) + made, dims, n, *parts)
            return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = np.frombuffer(b.ids, np.int64)
                mine = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                if not len(mine):
                    continue
                if held and (n + len(mine) > chunk or dims != b.dims):
                    yield together()
                    made, n, held = made + 1, 0, []
                homes = np.stack([np.full(len(mine), b.block), mine], axis=1)
                label = np.full(len(mine), b.label)
                held.append((label, ids[mine], homes, widened(b.vectors, b.n, b.dims)[mine]))
                n, dims = n + len(mine), b.dims
        if held:
            yield together()

    columns = ["block", "label", "dims", "n", "ids", "vectors"]
    return materialize(blocks.select(*columns).mapInPandas(run, CHUNKS), "chunks")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact in 64 bits."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if limit < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that a vector of each zone may have with each anchor."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def needed(least, most, sizes, windows, k: int) -> np.ndarray:
    """Whether an anchor needs a zone for one of its windows.

    ``least`` and ``most`` bound the scores, a row per anchor; ``sizes`` counts each
    zone's vectors (0 where it does not concern the anchor). ``windows`` holds the
    ends of each window, an anchor per row.
    """
    out = np.zeros(least.shape, bool)
    order = np.argsort(-least, axis=1, kind="stable")
    falling = np.take_along_axis(least, order, axis=1)
    for start, stop in windows:
        start, stop = start[:, None], stop[:, None]
        inside = np.where((least >= start) & (most <= stop), sizes, 0)
        sure = np.cumsum(np.take_along_axis(inside, order, axis=1), axis=1) >= k
        at = sure.argmax(axis=1)[:, None]
        bar = np.where(sure.any(axis=1)[:, None], np.take_along_axis(falling, at, axis=1), start)
        out |= (sizes > 0) & (most >= np.maximum(start, bar)) & (least <= stop)
    return out


class Best:
    """The ``k`` highest scores of each (anchor, window) so far, equal ones by smaller id."""

    def __init__(self, n_anchors: int, n_windows: int, k: int):
        self.k = k
        self.bar = np.full((n_windows, n_anchors), np.iinfo(np.int64).min)
        self.found = [np.empty(0, np.int64)] * 4
        self.waiting: list[tuple] = []
        self.size = 0

    def offer(self, window: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] >= self.k:
            masked = np.where(allowed, scores, np.iinfo(np.int64).min)
            kth = np.partition(masked, -self.k, axis=1)[:, -self.k]
            self.bar[window] = np.maximum(self.bar[window], kth)
        anchor, place = np.nonzero(allowed & (scores >= self.bar[window][:, None]))
        self.waiting.append((anchor, np.full(len(anchor), window), scores[anchor, place], ids[place]))
        self.size += len(anchor)
        if self.size > 1_000_000:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        anchor, window, score, ids = (np.concatenate(x) for x in zip(self.found, *self.waiting))
        order = np.lexsort((ids, -score, window, anchor))
        anchor, window, score, ids = anchor[order], window[order], score[order], ids[order]
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])][: len(anchor)]
        first = np.flatnonzero(fresh)
        nth = np.arange(len(anchor)) - np.repeat(first, np.diff(np.r_[first, len(anchor)]))
        left = nth < self.k
        self.found = [x[left] for x in (anchor, window, score, ids)]
        kth = nth == self.k - 1
        self.bar[window[kth], anchor[kth]] = np.maximum(self.bar[window[kth], anchor[kth]], score[kth])
        self.waiting, self.size = [], 0
        return self.found


class Chunk:
    """A chunk's anchors with the windows of scores that are looked for.

    Without ``windows`` it looks for positives: other vectors of the anchor's label,
    whatever their score. With them, for those of other labels in a window per positive.
    """

    def __init__(self, row, windows: list | None):
        self.number = row.chunk
        n, dims = int(row.n), int(row.dims)
        self.dims = dims
        self.ids = np.frombuffer(row.ids, np.int64)
        self.labels = np.frombuffer(row.labels, np.int64)
        self.homes = np.frombuffer(row.homes, np.int64).reshape(n, 2)
        self.vectors = widened(row.vectors, n, dims)
        self.positives = windows is None
        if self.positives:
            far = np.iinfo(np.int64)
            self.windows = [(np.full(n, far.min), np.full(n, far.max))]
            self.positive_ids = self.positive_scores = np.zeros((1, n), np.int64)
        else:
            # the window (1, 0) holds nothing: an anchor may have fewer positives
            n_windows = 1 + max(w["place"] for w in windows)
            self.positive_ids, self.positive_scores = np.zeros((2, n_windows, n), np.int64)
            known = np.zeros((n_windows, n), bool)
            for w in windows:
                at = w["place"], w["anchor"]
                self.positive_ids[at], self.positive_scores[at], known[at] = w["id"], w["score"], True
            start, stop = -((-LEAST * self.positive_scores) // 100), (MOST * self.positive_scores) // 100
            self.windows = list(zip(np.where(known, start, 1), np.where(known, stop, 0)))

    def concerned(self, labels: np.ndarray) -> np.ndarray:
        """Whether blocks of these labels are any of an anchor's business."""
        same = self.labels[:, None] == labels[None, :]
        return same if self.positives else ~same

    def wanted(self, zones: list, k: int) -> np.ndarray:
        """Places of the zones that some anchor needs."""
        low = np.concatenate([widened(z.low, 1, self.dims) for z in zones])
        high = np.concatenate([widened(z.high, 1, self.dims) for z in zones])
        least, most = bounds(self.vectors, low, high)
        sizes = np.array([z.n for z in zones]) * self.concerned(np.array([z.label for z in zones]))
        # an anchor is a vector of its label too, though not its own positive
        return np.flatnonzero(needed(least, most, sizes, self.windows, k + self.positives).any(axis=0))

    def compare(self, block, best: "Best") -> None:
        concerned = self.concerned(np.array([block.label]))
        if not concerned.any():
            return
        scores = products(self.vectors, widened(block.vectors, int(block.n), self.dims))
        ids = np.frombuffer(block.ids, np.int64)
        at_home = np.flatnonzero(self.homes[:, 0] == block.block) if self.positives else []
        for w, (start, stop) in enumerate(self.windows):
            allowed = concerned & (scores >= start[:, None]) & (scores <= stop[:, None])
            allowed[at_home, self.homes[at_home, 1]] = False
            best.offer(w, scores, allowed, ids)


def _groups(batches: Iterable[pd.DataFrame], *keys: str) -> Iterator[tuple[list[Chunk], Iterator]]:
    """The chunks of each group of ``keys``, and its other rows as they come.

    The rows of a group come together, those of chunks first.
    """
    rows = (row for batch in batches for row in batch.itertuples(index=False))
    for _, group in groupby(rows, key=attrgetter(*keys)):
        chunks: list[Chunk] = []
        for row in group:
            if row.block != NO_BLOCK:
                yield chunks, chain([row], group)
                break
            chunks.append(Chunk(row, list(row.windows) if hasattr(row, "windows") else None))


def _beside(chunks: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Both kinds of rows by group, chunks first; columns of the other kind are zero or null."""
    empty = {"block": F.lit(NO_BLOCK).cast("long"), "label": F.lit(0).cast("long")}
    both = chunks.withColumns(empty).unionByName(
        others if "chunk" in others.columns else others.withColumn("chunk", F.lit(0).cast("long")),
        allowMissingColumns=True,
    )
    return both.repartition(*keys).sortWithinPartitions(*keys, "block")


def wanted_blocks(chunks: DataFrame, blocks: DataFrame, n_chunks: int, n_blocks: int, k: int) -> DataFrame:
    """(chunk, block) that the zones leave to be read.

    Every chunk meets every zone, which is small beside its block: chunks go to each
    slab of zones, zones to each bucket of chunks.
    """
    n_slabs = -(-n_blocks // SLAB)

    def dealt(column: str, n: int, name: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(name)

    def each(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    zones = blocks.select("block", "label", "dims", "n", "low", "high")
    met = _beside(
        chunks.select("*", dealt("chunk", n_chunks, "bucket"), each(n_slabs, "slab")),
        zones.select("*", dealt("block", n_slabs, "slab"), each(n_chunks, "bucket")),
        "bucket",
        "slab",
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asking, rows in _groups(batches, "bucket", "slab"):
            zones = list(rows)
            for chunk in asking:
                alike = [z for z in zones if z.dims == chunk.dims]
                blocks = [alike[i].block for i in chunk.wanted(alike, k)] if alike else []
                yield pd.DataFrame({"chunk": chunk.number, "block": np.array(blocks, np.int64)})

    return met.mapInPandas(run, "chunk long, block long")


FOUND = (
    "chunk long, anchor int, place int, anchor_id long, positive_id long, positive_score long, id long, score long"
)


def best_vectors(chunks: DataFrame, blocks: DataFrame, n_chunks: int, n_blocks: int, k: int) -> DataFrame:
    """The ``k`` best vectors of every window of every anchor, with their ``rank``."""
    n_slices = -(-n_blocks // SLICE)
    slice_ = F.pmod(F.xxhash64("block"), F.lit(n_slices)).cast("int").alias("slice")
    wanted = materialize(
        wanted_blocks(chunks, blocks, n_chunks, n_blocks, k).select("chunk", "block", slice_), "wanted"
    )
    read = blocks.select("block", "label", "n", "ids", "vectors").join(wanted, "block")
    met = _beside(chunks.join(wanted.select("chunk", "slice").distinct(), "chunk"), read, "chunk", "slice")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Chunk | None = None
        best: Best | None = None
        for (chunk,), rows in _groups(batches, "chunk", "slice"):
            if held is None or chunk.number != held.number:
                if held is not None:
                    yield table(held, best)
                held, best = chunk, Best(len(chunk.ids), len(chunk.windows), k)
            for block in rows:
                held.compare(block, best)
        if held is not None:
            yield table(held, best)

    def table(chunk: Chunk, best: Best) -> pd.DataFrame:
        anchor, window, score, ids = best.settle()
        return pd.DataFrame(
            {
                "chunk": chunk.number,
                "anchor": anchor.astype(np.int32),
                "place": window.astype(np.int32),
                "anchor_id": chunk.ids[anchor],
                "positive_id": chunk.positive_ids[window, anchor],
                "positive_score": chunk.positive_scores[window, anchor],
                "id": ids,
                "score": score,
            }
        )

    order = Window.partitionBy("chunk", "anchor", "place").orderBy(F.desc("score"), "id")
    found = met.mapInPandas(run, FOUND)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = ANCHOR_EVERY,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    blocks = build_blocks(embeddings, block)
    chunks = anchor_chunks(blocks, every, chunk)
    n_chunks, n_blocks = max(1, chunks.count()), max(1, blocks.count())
    found = materialize(best_vectors(chunks, blocks, n_chunks, n_blocks, positives), "positives")
    place = (F.col("rank") - 1).alias("place")
    windows = found.groupBy("chunk").agg(
        F.collect_list(F.struct("anchor", place, "id", "score")).alias("windows")
    )
    looking = materialize(chunks.join(windows, "chunk"), "looking")
    negative = best_vectors(looking, blocks, n_chunks, n_blocks, negatives)

    def without_stand_in(name: str, new: str) -> Column:
        return F.when(F.col(name) != NO_ID, F.col(name)).alias(new)

    return negative.select(
        "anchor_id",
        without_stand_in("positive_id", "positive_id"),
        "rank",
        without_stand_in("id", "negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
