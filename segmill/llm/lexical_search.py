"""Ranked lexical search: Block-Max MaxScore over document shards.

**Index.** Tasks cut their documents, as they come, into shards of about
``SHARD_TERMS`` terms and invert each where it is, so no posting is shuffled. A term's
list in a shard is one row: postings in the order of the documents, in blocks of
``BLOCK``, packed as variable-length bytes. Each block has its last document, its end
in the bytes, and its (occurrences, document length) pairs that no other posting of
the block beats in both. As a score rises with the first and falls with the second,
the best of these is the block's true maximum under any corpus statistics, so an index
needs none and shards can be added to it.

**Search.** Statistics come from the index: the corpus's from a row per shard, a
term's document count from its lists. Each task searches whole shards for a block of
queries. A list's best score is its global bound in the shard: lists whose bounds
together stay below the 20th score so far are non-essential, and only the essential
ones bring up candidates. The block maxima of the non-essential lists then reject
candidates, and only blocks that hold one still left are unpacked. The heap of the
best goes along from shard to shard within a task, so later shards start with a high
bar; the heaps of the tasks are merged last.

Hot terms have a list in every shard, each as long as a shard at most. Queries are
the rows of a table; they are dealt with in blocks of ``QUERY_BLOCK``, and only their terms
are looked up, by broadcast up to ``BROADCAST_TERMS`` (term, item) pairs and beyond by a join
in which a term is spread over ``SALTS`` keys.

Terms are read as bytes, in pieces, so a very long text is never held as a list of its
terms. Null and empty texts have none; such documents are not counted and not found,
and such queries give no rows. Rows that repeat a doc_id are documents of their own.
Rows that repeat an item_id are one query, of all their terms. Equal scores go by
ascending doc_id, null last. Empty tables give an empty result. Other columns do not
matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.session import materialize

SHARD_TERMS = 2_000_000
BLOCK = 64
RANGE = 4096
QUERY_BLOCK = 256
BROADCAST_TERMS = 200_000
SALTS = 64
PIECE = 1 << 20
NO_ID = (1 << 63) - 1

# What separates terms: every ASCII character but digits and letters. A-Z become a-z.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

INDEX = "shard long, term binary, n long, blocks binary, pairs binary, postings binary"


def pieces_of_terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a piece of it at a time."""
    folded = (text or "").encode("utf-8", "replace").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = len(folded)
        if at + PIECE < end:
            cut = folded.find(b" ", at + PIECE)
            end = cut if cut >= 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for terms in pieces_of_terms(text):
        found.update(terms)
    return found


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as bytes, seven bits each, the last one below 128; bytes per number."""
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += values >> bits > 0
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = sizes > k
        more = np.where(sizes[some] > k + 1, 128, 0)
        out[ends[some] - sizes[some] + k] = ((values[some] >> (7 * k)) & 127) | more
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


class Inverter:
    """The documents of a shard to come, and the lists they make."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, text: str | None) -> None:
        counts = term_counts(text)
        if not counts:
            return
        self.ids.append(doc_id)
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, counts), np.int64, len(counts)))
        times = np.fromiter(counts.values(), np.int64, len(counts))
        self.times.append(times)
        self.lengths.append(int(times.sum()))
        self.size += self.lengths[-1]

    def rows(self, shard: int) -> pd.DataFrame:
        """The lists, and a row without a term that holds the documents' ids and lengths."""
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        # documents of a shard are numbered by id, so that ties are met in their order
        order = np.lexsort((lengths, ids))
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        term, times = np.concatenate(self.terms), np.concatenate(self.times)
        doc = np.repeat(number, [len(t) for t in self.terms])
        place = np.lexsort((doc, term))
        term, doc, times = term[place], doc[place], times[place]
        n = np.bincount(term)
        starts = np.cumsum(n) - n
        nth = np.arange(len(term)) - np.repeat(starts, n)
        opens = nth % BLOCK == 0
        gap = doc.copy()
        gap[1:] -= np.where(opens[1:], 0, doc[:-1])
        data, sizes = packed(np.stack([gap, times], axis=1).ravel())
        ends = np.cumsum(sizes.reshape(-1, 2).sum(axis=1))
        block = np.cumsum(opens) - 1
        last = np.flatnonzero(np.r_[opens[1:], True])
        of_list = term[last]
        byte_start = np.r_[0, ends][starts]
        heads = np.stack([doc[last], ends[last] - byte_start[of_list]], axis=1).astype(np.int32)
        kept = best_pairs(block, times, lengths[order][doc])
        block_of_list = block[starts]
        pairs = np.stack(
            [block[kept] - block_of_list[term[kept]], times[kept], lengths[order][doc[kept]]], axis=1
        ).astype(np.int32)
        names = list(self.numbers)
        return pd.DataFrame(
            {
                "shard": shard,
                "term": [None, *names],
                "n": np.r_[lengths.sum(), n],
                "blocks": [lengths[order].tobytes(), *slices(heads, np.bincount(of_list))],
                "pairs": [None, *slices(pairs, np.bincount(term[kept]))],
                "postings": [ids[order].tobytes(), *slices(data, np.diff(np.r_[byte_start, len(data)]))],
            }
        )


def slices(rows: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """``rows`` as bytes, cut into runs of ``counts`` rows."""
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    data = rows.tobytes()
    ends = (np.cumsum(counts) * width).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def best_pairs(block: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places, in order of block, of the postings that no other of their block beats.

    Shortest documents come first in their block; one behind counts where it has more occurrences
    than all before it.
    """
    order = np.lexsort((-times, lengths, block))
    height = block[order] * (int(times.max()) + 1) + times[order]
    best = np.maximum.accumulate(height)
    return order[np.r_[True, height[1:] > best[:-1]]]


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row per shard and term, and one per shard for its documents; written once."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        made, some = 0, Inverter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                some.add(doc_id, text)
                if some.size >= shard_terms:
                    yield some.rows((task << 32) + made)
                    made, some = made + 1, Inverter()
        if some.ids:
            yield some.rows((task << 32) + made)

    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return materialize(chosen.mapInPandas(run, INDEX), "index")


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term and how often the item has it."""

    @F.pandas_udf("array<struct<term:binary,times:long>>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([list(term_counts(t).items()) for t in texts])

    item = F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id")
    found = items.select(item, F.explode(counted("text")).alias("t")).select("item_id", "t.*")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def asked_terms(items: DataFrame) -> tuple[DataFrame, int]:
    """(query block, term) with the items that have it, ``QUERY_BLOCK`` or so at most; number of blocks."""
    terms = materialize(query_terms(items), "asked")
    n_blocks = max(1, -(-terms.select("item_id").distinct().count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int").alias("block")
    by = F.sort_array(F.collect_list(F.struct("item_id", "times")))
    asked = terms.groupBy(block, "term").agg(by.alias("by"))
    return asked.select("block", "term", F.col("by.item_id").alias("items"), F.col("by.times").alias("times")), n_blocks


def weight(n_docs: int, holding: Column) -> Column:
    return F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * holding + 1))).cast("long")


def with_asked(lists: DataFrame, asked: DataFrame, broadcast: bool) -> DataFrame:
    """The lists of the terms asked for, by their size: a hot term has a list in every shard."""
    if broadcast:
        return lists.join(F.broadcast(asked), "term")
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lists.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["term", "salt"]).drop("salt")


class List:
    """A term's postings in a shard, unpacked block by block."""

    def __init__(self, row, norms: np.ndarray, norm_of: Callable[[np.ndarray], np.ndarray]):
        heads = np.frombuffer(row.blocks, np.int32).reshape(-1, 2)
        pairs = np.frombuffer(row.pairs, np.int32).reshape(-1, 3).astype(np.int64)
        self.last, self.ends = heads[:, 0], np.r_[0, heads[:, 1]]
        self.data = np.frombuffer(row.postings, np.uint8)
        self.norms = norms
        first = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
        # whole numbers arrive as floats where a column has nulls
        self.weight = int(row.weight)
        best = self.weight * saturation(pairs[:, 1], norm_of(pairs[:, 2]))
        # one more block, of nothing, for what lies behind the last
        self.maxima = np.r_[np.maximum.reduceat(best, first), 0]
        self.bound = int(self.maxima.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block, unpacked when first needed."""
        if b not in self.known:
            both = unpacked(self.data[self.ends[b] : self.ends[b + 1]]).reshape(-1, 2)
            docs = np.cumsum(both[:, 0])
            self.known[b] = docs, self.weight * saturation(both[:, 1], self.norms[docs])
        return self.known[b]

    def between(self, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Postings of the blocks that reach into [start, stop)."""
        first = int(np.searchsorted(self.last, start))
        for b in range(first, len(self.last)):
            docs, scores = self.block(b)
            if docs[0] >= stop:
                break
            inside = slice(*np.searchsorted(docs, (start, stop)))
            yield docs[inside], scores[inside]
            if self.last[b] >= stop - 1:
                break

    def add_to(self, docs: np.ndarray, scores: np.ndarray, times: int) -> None:
        """Adds the scores of those of the ascending ``docs`` that the list holds."""
        where = np.searchsorted(self.last, docs)
        for b in np.unique(where[where < len(self.last)]):
            held, score = self.block(b)
            mine = np.flatnonzero(where == b)
            at = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
            hit = held[at] == docs[mine]
            scores[mine[hit]] += times * score[at[hit]]


def saturation(times: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 12 * norms)


class Heap:
    """The best documents of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.ids = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)

    @property
    def bar(self) -> int:
        """The least score that can still come in; at the bar itself a smaller id does."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.r_[self.ids, ids], np.r_[self.scores, scores]
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]


def search_shard(lists: list[tuple[List, int]], ids: np.ndarray, heap: Heap) -> None:
    """Block-Max MaxScore for one query: (list, times asked for) of its terms in a shard."""
    lists = sorted(lists, key=lambda pair: pair[0].bound * pair[1])
    upto = np.cumsum([held.bound * times for held, times in lists])
    for start in range(0, len(ids), RANGE):
        bar = heap.bar
        # together, lists before this one cannot lift a document to the bar
        essential = int(np.searchsorted(upto, bar))
        if essential == len(lists):
            return
        stop = min(start + RANGE, len(ids))
        sums = np.zeros(stop - start, np.int64)
        for held, times in lists[essential:]:
            for docs, scores in held.between(start, stop):
                sums[docs - start] += times * scores
        docs = np.flatnonzero(sums)
        scores = sums[docs]
        docs += start
        rest = [times * held.maxima[np.searchsorted(held.last, docs)] for held, times in lists[:essential]]
        open_bound = np.sum(rest, axis=0) if rest else np.zeros(len(docs), np.int64)
        for i in range(essential - 1, -1, -1):
            left = scores + open_bound >= bar
            docs, scores, open_bound = docs[left], scores[left], open_bound[left]
            rest = [r[left] for r in rest[: i + 1]]
            open_bound = open_bound - rest[i]
            lists[i][0].add_to(docs, scores, lists[i][1])
        left = scores >= bar
        heap.offer(ids[docs[left]], scores[left])


def search(index: DataFrame, items: DataFrame, k: int = 20, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item."""
    asked, n_blocks = asked_terms(items)
    asked = materialize(asked, "terms")
    small = (asked.agg(F.sum(F.size("items"))).first()[0] or 0) <= broadcast_terms
    shards, lists = index.where(F.col("term").isNull()), index.where(F.col("term").isNotNull())
    totals = shards.agg(F.sum(F.length("postings")), F.sum("n")).first()
    n_docs, n_terms = (totals[0] or 0) // 8, totals[1] or 0
    holding = (
        with_asked(lists.select("shard", "term", "n"), asked.select("term").distinct(), small)
        .groupBy("term")
        .agg(F.sum("n").alias("holding"))
    )
    weighted = asked.join(holding, "term").withColumn("weight", weight(n_docs, F.col("holding"))).drop("holding")
    met = with_asked(lists, materialize(weighted, "weighted"), small)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    sent = (
        met.unionByName(shards.select("*", every_block), allowMissingColumns=True)
        .repartition("block", "shard")
        .sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())
    )

    def norm_of(lengths: np.ndarray) -> np.ndarray:
        return 75 + (25 * lengths * n_docs) // n_terms

    def searched(rows: list, heaps: dict[int, Heap]) -> None:
        shard, *found = rows
        if shard.term is not None or not found:
            return
        ids = np.frombuffer(shard.postings, np.int64)
        norms = norm_of(np.frombuffer(shard.blocks, np.int64))
        queries: dict[int, list[tuple[List, int]]] = {}
        for row in found:
            held = List(row, norms, norm_of)
            for item, times in zip(row.items, row.times):
                queries.setdefault(int(item), []).append((held, int(times)))
        for item, lists in queries.items():
            search_shard(lists, ids, heaps.setdefault(item, Heap(k)))

    def best(heaps: dict[int, Heap]) -> pd.DataFrame:
        sizes = [len(h.ids) for h in heaps.values()]
        empty = [np.empty(0, np.int64)]
        return pd.DataFrame(
            {
                "item_id": np.repeat(np.fromiter(heaps, np.int64, len(heaps)), sizes),
                "doc_id": np.concatenate([h.ids for h in heaps.values()] or empty),
                "score": np.concatenate([h.scores for h in heaps.values()] or empty),
            }
        )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, Heap] = {}
        rows: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if rows and (row.block, row.shard) != (rows[0].block, rows[0].shard):
                    searched(rows, heaps)
                    if row.block != rows[0].block:
                        yield best(heaps)
                        heaps = {}
                    rows = []
                rows.append(row)
        if rows:
            searched(rows, heaps)
            yield best(heaps)

    found = sent.mapInPandas(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def without_stand_in(name: str) -> Column:
        return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)

    return ranked.select(without_stand_in("item_id"), "rank", without_stand_in("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item, by an index made for the purpose."""
    return search(build_index(docs), items, k)
