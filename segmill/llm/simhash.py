"""Near-duplicates by SimHash fingerprints and BK-trees.

A text's fingerprint has a bit set where more than half of its shingles' hashes
have it. Fingerprints that differ in at most ``radius`` bits link.

Searching one tree per shard of the corpus with every fingerprint would touch each
pair of shards. So fingerprints are first blocked: of ``radius + 2`` bands of bits,
two at least are equal between linked fingerprints, so a pair meets in the block of
some two bands. Each block has its BK-trees, held by at most ``SHARD`` fingerprints
each; a large block has several, and those that may have partners elsewhere are
sent to each of them. Copies share a fingerprint and count once. In a block, all
within the radius of its least fingerprint are one component by that alone, so only
the others search: a block of near copies costs one comparison each.

A null or empty text has fingerprint 0 and links like any other. Rows that repeat
an id are classed together with it; a null id can be a member, and the smallest
id ignores it. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.llm.bktree import BITS, Forest, merge_labels
from segmill.llm.components import connected_components
from segmill.session import materialize

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
SHARD = 4096
PAIRS_AT_ONCE = 2_000_000


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """Hashes of all shingles of a text, in text order.

    Only A-Z are lower-cased. A text with fewer words than a shingle has one
    shingle, its whole word sequence; without words it has none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    return np.array(
        [
            digest(joined[a:b], SEED)
            for a, b in zip(starts[:n].tolist(), ends[len(found) - n :].tolist())
        ],
        dtype=np.uint64,
    )


def simhash(text: str | None, shingle_words: int) -> int:
    """Fingerprint of a text, as a signed 64-bit number.

    Only A-Z are lower-cased. A text with fewer words than a shingle has one
    shingle, its whole word sequence; without words the fingerprint is 0.
    """
    hashes = shingle_hashes(text, shingle_words).astype("<u8")
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.ones(n, np.float32) @ bits.astype(np.float32) if n < 1 << 24 else bits.sum(0)
    chosen = np.packbits(2 * counts > n, bitorder="little")
    return int(chosen.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""

    @F.pandas_udf("long")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle_words) for t in texts], dtype="int64")

    return docs.select("doc_id", of_text(F.col(text_column)).alias("fingerprint"))


def bands(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of radius + 2 bands that cover the bits."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block_keys(fingerprint: Column, radius: int) -> Column:
    def bits(offset: int, width: int) -> Column:
        return F.shiftrightunsigned(fingerprint, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    return F.array(
        *[
            F.struct(
                F.lit(table).alias("table"),
                F.shiftleft(bits(*a), b[1]).bitwiseOR(bits(*b)).alias("key"),
            )
            for table, (a, b) in enumerate(combinations(bands(radius), 2))
        ]
    )


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect exactly what the graph of all links connects.

    ``nodes`` has distinct fingerprints. Not every link is listed: in a block each
    fingerprint names one of its component.
    """
    p = F.col("fingerprint")
    rows = nodes.select(p, F.explode(_block_keys(p, radius)).alias("block")).select(
        "fingerprint", "block.table", "block.key"
    )
    blocks = (
        rows.groupBy("table", "key")
        .agg(
            F.count("*").alias("n"),
            F.min("fingerprint").alias("pivot"),
            F.bit_count(F.expr("bit_or(fingerprint) ^ bit_and(fingerprint)")).alias("spread"),
        )
        .where("n > 1")
    )
    members = rows.join(blocks, ["table", "key"]).withColumn(
        "near", F.bit_count(p.bitwiseXOR(F.col("pivot"))) <= radius
    )
    members = materialize(members, "blocks")
    stars = members.where(F.col("near") & (p != F.col("pivot"))).select(
        p.alias("a"), F.col("pivot").alias("b")
    )
    # where all differ in few bits, the pivot links them and nothing is left to search
    open_blocks = members.where(F.col("spread") > radius).withColumn(
        "shards", F.ceil(F.col("n") / shard).cast("long")
    )
    own = F.pmod(F.xxhash64(F.lit(SEED), p), F.col("shards"))
    held = open_blocks.select("table", "key", own.alias("shard"), F.lit(0).alias("role"), p)
    asking = open_blocks.where(~F.col("near")).select(
        "table",
        "key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
        F.lit(1).alias("role"),
        p,
    )
    sent = (
        held.unionByName(asking)
        .repartition("table", "key", "shard")
        .sortWithinPartitions("table", "key", "shard", "role", "fingerprint")
    )

    def searched(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            names = rows[["table", "key", "shard"]].to_numpy()
            ends = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield search_blocks(rows.iloc[:cut], radius)
            kept = rows.iloc[cut:]
            if len(kept) > 16 * shard:
                # one tree with very many queries: answer these, keep the tree
                yield search_blocks(kept, radius)
                kept = kept[kept["role"] == 0]
        if kept is not None and len(kept):
            yield search_blocks(kept, radius)

    return stars.unionByName(sent.mapInPandas(searched, "a long, b long"))


def search_blocks(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links that the queries of some blocks find, one per fingerprint and component.

    ``rows`` holds whole blocks in order: fingerprints of the tree (role 0), then
    queries (role 1).
    """
    names = rows[["table", "key", "shard"]].to_numpy()
    group = np.cumsum(np.r_[True, (names[1:] != names[:-1]).any(axis=1)]) - 1
    prints = rows["fingerprint"].to_numpy().view(np.uint64)
    held = rows["role"].to_numpy() == 0
    tree_group, tree = group[held], prints[held]
    asked_group, asked = group[~held], prints[~held]
    nothing = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    if not len(tree) or not len(asked):
        return nothing
    forest = Forest(tree_group, tree)
    present = tree_group[forest.root_of_group]
    at = np.searchsorted(present, asked_group)
    known = (at < len(present)) & (present[np.minimum(at, len(present) - 1)] == asked_group)
    at, asked, asked_group = at[known], asked[known], asked_group[known]
    roots = forest.root_of_group[at]
    sizes = np.bincount(tree_group, minlength=group[-1] + 1)[asked_group]
    # queries and tree nodes are numbered together; a query at its own node is a link of distance 0
    labels = np.arange(len(tree) + len(asked))
    chunk = np.cumsum(sizes) // PAIRS_AT_ONCE
    for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(chunk)) + 1):
        if len(part):
            q, node = forest.search(asked[part], roots[part], radius)
            merge_labels(labels, part[q] + len(tree), node)
    everything = np.r_[tree, asked].view(np.int64)
    out = pd.DataFrame({"a": everything, "b": everything[labels]})
    return out[out["a"] != out["b"]].drop_duplicates()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable over links."""
    prints = materialize(prints, "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes")
    roots = connected_components(links(nodes.select("fingerprint"), radius))
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(component, "root").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each class of near copies, columns kept.

    Rows with the same id are one document: one of them stays. A row without an id
    gets one from its text, above all others, so texts that repeat without an id
    stay once, and not at all if a document with an id links to them. Texts without
    words share a fingerprint and so are one class.
    """
    names = docs.columns
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62).cast("long"))
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")
    keyed = docs.select(row, F.coalesce("doc_id", stand_in).alias("doc_id"), "text")
    found = classes(fingerprints(keyed, shingle_words), radius)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows = keyed.select("_row", "doc_id").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.select(*[F.col("_row")[n].alias(n) for n in names])
