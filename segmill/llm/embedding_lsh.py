"""Near-duplicate vectors by p-stable hashing for the Euclidean distance.

Vectors scaled to length one are projected on ``PROJECTIONS`` normal directions in
each of ``TABLES`` tables; a projection, shifted and cut into cells of ``WIDTH``,
gives one number, and the numbers of a table make the bucket. Vectors of one bucket
and label are compared by their cosine in double precision.

A pair is counted in the first table that brings it together, so ``n_links`` needs
no list of pairs: each block of a bucket gives counts, and links that span its
components. Equal vectors with equal labels are one vector with a multiplicity. A
bucket with more than ``SHARD`` vectors is dealt into shards, and each pair of shards
is a block of its own.

At a cosine of 0.93 (a distance of 0.37) a table separates a pair with probability
0.83, so 16 tables find 95 of 100 such pairs, and 99.8 of 100 at 0.97.

A vector that is null, empty or zero, or holds a null, NaN or infinite component,
and one without a label, links with nothing and is its own component. Vectors of
different lengths do not link. Rows that repeat a vec_id are vectors of their own
that share the id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.llm.bktree import merge_labels
from segmill.llm.components import connected_components
from segmill.session import materialize

COSINE = 0.93
TABLES = 16
PROJECTIONS = 8
WIDTH = 1.5
SHARD = 2048
SEED = 42
ROWS_AT_ONCE = 512
PAIRS_AT_ONCE = 100_000
SMALL = 64
BLOCK = ["table", "key", "label", "dim", "low", "high"]


@lru_cache(maxsize=8)
def directions(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts, and odd multipliers that mix the numbers of a table."""
    rng = np.random.default_rng([SEED, dim])
    shape = (TABLES, PROJECTIONS)
    return (
        rng.standard_normal((dim, TABLES * PROJECTIONS)),
        rng.uniform(0, WIDTH, TABLES * PROJECTIONS),
        rng.integers(0, 1 << 62, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
    )


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """Bucket of each vector in each table, mixed to 32 bits."""
    along, shift, mix = directions(vectors.shape[1])
    # scaled by the largest component first, so that no square under- or overflows
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    cells = np.floor((unit @ along + shift) / WIDTH).astype(np.int64).view(np.uint64)
    mixed = (cells.reshape(-1, TABLES, PROJECTIONS) * mix).sum(axis=2, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def can_link() -> Column:
    """Whether a row has a label and a finite vector other than zero."""
    e = F.col("embedding")
    bad = F.exists(
        e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return F.coalesce(F.col("label").isNotNull() & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def hashed(distinct: DataFrame) -> DataFrame:
    """vid, mult, label, dim, vector (packed as it came) and keys (one bucket per table)."""
    kind = distinct.schema["embedding"].dataType.elementType.simpleString()
    packed = np.float32 if kind == "float" else np.float64

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                vectors = np.array(part["embedding"].tolist(), dtype=np.float64)
                yield pd.DataFrame(
                    {
                        "vid": part["vid"],
                        "mult": part["mult"],
                        "label": part["label"],
                        "dim": np.full(len(part), dim, np.int32),
                        "vector": [v.tobytes() for v in vectors.astype(packed)],
                        "keys": list(bucket_keys(vectors)),
                    }
                )

    return distinct.select("vid", "mult", "label", "embedding").mapInPandas(
        run, "vid long, mult long, label int, dim int, vector binary, keys array<int>"
    )


def unpack(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in double precision, their lengths and bucket keys."""
    dim = int(block["dim"].iloc[0])
    joined = b"".join(block["vector"])
    kind = np.float32 if len(joined) == 4 * dim * len(block) else np.float64
    vectors = np.frombuffer(joined, dtype=kind).reshape(len(block), dim).astype(np.float64)
    # scaled by the largest component first, so that no square under- or overflows
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors, norms, np.array(block["keys"].tolist(), dtype=np.int32)


def compare_large(block: pd.DataFrame, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, weighted, and the least row it is linked to over others.

    Rows of side 0 and side 1 are compared with each other or, where there is one
    side only, among themselves.
    """
    vectors, norms, keys = unpack(block)
    table = int(block["table"].iloc[0])
    side, mult = block["side"].to_numpy(), block["mult"].to_numpy()
    links, labels = np.zeros(len(block), np.int64), np.arange(len(block))
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(two)
    two = one if within else two
    for start in range(0, len(one), ROWS_AT_ONCE):
        rows = one[start : start + ROWS_AT_ONCE]
        close = vectors[rows] @ vectors[two].T / norms[rows][:, None] / norms[two] >= cosine
        if within:
            close &= rows[:, None] < two[None, :]
        for earlier in range(table):
            close &= keys[rows, earlier][:, None] != keys[two, earlier][None, :]
        i, j = np.nonzero(close)
        links[rows] += close @ mult[two]
        links[two] += mult[rows] @ close
        merge_labels(labels, rows[i], two[j])
    return links, labels


def compare_small(rows: pd.DataFrame, block: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``compare_large`` for many small blocks of one length of vectors at once."""
    vectors, norms, keys = unpack(rows)
    table, mult = rows["table"].to_numpy(), rows["mult"].to_numpy()
    links, labels = np.zeros(len(rows), np.int64), np.arange(len(rows))
    end = np.searchsorted(block, block, "right")
    partners = end - np.arange(len(rows)) - 1
    for part in np.array_split(np.arange(len(rows)), max(1, int(partners.sum()) // PAIRS_AT_ONCE)):
        n = partners[part]
        i = np.repeat(part, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        close = np.einsum("ij,ij->i", vectors[i], vectors[j]) / norms[i] / norms[j] >= cosine
        i, j = i[close], j[close]
        same = keys[i] == keys[j]
        first = same.argmax(axis=1) == table[i]
        i, j = i[first], j[first]
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        merge_labels(labels, i, j)
    return links, labels


def compare_rows(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts and links of some whole blocks in order."""
    names = rows[BLOCK].to_numpy()
    block = np.cumsum(np.r_[True, (names[1:] != names[:-1]).any(axis=1)]) - 1
    large = np.bincount(block)[block] > SMALL
    links, other = np.zeros(len(rows), np.int64), rows["vid"].to_numpy().copy()
    vid = rows["vid"].to_numpy()

    def take(where: np.ndarray, result: tuple[np.ndarray, np.ndarray]) -> None:
        links[where] = result[0]
        other[where] = vid[where[result[1]]]

    for b in np.unique(block[large]):
        where = np.flatnonzero(block == b)
        take(where, compare_large(rows.iloc[where], cosine))
    dims = rows["dim"].to_numpy()
    for dim in np.unique(dims[~large]):
        where = np.flatnonzero(~large & (dims == dim))
        take(where, compare_small(rows.iloc[where], block[where], cosine))
    out = pd.DataFrame({"vid": vid, "n": links, "other": other})
    return out[links > 0]


def compared(blocks: DataFrame, cosine: float) -> DataFrame:
    """(vid, n, other): links counted in a block, and a vector linked over others."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            names = rows[BLOCK].to_numpy()
            ends = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield compare_rows(rows.iloc[:cut], cosine)
            kept = rows.iloc[cut:]
        if kept is not None and len(kept):
            yield compare_rows(kept, cosine)

    together = blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side", "vid")
    return together.mapInPandas(run, "vid long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    distinct = (
        rows.where(can_link())
        .groupBy("label", "embedding")
        .agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    )
    # the numbers hold because they are written once
    numbered = materialize(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    keyed = materialize(hashed(numbered), "hashed")
    entries = keyed.select("vid", "label", "dim", F.posexplode("keys").alias("table", "key"))
    bucket = ["table", "key", "label", "dim"]
    counts = entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    placed = (
        entries.join(counts, bucket)
        .withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "vid"), F.col("shards")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select(
            "vid",
            *bucket,
            F.least("own", "with").alias("low"),
            F.greatest("own", "with").alias("high"),
            (F.col("own") > F.col("with")).cast("int").alias("side"),
        )
    )
    blocks = placed.join(keyed.select("vid", "mult", "vector", "keys"), "vid")
    found = materialize(compared(blocks, cosine), "links")
    counted = found.groupBy("vid").agg(F.sum("n").alias("n"))
    roots = connected_components(
        found.where("vid <> other").select(F.col("vid").alias("a"), F.col("other").alias("b"))
    )
    rooted = (
        numbered.join(roots, F.col("vid") == F.col("node"), "left")
        .join(counted, "vid", "left")
        .select(
            "label",
            "embedding",
            "least",
            F.coalesce("root", "vid").alias("root"),
            (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
        )
    )
    rooted = materialize(rooted, "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(component, "root").select("label", "embedding", "n_links", "component_id")
    linked = (
        rows.where(can_link())
        .join(known, ["label", "embedding"])
        .select("vec_id", "n_links", "component_id")
    )
    alone = rows.where(~can_link()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
