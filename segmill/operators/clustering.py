"""k-means: full, by mini-batches, elbow curve, assignment."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.operators.profile import random_sample
from segmill.session import materialize

Centres = Sequence[Sequence[float]]

# Far beyond what a fit takes; it is there to end one that swings to and fro.
MAX_ITERATIONS = 1000
TOLERANCE = 1e-6
# Rows that starting centres are drawn from.
START_ROWS = 10_000
# Rows near a border between clusters that a scan hands over, at most; all models share them.
BORDER_ROWS = 120_000
# Bounds of the classes that margins are counted in.
MARGINS = 2.0 ** (np.arange(-56, 25) / 4)
# A centre with less than this share of the largest weight is starved.
STARVED = 0.01

CENTRES_SCHEMA = "cluster int, center array<double>, weight double"


def nearest_centre(features: Column, centres: Centres) -> Column:
    """Index of the nearest centre of an ``array<double>`` column, the lowest on a tie.

    On whole Arrow batches: several times faster than array expressions, which
    Spark evaluates row by row outside its generated code.
    """
    table = np.asarray(centres, dtype="float64")

    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        if points.empty:
            return pd.Series([], dtype="int32")
        rows = np.stack(points.to_numpy())
        distances = np.stack([((rows - centre) ** 2).sum(axis=1) for centre in table], axis=1)
        return pd.Series(distances.argmin(axis=1).astype("int32"))

    return nearest(features)


def with_labels(matrix: DataFrame, centres: Centres, into: str = "label") -> DataFrame:
    return matrix.withColumn(into, nearest_centre(vector_to_array("features"), centres))


def assign_clusters(matrix: DataFrame, centres: Centres) -> DataFrame:
    """``id_client`` and the nearest centre, in one projection."""
    return with_labels(matrix, centres, "cluster").select("id_client", "cluster")


def total_inertia(matrix: DataFrame) -> float:
    """Summed squared distance to the mean: the k = 1 end of the elbow curve."""
    row = matrix.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).first()
    count = row.s["count"]
    return float(sum(row.s["variance"])) * (count - 1) if count else 0.0


def _fit(matrix: DataFrame, k: int, seed: int, max_iter: int = MAX_ITERATIONS) -> KMeansModel:
    """Runs until the centres stand still; warns where ``max_iter`` ends it before."""
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="_raw").fit(matrix)
    if model.summary.numIter >= max_iter:
        warnings.warn(f"k-means with k={k} stopped after {max_iter} iterations", stacklevel=3)
    return model


def require_rows(matrix: DataFrame, k: int) -> None:
    if matrix.limit(k).count() < k:
        raise ValueError(f"{k} clusters need at least {k} rows")


def _size_order(model: KMeansModel) -> list[int]:
    """Cluster numbers by descending size, then by first coordinate."""
    sizes, centres = model.summary.clusterSizes, model.clusterCenters()
    return sorted(range(len(centres)), key=lambda i: (-sizes[i], *centres[i]))


def kmeans_fit(matrix: DataFrame, k: int = 3, seed: int = 42) -> list[list[float]]:
    """Centres of a full k-means, largest cluster first; fewer where rows repeat too often."""
    require_rows(matrix, k)
    if k == 1:
        return [matrix.select(Summarizer.mean(F.col("features"))).first()[0].toArray().tolist()]
    model = _fit(matrix, k, seed)
    centres = model.clusterCenters()
    return [centres[i].tolist() for i in _size_order(model)]


def kmeans_labels(matrix: DataFrame, k: int = 3, seed: int = 42, into: str = "label") -> DataFrame:
    """``matrix`` with the cluster of a full k-means, numbered by size."""
    require_rows(matrix, k)
    if k == 1:
        return matrix.withColumn(into, F.lit(0))
    model = _fit(matrix, k, seed)
    order = _size_order(model)
    numbers = F.array(*[F.lit(order.index(i)) for i in range(len(order))])
    return model.transform(matrix).withColumn(into, numbers[F.col("_raw")]).drop("_raw")


def kmeans_fit_predict(matrix: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    return kmeans_labels(matrix, k, seed, "cluster").select("id_client", "cluster")


def starting_centres(matrix: DataFrame, k_values: Sequence[int], seed: int = 42, rows: int = START_ROWS) -> dict:
    """Per k, rows far from each other (k-means++), drawn from ``rows`` rows chosen by content."""
    some = random_sample(matrix.select("id_client", "features"), rows, seed, ["id_client"])
    found = sorted((row["id_client"], row["features"].toArray().tolist()) for row in some.collect())
    sample = np.array([vector for _, vector in found])
    starts = {}
    for k in k_values:
        draw = np.random.default_rng([seed, k])
        chosen = [int(draw.integers(len(sample)))]
        nearest = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            # where rows repeat too often for k centres, any row serves
            weights = nearest / nearest.sum() if nearest.sum() > 0 else None
            chosen.append(int(draw.choice(len(sample), p=weights)))
            nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        starts[k] = sample[chosen]
    return starts


def _drift(before: np.ndarray, after: np.ndarray) -> float:
    """By how much a row's margin may have changed: the two longest ways that centres went."""
    ways = np.sqrt(((after - before) ** 2).sum(axis=1))
    return float(np.sort(ways)[-2:].sum())


@dataclass
class _Scan:
    """What one scan tells of a model.

    ``n`` and ``total`` are of the settled rows by cluster; ``border`` holds the rows whose
    margin is within the model's budget. ``margins`` counts all rows by margin.
    """

    n: np.ndarray
    total: np.ndarray
    border: np.ndarray
    margins: np.ndarray
    inertia: float = 0.0

    def step(self, centres: np.ndarray) -> np.ndarray:
        """The means of the rows nearest to each centre; a centre without rows stays."""
        rows = self.border
        nearest = (np.einsum("ij,ij->i", centres, centres) - 2 * rows @ centres.T).argmin(axis=1)
        member = np.zeros((len(centres), len(rows)))
        member[nearest, np.arange(len(rows))] = 1
        n, total = self.n + member.sum(axis=1), self.total + member @ rows
        moved = centres.copy()
        moved[n > 0] = total[n > 0] / n[n > 0, None]
        return moved

    def next_budget(self, rows: int, drift: float, pace: float) -> float:
        """A margin that at most so many rows, and a quarter of all, are within after the drift.

        0 if a step or two would use it up.
        """
        within = np.cumsum(self.margins[:-1]) <= min(rows, self.margins.sum() // 4)
        budget = MARGINS[within.sum() - 1] - drift if within.any() else 0.0
        return float(budget) if budget >= max(MARGINS[0], 2 * pace) else 0.0


def _stored_rows(matrix: DataFrame) -> DataFrame:
    """The vectors as arrays, written once and dealt evenly over the tasks of the scans."""
    rows = matrix.select(vector_to_array("features").alias("row"), F.monotonically_increasing_id().alias("place"))
    return materialize(rows.repartition("place").select("row"), "rows")


def _joint_scan(stored: DataFrame, models: dict[int, np.ndarray], budgets: dict[int, float]) -> dict[int, _Scan]:
    """Per model, its settled rows by cluster and its border rows: one scan and one aggregate for all.

    Beside a row per cluster, a task gives the counts of margins (cluster -1) and its border
    rows in one array (cluster -2, and its own number, so that they are only gathered). What
    runs in the tasks names no function of this module, which they then need not import.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            every = np.arange(len(rows))
            lengths = np.einsum("ij,ij->i", rows, rows)
            for model, centres in models.items():
                distances = lengths[:, None] - 2 * rows @ centres.T + np.einsum("ij,ij->i", centres, centres)
                nearest = distances.argmin(axis=1)
                least = np.maximum(distances[every, nearest], 0)
                distances[every, nearest] = np.inf
                margin = np.sqrt(np.maximum(distances.min(axis=1), 0)) - np.sqrt(least)
                near = (margin <= budgets[model]) & (budgets[model] > 0)
                settled = np.zeros((len(centres), len(rows)))
                settled[nearest[~near], every[~near]] = 1
                told = (
                    settled.sum(axis=1),
                    settled @ rows,
                    np.bincount(np.searchsorted(MARGINS, margin), minlength=len(MARGINS) + 1),
                    float(least.sum()),
                )
                *sums, border = held.get(model, (0, 0, 0, 0, []))
                held[model] = [*(a + b for a, b in zip(sums, told)), [*border, rows[near]] if near.any() else border]
        out = []
        for model, (n, total, margins, inertia, border) in held.items():
            out.append((model, -1, -1, 0, inertia, margins.astype("float64")))
            out += [(model, c, -1, int(n[c]), 0.0, total[c]) for c in np.flatnonzero(n).tolist()]
            if border:
                some = np.concatenate(border)
                out.append((model, -2, TaskContext.get().partitionId(), len(some), 0.0, some.ravel()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=names)

    names = ["model", "cluster", "part", "n", "inertia", "total"]
    parts = stored.mapInArrow(run, "model long, cluster long, part long, n long, inertia double, total array<double>")
    found = parts.groupBy("model", "cluster", "part").agg(
        F.sum("n").alias("n"),
        F.sum("inertia").alias("inertia"),
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
    )
    scans = {
        model: _Scan(
            np.zeros(len(c), np.int64), np.zeros(c.shape), np.empty((0, c.shape[1])), np.zeros(len(MARGINS) + 1)
        )
        for model, c in models.items()
    }
    for batch in found.toArrow().to_batches():
        model, cluster, _, n, inertia, total = (batch.column(i) for i in range(6))
        for i in range(batch.num_rows):
            scan, values, c = scans[model[i].as_py()], np.asarray(total[i].values), cluster[i].as_py()
            if c == -1:
                scan.margins, scan.inertia = values, inertia[i].as_py()
            elif c == -2:
                scan.border = np.concatenate([scan.border, values.reshape(n[i].as_py(), -1)])
            else:
                scan.n[c], scan.total[c] = n[i].as_py(), values
    return scans


def joint_kmeans(
    matrix: DataFrame, starts: dict[int, np.ndarray], max_iter: int = MAX_ITERATIONS, tolerance: float = TOLERANCE
) -> tuple[dict[int, tuple[np.ndarray, float]], int]:
    """Centres and inertia of several models by Lloyd steps taken together, and the number of scans.

    Each scan moves the centres of all models that are not done; a model whose centres
    stand still, to ``tolerance``, drops out after its inertia is known. A centre without rows stays.

    The steps are those of scanning all rows each time, but most rows cannot change their
    cluster while the centres have hardly moved: a row's margin, by which its second centre is
    farther than its nearest, shrinks by no more than the centres' drift. So a scan sums the rows with
    a greater margin than a budget and hands over the others, ``BORDER_ROWS`` in all and a
    quarter of the rows at most; steps are taken on these until the drift has used the budget, and only then the rows are scanned again.
    """
    stored = _stored_rows(matrix)
    models = {model: np.asarray(centres, dtype="float64") for model, centres in starts.items()}
    budgets = dict.fromkeys(models, 0.0)
    steps = dict.fromkeys(models, 0)
    still: set[int] = set()
    found: dict[int, tuple[np.ndarray, float]] = {}
    scans = 0
    while models:
        told = _joint_scan(stored, models, budgets)
        share = BORDER_ROWS // len(models)
        scans += 1
        for model, centres in list(models.items()):
            scan, at = told[model], centres
            if model in still or steps[model] >= max_iter:
                found[model] = centres, scan.inertia
                del models[model]
                if model not in still:
                    warnings.warn(f"k-means {model} stopped after {max_iter} iterations", stacklevel=2)
                continue
            while steps[model] < max_iter and model not in still:
                moved = scan.step(at)
                pace = _drift(at, moved)
                steps[model] += 1
                if np.abs(moved - at).max(initial=0) <= tolerance:
                    still.add(model)
                at = moved
                # short of the budget, as margins are rounded
                if _drift(centres, at) > 0.9 * budgets[model]:
                    break
            budgets[model] = scan.next_budget(share, _drift(centres, at), pace)
            models[model] = at
    return found, scans


def kmeans_elbow(matrix: DataFrame, k_values: Sequence[int] = tuple(range(1, 15)), seed: int = 42) -> DataFrame:
    """``k, inertia`` per k, all models fitted together: no more scans than the slowest needs."""
    require_rows(matrix, max(k_values))
    found, _ = joint_kmeans(matrix, starting_centres(matrix, k_values, seed))
    curve = [(k, found[k][1]) for k in k_values]
    return matrix.sparkSession.createDataFrame(curve, "k int, inertia double")


def batch_totals(batch: DataFrame, centres: Centres) -> DataFrame:
    """Per centre: how many rows of the batch are nearest to it, and their sum."""
    nearest = nearest_centre(vector_to_array("features"), centres)
    return (
        batch.select(nearest.alias("cluster"), "features")
        .groupBy("cluster")
        .agg(
            F.count("*").alias("n"),
            vector_to_array(Summarizer.sum(F.col("features"))).alias("total"),
        )
    )


def minibatch_step(
    batch: DataFrame, centres: Centres, weights: Sequence[float]
) -> tuple[list[list[float]], list[float]]:
    """One incremental update: each centre moves to the weighted mean of itself and its rows.

    Only k vectors come back to the driver; an empty batch changes nothing.
    """
    new_centres, new_weights = [list(c) for c in centres], list(weights)
    for row in batch_totals(batch, centres).collect():
        i, before = row["cluster"], weights[row["cluster"]]
        new_weights[i] = before + row["n"]
        new_centres[i] = [(c * before + t) / new_weights[i] for c, t in zip(centres[i], row["total"])]
    return new_centres, new_weights


def reassign_starved(
    batch: DataFrame, centres: Centres, weights: Sequence[float], seed: int
) -> tuple[list[list[float]], list[float]]:
    """Moves centres that attract hardly any rows to rows of the batch that lie far from all centres.

    Rows are drawn without replacement, weighted by their squared distance: of -ln(u) / weight,
    with u from a seeded hash of the id, the smallest win, so every task keeps as many as there
    are starved centres. A moved centre takes the least weight of the others.
    """
    starved = [i for i, w in enumerate(weights) if w < STARVED * max(weights)]
    if not starved:
        return [list(c) for c in centres], list(weights)
    table = np.asarray(centres, dtype="float64")

    @F.pandas_udf("double")
    def squared(points: pd.Series) -> pd.Series:
        if points.empty:
            return pd.Series([], dtype="float64")
        rows = np.stack(points.to_numpy())
        return pd.Series(np.min([((rows - centre) ** 2).sum(axis=1) for centre in table], axis=0))

    even = (F.pmod(F.xxhash64(F.lit(seed), "id_client"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    far = batch.select("id_client", "features", squared(vector_to_array("features")).alias("weight"))
    drawn = (
        far.where("weight > 0")
        .orderBy(-F.ln(even) / F.col("weight"), "id_client")
        .limit(len(starved))
        .select("features")
        .collect()
    )
    moved, new_weights = [list(c) for c in centres], list(weights)
    least = min(w for i, w in enumerate(weights) if i not in starved)
    for i, row in zip(starved, drawn):
        moved[i], new_weights[i] = row["features"].toArray().tolist(), least
    return moved, new_weights


def centres_frame(spark, centres: Centres, weights: Sequence[float]) -> DataFrame:
    rows = [(i, [float(v) for v in c], float(w)) for i, (c, w) in enumerate(zip(centres, weights))]
    return spark.createDataFrame(rows, CENTRES_SCHEMA)


def centres_from_frame(frame: DataFrame) -> tuple[list[list[float]], list[float]]:
    rows = frame.orderBy("cluster").collect()
    return [list(r["center"]) for r in rows], [r["weight"] for r in rows]


def minibatch_kmeans(
    matrix: DataFrame, k: int = 4, batch_ids: int | None = None, seed: int = 0, batches: int = 10
) -> tuple[list[list[float]], list[float]]:
    """Incremental k-means over consecutive, half-open id ranges.

    ``matrix`` should be stored sorted by ``id_client``, so that a batch reads
    its own row groups only. ``batch_ids`` fixes the width of a range; without
    it the ids are cut into ``batches`` ranges, since each step is a job of its
    own and few large ones keep a cluster busy. First centres come from a
    seeded k-means on the first batch, or on more where that has under k rows.
    After each step, starved centres move to rows of the batch.
    """
    top = matrix.agg(F.max("id_client")).first()[0]
    require_rows(matrix, k)
    width = batch_ids or -(-(top + 1) // batches)
    first = width
    while first <= top and matrix.where(F.col("id_client") < first).limit(k).count() < k:
        first *= 2
    centres = kmeans_fit(matrix.where(F.col("id_client") < first), k, seed)
    weights = [0.0] * len(centres)
    for start in range(0, top + 1, width):
        batch = matrix.where((F.col("id_client") >= start) & (F.col("id_client") < start + width))
        centres, weights = minibatch_step(batch, centres, weights)
        centres, weights = reassign_starved(batch, centres, weights, seed + start)
    return centres, weights
