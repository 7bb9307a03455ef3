"""Principal components in the plane and the covariance under them, over the whole matrix."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_matrix(matrix: DataFrame, features: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums and the sums of products of all columns of a matrix, in one pass.

    A task adds up its rows' outer products batch by batch and hands on one vector per
    column, the upper triangle only; these are summed by an aggregate with map-side
    combining. What reaches the driver has the size of the covariance matrix.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for batch in batches:
            if not len(batch):
                continue
            # a column of ones gives the sums and the number of rows with the products
            rows = np.stack(batch["row"].to_numpy())
            rows = np.hstack([np.ones((len(rows), 1)), rows])
            total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            upper = [total[i, i:] for i in range(len(total))]
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "part": upper})

    parts = matrix.select(vector_to_array(features).alias("row")).mapInPandas(run, "i int, part array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    rows = sorted(sums.collect())
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    whole = np.zeros((len(rows), len(rows)))
    for row in rows:
        whole[row["i"], row["i"] :] = row["part"]
    whole = np.triu(whole) + np.triu(whole, 1).T
    return int(round(whole[0, 0])), whole[0, 1:], whole[1:, 1:]


def mean_and_covariance(matrix: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances of all columns."""
    n, sums, products = gram_matrix(matrix)
    mean = sums / max(n, 1)
    return mean, products / max(n, 1) - np.outer(mean, mean)


def feature_covariance(matrix: DataFrame) -> DataFrame:
    """Population covariances as rows ``i, j, covariance`` by position in the vector, each pair once."""
    _, found = mean_and_covariance(matrix)
    i, j = np.triu_indices(len(found))
    table = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "covariance": found[i, j]})
    return matrix.sparkSession.createDataFrame(table, "i int, j int, covariance double")


def directions(covariances: np.ndarray, k: int = 2) -> np.ndarray:
    """The first ``k`` principal directions as rows; the loading of largest magnitude is positive."""
    values, vectors = np.linalg.eigh(covariances)
    first = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    largest = np.take_along_axis(first, np.abs(first).argmax(axis=1, keepdims=True), axis=1)
    return first * np.where(largest < 0, -1.0, 1.0)


def pca_2d(matrix: DataFrame, *carry: str) -> DataFrame:
    """``id_client, pc1, pc2``: the centred rows along the first two directions.

    The directions are found on the driver from the covariances; the rows are read once for
    these and once for the scores.
    """
    mean, covariances = mean_and_covariance(matrix)
    first = directions(covariances) if len(mean) else np.zeros((2, 0))

    @F.pandas_udf("pc1 double, pc2 double")
    def scores(rows: pd.Series) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"pc1": [], "pc2": []}, dtype="float64")
        along = (np.stack(rows.to_numpy()) - mean) @ first.T
        return pd.DataFrame({f"pc{i + 1}": along[:, i] if i < along.shape[1] else 0.0 for i in range(2)})

    scored = matrix.select("id_client", *carry, scores(vector_to_array("features")).alias("s"))
    return scored.select("id_client", *carry, "s.pc1", "s.pc2")


def cluster_scatter(matrix_with_labels: DataFrame) -> DataFrame:
    """``id_client, pc1, pc2, label``: the table behind a scatter plot of clusters."""
    return pca_2d(matrix_with_labels, "label")
