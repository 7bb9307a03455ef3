import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from segmill.operators import clustering, projection


def matrix_of(spark, points):
    rows = [(i, Vectors.dense(p)) for i, p in enumerate(points.tolist())]
    return spark.createDataFrame(rows, ["id_client", "features"])


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(0, 1, (120, 3)), rng.normal(8, 1, (70, 3)), rng.normal((0, 9, -9), 1, (50, 3))])


@pytest.fixture(scope="module")
def matrix(spark, points):
    return matrix_of(spark, points).persist()


def test_assignment_and_its_ties(spark, matrix, points):
    centres = [[0.0, 0.0, 0.0], [8.0, 8.0, 8.0], [0.0, 9.0, -9.0]]
    expected = ((points[:, None] - np.array(centres)[None]) ** 2).sum(-1).argmin(1)
    for partitions in (1, 5):
        found = clustering.assign_clusters(matrix.repartition(partitions), centres).toPandas().sort_values("id_client")
        assert found["cluster"].tolist() == expected.tolist()
    tie = clustering.assign_clusters(matrix_of(spark, np.array([[1.0]])), [[2.0], [0.0]])
    assert tie.first()["cluster"] == 0


def test_step_is_the_weighted_mean(matrix, points):
    centres, weights = [[0.0] * 3, [8.0] * 3], [10.0, 0.0]
    nearest = ((points[:, None] - np.array(centres)[None]) ** 2).sum(-1).argmin(1)
    new, grown = clustering.minibatch_step(matrix, centres, weights)
    for i in (0, 1):
        mine = points[nearest == i]
        assert new[i] == pytest.approx((np.array(centres[i]) * weights[i] + mine.sum(0)) / (weights[i] + len(mine)))
        assert grown[i] == weights[i] + len(mine)


def test_empty_batch_changes_nothing(matrix):
    state = [[1.0, 2.0, 3.0]], [4.0]
    assert clustering.minibatch_step(matrix.limit(0), *state) == ([[1.0, 2.0, 3.0]], [4.0])


def test_minibatch_sees_every_row_once(matrix, points):
    centres, weights = clustering.minibatch_kmeans(matrix, k=3, batches=4, seed=0)
    assert sum(weights) == len(points)
    assert clustering.minibatch_kmeans(matrix, k=3, batch_ids=60, seed=0)[1] == weights
    assert len(centres) == 3


def test_full_kmeans_numbers_by_size(matrix):
    labels = clustering.kmeans_fit_predict(matrix, k=3, seed=42).toPandas().sort_values("id_client")["cluster"]
    assert labels.tolist() == [0] * 120 + [1] * 70 + [2] * 50


def test_more_clusters_than_rows_are_refused(spark):
    two = matrix_of(spark, np.array([[0.0, 1.0], [5.0, 5.0]]))
    for fit in (clustering.kmeans_fit, clustering.kmeans_fit_predict, clustering.minibatch_kmeans):
        for rows in (two, two.limit(0)):
            with pytest.raises(ValueError):
                fit(rows, k=3)
    with pytest.raises(ValueError):
        clustering.kmeans_elbow(two, range(1, 4))
    assert sorted(clustering.kmeans_fit(two, k=2)) == [[0.0, 1.0], [5.0, 5.0]]
    assert clustering.kmeans_fit(two, k=1) == [[2.5, 3.0]]
    assert clustering.kmeans_elbow(two, range(1, 3)).toPandas()["inertia"].tolist() == [20.5, 0.0]


def test_first_centres_come_from_enough_rows(spark, points):
    centres, weights = clustering.minibatch_kmeans(matrix_of(spark, points[:10]), k=3, batch_ids=2)
    assert len(centres) == 3 and sum(weights) == 10


def test_elbow(matrix, points):
    curve = clustering.kmeans_elbow(matrix, range(1, 7)).toPandas()
    assert curve["k"].tolist() == list(range(1, 7))
    assert curve["inertia"][0] == pytest.approx(((points - points.mean(0)) ** 2).sum())
    assert all(b <= a * 1.05 for a, b in zip(curve["inertia"], curve["inertia"][1:]))


def test_pca(matrix, points):
    scores = projection.pca_2d(matrix).toPandas().sort_values("id_client")[["pc1", "pc2"]].to_numpy()
    _, _, axes = np.linalg.svd(points - points.mean(0), full_matrices=False)
    axes = axes[:2] * np.sign(axes[np.arange(2), abs(axes[:2]).argmax(1)])[:, None]
    assert np.allclose(scores, (points - points.mean(0)) @ axes.T)
    assert np.allclose(scores.mean(0), 0)


def test_covariance(matrix, points):
    found = {(r["i"], r["j"]): r["covariance"] for r in projection.feature_covariance(matrix).collect()}
    expected = np.cov(points.T, bias=True)
    assert len(found) == len(expected) * (len(expected) + 1) // 2
    assert all(found[i, j] == pytest.approx(expected[i, j]) for i, j in found)


def test_projection_of_an_empty_matrix(matrix):
    assert projection.feature_covariance(matrix.limit(0)).count() == 0
    assert projection.pca_2d(matrix.limit(0)).count() == 0


def test_models_fitted_together_equal_separate_fits(matrix):
    starts = clustering.starting_centres(matrix, range(1, 7), seed=1)
    together, scans = clustering.joint_kmeans(matrix, starts)
    needed = []
    for k in starts:
        alone, n = clustering.joint_kmeans(matrix, {k: starts[k]})
        needed.append(n)
        assert np.allclose(alone[k][0], together[k][0]) and alone[k][1] == pytest.approx(together[k][1])
    assert scans == max(needed) < sum(needed)


def test_joint_fit_is_a_fixed_point(matrix, points):
    found, _ = clustering.joint_kmeans(matrix, clustering.starting_centres(matrix, [4]))
    centres, inertia = found[4]
    squared = ((points[:, None] - centres[None]) ** 2).sum(-1)
    assert inertia == pytest.approx(squared.min(1).sum())
    for i, centre in enumerate(centres):
        assert np.allclose(points[squared.argmin(1) == i].mean(0), centre, atol=1e-5)


def test_joint_fit_takes_the_steps_of_whole_scans_in_fewer_scans(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(2000, 3))
    matrix = matrix_of(spark, rows)
    starts = clustering.starting_centres(matrix, [1, 5], seed=1)
    found, scans = clustering.joint_kmeans(matrix, starts)
    taken = []
    for k, centres in starts.items():
        moved, before = np.array(centres), None
        while before is None or np.abs(moved - before).max() > clustering.TOLERANCE:
            before = moved
            nearest = ((rows[:, None] - before[None]) ** 2).sum(-1).argmin(1)
            moved = np.stack([rows[nearest == i].mean(0) for i in range(k)])
            taken.append(k)
        assert np.allclose(found[k][0], moved, atol=1e-9)
        assert found[k][1] == pytest.approx(((rows[:, None] - moved[None]) ** 2).sum(-1).min(1).sum())
    assert scans < taken.count(5) / 1.5


def test_starved_centres_move_into_the_data(matrix, points):
    far = [points[0].tolist(), points[1].tolist(), points[2].tolist(), [1e6] * points.shape[1]]
    centres, weights = clustering.minibatch_step(matrix, far, [0.0] * 4)
    moved, new_weights = clustering.reassign_starved(matrix, centres, weights, seed=7)
    assert weights[3] == 0 and new_weights[3] == min(w for w in weights if w)
    assert any(np.allclose(moved[3], p) for p in points)
    assert moved == clustering.reassign_starved(matrix, centres, weights, seed=7)[0]
    _, used = clustering.minibatch_step(matrix, moved, [0.0] * 4)
    assert all(used)
    # none starved: nothing moves
    assert clustering.reassign_starved(matrix, centres, [5.0] * 4, seed=7) == (centres, [5.0] * 4)


def test_centres_survive_storage(spark, tmp_path):
    from segmill.sources.tables import load_centres, save_centres

    state = [[0.5, 1.5], [2.0, 3.0]], [4.0, 5.0]
    save_centres(clustering.centres_frame(spark, *state), str(tmp_path / "centres"))
    assert clustering.centres_from_frame(load_centres(spark, str(tmp_path / "centres"))) == state
