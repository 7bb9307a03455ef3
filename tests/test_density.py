import numpy as np
import pandas as pd
import pytest

from segmill.operators import density


def brute_force(points, eps, min_points, min_cluster_size):
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_points
    label, seen = np.full(len(points), -1), np.zeros(len(points), bool)
    clusters = []
    for start in np.flatnonzero(core):
        if seen[start]:
            continue
        seen[start], open_points, members = True, [start], []
        while open_points:
            point = open_points.pop()
            members.append(point)
            for other in np.flatnonzero(near[point] & core & ~seen):
                seen[other] = True
                open_points.append(other)
        clusters.append(members)
    for i, members in enumerate(clusters):
        if len(members) >= min_cluster_size:
            label[members] = i
    return near.sum(1), label


def sample_points(seed):
    rng = np.random.default_rng(seed)
    return np.concatenate(
        [
            rng.normal((0, 0), 0.5, (300, 2)),
            rng.normal((4, 1), 0.3, (200, 2)),
            rng.uniform(-3, 7, (200, 2)),
            np.stack([np.linspace(-3, 7, 200), np.full(200, -4.0)], 1),
            # a third of all points: exact copies and a tight crowd around them
            np.tile([[2.0, 5.0]], (300, 1)),
            rng.normal((2.0, 5.0), 0.02, (200, 2)),
        ]
    )


def frame(spark, points):
    table = pd.DataFrame({"id_client": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1]})
    return spark.createDataFrame(table).repartition(8)


@pytest.mark.parametrize("eps, min_points", [(0.25, 10), (0.1, 5)])
def test_equals_brute_force(spark, eps, min_points):
    points = sample_points(0)
    counts, expected = brute_force(points, eps, min_points, 10)
    core = density.density_core_points(frame(spark, points), eps, min_points).toPandas().sort_values("id_client")
    assert (core["is_core"].to_numpy() == (counts >= min_points)).all()

    found = density.density_clusters(frame(spark, points), eps, min_points, 10).toPandas().sort_values("id_client")
    label = found["label"].to_numpy()
    pairs = set(zip(label, expected))
    assert len(pairs) == len(set(label)) == len(set(expected)) > 3
    assert (-1, -1) in pairs
    sizes = np.bincount(label[label >= 0])
    assert (np.diff(sizes) <= 0).all()


def test_slices_of_a_hot_cell(spark):
    points = sample_points(3)
    for min_points in (505, 600):
        counts, _ = brute_force(points, 0.1, min_points, 10)
        core = density.density_core_points(frame(spark, points), 0.1, min_points, slice_points=7)
        core = core.toPandas().sort_values("id_client")
        assert (core["is_core"].to_numpy() == (counts >= min_points)).all()


def test_pairs_settled_by_splitting_alone(spark, monkeypatch):
    monkeypatch.setattr(density, "COMPARED", 16)
    points = sample_points(2)
    _, expected = brute_force(points, 0.25, 10, 10)
    found = density.density_clusters(frame(spark, points), 0.25, 10, 10).toPandas().sort_values("id_client")
    pairs = set(zip(found["label"], expected))
    assert len(pairs) == found["label"].nunique() == len(set(expected)) > 3


def test_groups_very_far_apart_stay_apart(spark):
    eps = 1e-3
    far = 2**32 * eps / np.sqrt(2)
    points = np.concatenate([np.zeros((20, 2)), np.full((21, 2), (far, 0.0))])
    found = density.density_clusters(frame(spark, points), eps, 5, 5).toPandas().sort_values("id_client")
    assert found["label"].tolist() == [1] * 20 + [0] * 21


def test_neighbouring_numbers_in_one_box(spark):
    eps, x = 1.393, 2_086_666.0
    rng = np.random.default_rng(4)
    for shift in (eps, eps / np.sqrt(2)):
        near = [[np.nextafter(x, x + 1), 0.0], [x, 0.0], [x - shift, 0.0], [x + shift, float(rng.random())]]
        points = np.array(near)
        _, expected = brute_force(points, eps, 1, 1)
        found = density.density_clusters(frame(spark, points), eps, 1, 1).toPandas().sort_values("id_client")
        assert len(set(zip(found["label"], expected))) == len(set(expected)) == found["label"].nunique()


def test_no_radius_fits(spark):
    with pytest.raises(ValueError):
        density.suggest_eps(frame(spark, np.array([[0.0, 0.0], [1.0, 1.0]])), 10)
    copies = frame(spark, np.tile([[3.0, 3.0]], (30, 1)))
    assert 0 < density.suggest_eps(copies, 10) < 1e-14
    outlier = frame(spark, np.concatenate([sample_points(1) / 1e6, [[1e6, 1e6]]]))
    assert density.suggest_eps(outlier, 10, 0.5) < 1e-5


def test_blobs_and_outliers(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate(
        [rng.normal((0, 0), 0.1, (60, 2)), rng.normal((9, 9), 0.1, (40, 2)), [[5, 0], [0, 5], [-7, 3]]]
    )
    found = density.density_clusters(frame(spark, points), 0.5, 5, 10).toPandas().sort_values("id_client")
    assert found["label"].tolist() == [0] * 60 + [1] * 40 + [-1] * 3
    shares = density.density_noise_share(spark.createDataFrame(found)).toPandas().set_index("label")
    assert shares["n_points"].to_dict() == {0: 60, 1: 40, -1: 3}


def test_no_core_points(spark):
    points = np.array([[0.0, 0.0], [10.0, 10.0]])
    found = density.density_clusters(frame(spark, points), 1.0, 5, 10).collect()
    assert [r["label"] for r in found] == [-1, -1]


def test_suggested_radius_follows_the_share(spark):
    points = frame(spark, sample_points(1))
    small, large = density.suggest_eps(points, 10, 0.2), density.suggest_eps(points, 10, 0.95)
    assert 0 < small < large


@pytest.mark.parametrize("eps, compared", [(0.25, 4096), (0.1, 16), (1.0, 16), (3.0, 64)])
def test_neighbour_counts_are_exact(spark, monkeypatch, eps, compared):
    monkeypatch.setattr(density, "COMPARED", compared)
    points = sample_points(1)
    counts, _ = brute_force(points, eps, 10, 10)
    found = density.density_neighbours(frame(spark, points), eps, 10).toPandas().sort_values("id_client")
    assert found["neighbours"].tolist() == counts.tolist()
    assert (found["is_core"].to_numpy() == (counts >= 10)).all()


@pytest.mark.parametrize("k, slice_points", [(1, 10_000), (10, 20), (301, 10_000), (2000, 10_000)])
def test_k_distances_are_exact(spark, k, slice_points):
    points = sample_points(2)
    squared = ((points[:, None] - points[None]) ** 2).sum(-1)
    found = density.k_distances(frame(spark, points), k, slice_points).toPandas().sort_values("id_client")
    if k > len(points):
        assert found["k_distance"].isna().all()
    else:
        want = np.sqrt(np.sort(squared, axis=1)[:, k - 1])
        assert np.allclose(found["k_distance"].to_numpy(), want, rtol=1e-12, atol=0)


def test_radius_by_k_distance(spark):
    points = sample_points(3)
    eps = density.eps_by_k_distance(frame(spark, points), 10, 0.8)
    counts, _ = brute_force(points, eps, 10, 10)
    assert abs((counts >= 10).mean() - 0.8) < 0.01
    with pytest.raises(ValueError, match="no radius"):
        density.eps_by_k_distance(frame(spark, points[:5]), 10)
