import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import clustering


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    centers = np.array([[0, 0, 0], [6, 0, 0], [0, 7, 0]])
    return (centers[np.arange(45) % 3] + rng.normal(size=(45, 3))).astype(np.float32)


def frame(spark, matrix, clusters=None):
    clusters = np.arange(len(matrix)) % 3 if clusters is None else clusters
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(matrix, clusters))]
    return spark.createDataFrame(rows, "id long, vector array<float>, cluster int")


def silhouettes(matrix, clusters):
    matrix = matrix.astype(np.float64)
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(-1))
    out = {}
    for i, c in enumerate(clusters):
        own = clusters == c
        if own.sum() == 1:
            out[i] = 0.0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, clusters == o].mean() for o in set(clusters) - {c})
        out[i] = (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0, "block_rows": 10}])
def test_silhouette_equals_definition(spark, points, options):
    clusters = np.r_[np.arange(44) % 3, 3]  # the last row is alone
    got = clustering.silhouette_rows(frame(spark, points, clusters), **options).collect()
    expected = silhouettes(points, clusters)
    assert {r.id: pytest.approx(r.silhouette, abs=1e-6) for r in got} == expected


def test_lloyd_steps_never_raise_inertia(spark, points):
    df = frame(spark, points, np.arange(45) % 4)
    centroids = clustering.Centroids.of(clustering.centroid_means(df))
    costs = []
    for _ in range(4):
        costs.append(clustering.inertia(df, centroids).first()["inertia"])
        centroids = clustering.Centroids.of(clustering.lloyd_step(df, centroids))
    assert costs == sorted(costs, reverse=True) and costs[0] > costs[-1]


def test_kmeans_ignores_the_input_layout(spark, points):
    df = frame(spark, points).select("id", "vector")
    fits = [
        clustering.fit_kmeans(layout, 3).clusterCenters()
        for layout in (df.repartition(1), df.repartition(5), df.orderBy(F.desc("id")))
    ]
    for other in fits[1:]:
        assert np.array_equal(fits[0], other)


def test_sweep_finds_the_three_groups(spark, points):
    table = clustering.sweep_k(frame(spark, points).select("id", "vector"), range(2, 5))
    assert [r.k for r in table.where("best").collect()] == [3]
    assert table.count() == 3


def test_nearest_breaks_ties_by_cluster(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, vector array<float>")
    centroids = clustering.Centroids(
        np.array([0, 1, 2], np.int32), np.array([[2.0, 0], [1.0, 0], [0, 1.0]])
    )
    got = clustering.route(df, centroids, 2).orderBy("route_rank").collect()
    assert [(r.route_rank, r.cluster, r.d2) for r in got] == [(1, 1, 1.0), (2, 2, 1.0)]
    with pytest.raises(ValueError, match="asked for 4 clusters"):
        clustering.route(df, centroids, 4)


def test_sizes(spark, points):
    got = clustering.cluster_sizes(frame(spark, points[:4], [0, 0, 0, 5])).collect()
    assert {(r.cluster, r.n, r.share) for r in got} == {(0, 3, 0.75), (5, 1, 0.25)}


def test_assignment_and_cost_agree_with_the_fitted_model(spark, points):
    df = frame(spark, points).select("id", "vector")
    model = clustering.fit_kmeans(df, 3)
    centroids = clustering.Centroids.of_model(model)
    assigned = {r.id: r.cluster for r in clustering.assign_nearest(df, centroids).collect()}
    gaps = ((points[:, None].astype(float) - centroids.matrix[None]) ** 2).sum(-1)
    assert assigned == dict(enumerate(gaps.argmin(axis=1)))
    cost = clustering.inertia(df, centroids).first()["inertia"]
    assert cost == pytest.approx(model.summary.trainingCost, rel=1e-6)
    assert cost == pytest.approx(gaps.min(axis=1).sum(), abs=1e-3)


def test_projection_keeps_the_largest_spread(spark, points):
    flat = points.copy()
    flat[:, 2] = 0.0  # the rows lie in a plane: nothing is lost
    got = clustering.project_2d(frame(spark, flat)).orderBy("id").collect()
    plane = np.array([[r.x, r.y] for r in got])
    distance = lambda m: np.linalg.norm(m[:, None] - m[None], axis=-1)
    assert np.allclose(distance(plane), distance(flat.astype(float)), atol=1e-5)


def test_axes_are_those_of_the_eigen_decomposition(spark, points):
    matrix = points.astype(np.float64)
    axes, shares = clustering.principal_axes(frame(spark, points))
    values, vectors = np.linalg.eigh(np.cov(matrix.T))
    expected = vectors[:, ::-1][:, :2]
    expected = expected * np.sign(expected[np.abs(expected).argmax(axis=0), [0, 1]])
    assert np.allclose(axes, expected, atol=1e-6)
    assert np.allclose(shares, values[::-1][:2] / values.sum(), atol=1e-9)
    got = clustering.project_2d(frame(spark, points)).orderBy("id").collect()
    assert np.allclose([[r.x, r.y] for r in got], matrix @ expected, atol=1e-5)
    mirrored = clustering.principal_axes(frame(spark, -points))[0]
    assert np.allclose(mirrored, axes, atol=1e-6)
