import numpy as np
import pytest
from test_clustering import frame, silhouettes

from rankwell.operators import clustering, silhouette

PATHS = [{}, {"max_broadcast": 0, "block_rows": 25}]


def groups(n, seed, apart, k=6, dim=8):
    rng = np.random.default_rng(seed)
    clusters = rng.integers(0, k, n)
    centers = rng.normal(size=(k, dim)) * apart
    return (centers[clusters] + rng.normal(size=(n, dim))).astype(np.float32), clusters


def known(spark, matrix, clusters):
    df = frame(spark, matrix, clusters)
    means = clustering.Centroids.of(clustering.centroid_means(df))
    return silhouette.moments(df, means.clusters, means.matrix)


@pytest.mark.parametrize("apart", [0.0, 1.0, 10.0])
@pytest.mark.parametrize("covariances", [True, False])
def test_bounds_hold_and_close_in_on_the_mean(spark, monkeypatch, apart, covariances):
    if not covariances:
        monkeypatch.setattr(silhouette, "MAX_MOMENT_BYTES", 0)
    matrix, clusters = groups(300, 3, apart)
    found = known(spark, matrix, clusters)
    assert (found.covariance is not None) == covariances
    points = matrix.astype(np.float64)
    lower, upper = found.bounds(points)
    distance = np.linalg.norm(points[:, None] - points[None], axis=-1)
    mean = np.stack([distance[:, clusters == c].mean(axis=1) for c in found.clusters], axis=1)
    assert (lower <= mean).all() and (mean <= upper).all()
    if covariances and apart == 10.0:
        assert ((upper - lower) / mean).mean() < 0.05


@pytest.mark.parametrize("options", PATHS)
@pytest.mark.parametrize("apart", [0.3, 4.0])
def test_values_are_those_of_all_pairs(spark, apart, options):
    matrix, clusters = groups(160, 5, apart)
    clusters[7] = 9  # alone
    matrix[20:40] = matrix[0]  # copies, over several clusters
    got = clustering.silhouette_rows(frame(spark, matrix, clusters), **options).collect()
    assert {r.id: pytest.approx(r.silhouette, abs=1e-6) for r in got} == silhouettes(matrix, clusters)


@pytest.mark.parametrize("options", PATHS)
def test_far_clusters_are_not_compared(spark, options):
    matrix, clusters = groups(240, 11, 10.0)
    parts = clustering.silhouette_parts(frame(spark, matrix, clusters), **options).toPandas()
    sizes = np.bincount(clusters)
    assert (parts["compared"] >= sizes[parts["cluster"]]).all()
    assert parts["compared"].mean() < 0.5 * len(matrix)


def test_both_paths_compare_the_same_rows(spark):
    df = frame(spark, *groups(150, 1, 1.0))
    few, blocks = (
        clustering.silhouette_parts(df, **options).orderBy("id").toPandas() for options in PATHS
    )
    assert few["compared"].tolist() == blocks["compared"].tolist()
    assert np.allclose(few[["a", "b"]], blocks[["a", "b"]], atol=1e-9)


@pytest.mark.parametrize("options", PATHS)
def test_one_cluster_equal_rows_and_nulls(spark, options):
    df = frame(spark, np.ones((4, 2), np.float32), np.zeros(4, int))
    got = clustering.silhouette_rows(df, **options).collect()
    assert [r.silhouette for r in got] == [0.0] * 4
    both = df.selectExpr("id", "vector", "cast(id % 2 as int) as cluster")
    assert [r.silhouette for r in clustering.silhouette_rows(both, **options).collect()] == [0.0] * 4
    bare = df.selectExpr(
        "id", "if(id = 0, null, vector) as vector", "if(id = 1, null, cluster) as cluster"
    )
    assert {r.id for r in clustering.silhouette_rows(bare, **options).collect()} == {2, 3}
    empty = clustering.silhouette_rows(df.where("id < 0"), **options)
    assert empty.columns == ["id", "cluster", "silhouette"] and empty.count() == 0
