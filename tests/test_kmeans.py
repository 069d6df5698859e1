import numpy as np
import pytest
from pyspark.sql import functions as F
from test_clustering import frame
from test_silhouette import groups

from rankwell.operators import clustering, kmeans


def brute_seeds(matrix, k):
    seeds = [matrix[0]]
    while len(seeds) < k:
        d2 = np.round(((matrix[:, None] - np.array(seeds)[None]) ** 2).sum(-1), 6).min(axis=1)
        seeds.append(matrix[d2.argmax()])
    return np.array(seeds)


def brute_fit(matrix, seeds, max_iter=300):
    centers, costs = seeds.copy(), []
    for _ in range(max_iter):
        d2 = np.round(((matrix[:, None] - centers[None]) ** 2).sum(-1), 6)
        nearest = d2.argmin(axis=1)
        costs.append(((matrix - centers[nearest]) ** 2).sum())
        after = np.array(
            [
                np.round(matrix[nearest == c].mean(axis=0), 9) if (nearest == c).any() else centers[c]
                for c in range(len(centers))
            ]
        )
        if np.array_equal(after, centers):
            break
        centers = after
    return centers, costs


@pytest.mark.parametrize("apart", [0.0, 0.7, 8.0])
def test_fit_equals_plain_rounds(spark, apart):
    matrix, _ = groups(400, 9, apart)
    df = frame(spark, matrix).select("id", "vector")
    points = matrix.astype(np.float64)
    seeds = kmeans.farthest_first(df, 5)
    assert np.array_equal(seeds, brute_seeds(points, 5))
    fit = kmeans.lloyd(df, seeds)
    centers, costs = brute_fit(points, seeds)
    assert np.allclose(fit.centers, centers, atol=2e-9)
    assert [r.inertia for r in fit.rounds] == pytest.approx(costs, rel=1e-9)
    assert fit.rounds[-1].moved == 0.0


def test_rows_that_cannot_change_are_not_measured(spark):
    matrix, _ = groups(600, 4, 0.7)
    df = frame(spark, matrix).select("id", "vector")
    rounds = kmeans.fit(df, 5).rounds
    assert len(rounds) > 6 and rounds[0].measured == 600
    assert min(r.measured for r in rounds[4:]) < 200


def test_the_layout_of_the_rows_leaves_no_trace(spark):
    matrix, _ = groups(200, 2, 1.0)
    df = frame(spark, matrix).select("id", "vector")
    fits = [kmeans.fit(d, 4) for d in (df.repartition(1), df.repartition(7, "id"))]
    assert np.allclose(fits[0].centers, fits[1].centers, atol=2e-9)
    assert len(fits[0].rounds) == len(fits[1].rounds)


def test_tolerance_and_limit_end_a_fit(spark):
    matrix, _ = groups(300, 4, 0.3)
    df = frame(spark, matrix).select("id", "vector")
    whole = kmeans.fit(df, 4)
    assert len(kmeans.fit(df, 4, max_iter=2).rounds) == 2
    early = kmeans.fit(df, 4, tolerance=0.1)
    assert len(early.rounds) < len(whole.rounds) and early.rounds[-1].moved <= 0.1


def test_ties_copies_nulls_and_few_vectors(spark):
    rows = [(4, [0.0, 2.0]), (1, [0.0, 0.0]), (3, [2.0, 0.0]), (2, [0.0, 0.0]), (9, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    assert kmeans.farthest_first(df, 2).tolist() == [[0.0, 0.0], [2.0, 0.0]]  # the smaller id
    fit = kmeans.fit(df, 7)  # three different vectors
    assert sorted(fit.centers.tolist()) == [[0.0, 0.0], [0.0, 2.0], [2.0, 0.0]]
    assert fit.rounds[-1].inertia == pytest.approx(0.0)
    # A center without rows stays: the row in the middle goes to the smaller number.
    far = kmeans.lloyd(df, np.array([[0.0, 0.0], [50.0, 50.0]]))
    assert far.centers[1].tolist() == [50.0, 50.0]
    assert kmeans.fit(df, 1).centers.tolist() == [[0.5, 0.5]]
    with pytest.raises(ValueError, match="no row has a vector"):
        kmeans.fit(df.where("id = 9"), 2)


def test_assignment_follows_the_fit(spark):
    matrix, _ = groups(150, 6, 6.0)
    df = frame(spark, matrix).select("id", "vector")
    fit = kmeans.fit(df, 6)
    cost = clustering.inertia(df, clustering.Centroids.of_fit(fit)).first()["inertia"]
    assert cost == pytest.approx(fit.rounds[-1].inertia, abs=1e-3)
    seen = fit.history(spark)
    assert seen.count() == len(fit.rounds) and seen.agg(F.min("round")).first()[0] == 1


def test_fits_made_in_the_same_scans_equal_those_made_alone(spark, monkeypatch):
    matrix, _ = groups(500, 5, 0.7)
    df = frame(spark, matrix).select("id", "vector").repartition(3, "id")
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 37)
    seeds = kmeans.farthest_first(df, 5)
    alone = [kmeans.lloyd(df, seeds[:k]) for k in (2, 3, 5)]
    scans = []
    plain = kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda *given: scans.append(1) or plain(*given))
    together = kmeans.lloyd_all(df, [seeds[:k] for k in (2, 3, 5)])
    assert len(scans) == max(len(f.rounds) for f in alone)
    for one, other in zip(alone, together):
        assert np.allclose(one.centers, other.centers, atol=2e-9)
        assert [r.measured for r in one.rounds] == [r.measured for r in other.rounds]
        assert [r.inertia for r in one.rounds] == pytest.approx([r.inertia for r in other.rounds], rel=1e-9)
    assert kmeans.lloyd_all(df, [seeds], max_iter=0)[0].rounds == []
