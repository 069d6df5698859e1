"""Search by rings: the rows of the plain search, and fewer rows read."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_neighbours import brute_force, frame, rows

from rankwell.operators import clustering, neighbours, rings


@pytest.fixture(scope="module")
def groups():
    """Four far groups, one with half of all rows, copies in it and one zero vector."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(4, 5)) * 4
    label = np.r_[np.zeros(60, int), rng.integers(1, 4, 60)]
    matrix = (centers[label] + rng.normal(size=(120, 5)) * 0.3).astype(np.float32)
    matrix[20:35] = matrix[3]
    matrix[70] = 0.0
    return matrix, label


def index_of(spark, workspace, groups, cosine, ring_rows=10):
    matrix, label = groups
    corpus = frame(spark, matrix, clusters=label).repartition(3)
    points = clustering.unit_vectors(corpus) if cosine else corpus
    centroids = clustering.Centroids.of(clustering.centroid_means(points))
    return rings.build_rings(corpus.drop("cluster"), centroids, workspace, "rings", cosine, ring_rows)


@pytest.mark.parametrize("cosine", [True, False])
def test_rings_equal_brute_force_and_read_less(spark, workspace, groups, cosine):
    index = index_of(spark, workspace, groups, cosine)
    asked = frame(spark, groups[0], "query_id").drop("cluster")
    found = rings.ring_topk(index, asked, 4, exclude_self=True)
    assert rows(found.hits) == brute_force(groups[0], 4, cosine)
    read = found.compared.agg(F.sum("compared")).first()[0]
    assert read < 0.7 * len(groups[0]) ** 2
    # The large cluster is cut, and no ring lies across two clusters.
    assert len(index.rings) > 8 and (index.near <= index.far).all()


def test_bounds_hold_for_every_row(spark, workspace, groups):
    for cosine in (True, False):
        index = index_of(spark, workspace.child(str(cosine)), groups, cosine, 7)
        matrix = groups[0].astype(float)
        unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-30)[:, None]
        points = unit if cosine else matrix
        bounds = index.bounds(points)
        place = {int(r): i for i, r in enumerate(index.rings)}
        for row in index.rows.select("doc_id", "cluster").collect():
            scores = points @ points[row.doc_id]
            assert (scores <= bounds[:, place[row.cluster]]).all()


def test_more_results_than_rows_and_empty_sides(spark, workspace, groups):
    index = index_of(spark, workspace, groups, True)
    asked = frame(spark, groups[0], "query_id").drop("cluster")
    few = asked.where("query_id < 3")
    got = rings.ring_topk(index, few, 500).hits
    corpus = frame(spark, groups[0]).drop("cluster")
    assert rows(got) == rows(neighbours.exact_topk(corpus, few, 500))
    assert rings.ring_topk(index, asked.limit(0), 3).hits.count() == 0
    nothing = frame(spark, groups[0]).drop("cluster").limit(0)
    centroids = clustering.Centroids(np.array([0], np.int32), np.zeros((1, 5)))
    empty = rings.build_rings(nothing, centroids, workspace, "none")
    assert rings.ring_topk(empty, few, 3).hits.count() == 0


def test_floor_and_files(spark, workspace, groups):
    """Rows below a floor stay in their task; a ring outside the routes is not read."""
    index = index_of(spark, workspace, groups, True)
    asked = frame(spark, groups[0], "query_id").where("query_id = 1").drop("cluster")
    routed = asked.withColumn("cluster", F.lit(int(index.rings[0])))
    scores = sorted(r.score for r in neighbours.search(index.rows, routed, 50).collect())
    floor = scores[len(scores) // 2]
    found = neighbours.search(index.rows, routed.withColumn("floor", F.lit(floor)), 50)
    assert sorted(r.score for r in found.collect()) == [s for s in scores if s >= floor]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan and "Coalesce" not in plan


def test_questions_that_go_to_every_ring_leave_in_small_batches(spark, workspace, monkeypatch):
    """Nothing is ruled out here: each vector leaves once a ring, some at a time."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    corpus = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    centers = clustering.Centroids(np.array([0], np.int32), np.zeros((1, 8)))
    index = rings.build_rings(corpus, centers, workspace, "many", False, 10)
    monkeypatch.setattr(rings, "SENT_BYTES", 1024)  # 16 vectors of 8 numbers
    parts = list(rings._sent(np.ones((20, 5), bool), 8))
    assert max(len(at) for at, _ in parts) == 16 and sum(len(at) for at, _ in parts) == 100
    asked = corpus.withColumnRenamed("doc_id", "query_id").withColumn("floor", F.lit(float("-inf")))
    sent = rings._routes(index, asked, 1, rest=True)
    assert sent.count() == 300 * (len(index.rings) - 1)
    found = rings.ring_topk(index, asked.drop("floor"), 3, exclude_self=True).hits
    want = neighbours.exact_topk(corpus, asked.drop("floor"), 3, cosine=False, exclude_self=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
