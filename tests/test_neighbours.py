import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.functions import vectors
from rankwell.operators import clustering, neighbours

LAYOUTS = {
    "scan": {},
    "blocks": {"max_broadcast": 0, "block_rows": 7},
    "scans": {"max_broadcast": 6},
}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(60, 6)).astype(np.float32)
    matrix[40:50] = matrix[3]  # a sixth of the rows are copies of one vector
    matrix[11] = 0.0
    return matrix


def frame(spark, matrix, key="doc_id", clusters=None):
    clusters = [0] * len(matrix) if clusters is None else clusters
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(matrix, clusters))]
    return spark.createDataFrame(rows, f"{key} long, vector array<float>, cluster int")


def brute_force(matrix, k, cosine=True, exclude_self=True, allowed=None):
    matrix = matrix.astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    out = []
    for q in range(len(matrix)):
        if cosine and norms[q] == 0:
            continue
        scored = []
        for d in range(len(matrix)):
            if (exclude_self and d == q) or (cosine and norms[d] == 0):
                continue
            if allowed is not None and not allowed(q, d):
                continue
            s = float(matrix[q] @ matrix[d])
            scored.append((-round(s / (norms[q] * norms[d]) if cosine else s, 6), d))
        out += [(q, r, d, -s + 0.0) for r, (s, d) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("cosine", [True, False])
def test_exact_equals_brute_force(spark, points, layout, cosine):
    corpus = frame(spark, points).drop("cluster").repartition(4)
    asked = corpus.withColumnRenamed("doc_id", "query_id")
    got = neighbours.exact_topk(
        corpus, asked, 4, cosine=cosine, exclude_self=True, **LAYOUTS[layout]
    )
    assert rows(got) == brute_force(points, 4, cosine)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_routed_search_and_small_clusters(spark, points, layout):
    """Most rows share one cluster, one cluster has fewer than k rows: no padding."""
    clusters = np.zeros(60, int)
    clusters[:5], clusters[5:7] = 1, 2
    corpus = frame(spark, points, clusters=clusters)
    asked = frame(spark, points, "query_id").withColumn(
        "cluster", F.explode(F.array(F.lit(1), F.lit(2)))
    )
    got = neighbours.routed_topk(corpus, asked, 6, exclude_self=True, **LAYOUTS[layout])
    expected = brute_force(points, 6, allowed=lambda q, d: clusters[d] in (1, 2))
    assert rows(got) == expected
    per_cluster = neighbours.topk_per_cluster(corpus, asked, 6, **LAYOUTS[layout])
    assert per_cluster.where("cluster = 2").groupBy("query_id").count().agg(
        F.max("count")
    ).first()[0] == 2


def test_routing_to_all_clusters_is_exact_search(spark, points):
    corpus = frame(spark, points).drop("cluster").where("doc_id <> 11")
    asked = corpus.withColumnRenamed("doc_id", "query_id")
    labelled = frame(spark, points, "id", clusters=np.arange(60) % 4).where("id <> 11")
    centroids = clustering.Centroids.of(clustering.centroid_means(labelled))
    assigned = clustering.assign_nearest(corpus, centroids)
    routed = clustering.route(asked, centroids, 4)
    got = rows(neighbours.routed_topk(assigned, routed, 3))
    assert got == rows(neighbours.exact_topk(corpus, asked, 3))


def test_no_questions_or_no_corpus(spark, points):
    corpus = frame(spark, points).drop("cluster")
    asked = corpus.withColumnRenamed("doc_id", "query_id")
    assert neighbours.exact_topk(corpus, asked.limit(0), 3).count() == 0
    assert neighbours.exact_topk(corpus.limit(0), asked, 3).count() == 0


def test_dimensions_must_agree(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<float>")
    with pytest.raises(ValueError, match="dimensions 1 to 2"):
        neighbours.dimension(df)
    assert neighbours.dimension(df.limit(0).union(df.limit(1))) == 2


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>"
    )
    got = df.select(
        vectors.dot(F.col("a"), F.col("b")).alias("dot"),
        vectors.norm(F.col("a")).alias("norm"),
        vectors.cosine(F.col("a"), F.col("b")).alias("cos"),
        vectors.normalize(F.col("a")).alias("unit"),
        vectors.squared_distance(F.col("a"), F.col("b")).alias("d2"),
    ).collect()
    assert (got[0]["dot"], got[0]["norm"], got[0]["cos"], got[0]["d2"]) == (24.0, 5.0, 0.96, 2.0)
    assert got[0]["unit"] == pytest.approx([0.6, 0.8])
    assert got[1]["cos"] is None and got[1]["unit"] is None


def test_cluster_index_is_pruned(spark, points, workspace):
    """Only the probed cluster folders are read."""
    corpus = frame(spark, points, clusters=np.arange(60) % 5)
    stored = clustering.write_by_cluster(corpus, "doc_id", workspace, "by_cluster", 4)
    asked = frame(spark, points, "query_id", clusters=[2] * 60)
    found = neighbours.search(stored, asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan and "cluster#" in plan
    assert {r.cluster for r in found.select("cluster").distinct().collect()} == {2}


def test_a_batch_of_documents_sorts_each_question_once(monkeypatch):
    """Many questions and a deep list: the rows held are not sorted for every few documents."""
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(3000, 4))
    asked = neighbours.Asked(np.arange(3000), matrix)
    entries = []
    keep_best = neighbours.keep_best
    monkeypatch.setattr(
        neighbours, "keep_best", lambda q, d, s, k: entries.append(len(q)) or keep_best(q, d, s, k)
    )
    best = neighbours.BestRows(asked, 40, exclude_self=True)
    best.add(np.arange(3000), matrix)
    assert sum(entries) < 1.5 * 3000 * 40
    assert best.rows(0).num_rows == 3000 * 40


def test_places_count_ties_by_id_in_any_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    docs, asked = np.round(rng.normal(size=(50, 2))), np.round(rng.normal(size=(7, 2)))
    ids = rng.permutation(50)
    scores = np.round(asked @ docs.T, 6) + 0.0
    wanted = [list(rng.permutation(50)[: 3 * q]) for q in range(7)]
    expected = sorted(
        (100 + q, int(ids[j]), sum((-scores[q, x], ids[x]) < (-scores[q, j], ids[j]) for x in range(50)))
        for q, some in enumerate(wanted)
        for j in some
    )
    for cells in (1, 60, 1_000_000):
        monkeypatch.setattr(neighbours, "_CELLS", cells)
        lists = [[int(ids[j]) for j in some] for some in wanted], [[scores[q, j] for j in some] for q, some in enumerate(wanted)]
        found = neighbours.Places(neighbours.Asked(100 + np.arange(7), asked, None, *lists), 0, False)
        found.add(ids[:20], docs[:20])
        found.add(ids[20:], docs[20:])
        got = found.rows(0).to_pydict()
        assert sorted(zip(got["query_id"], got["doc_id"], got["better"])) == expected


def test_products_in_single_precision_lose_nothing():
    """Copies, near ties below single precision, huge and broken vectors: as in double."""
    rng = np.random.default_rng(8)
    docs = rng.normal(size=(900, 24))
    docs[100:500] = docs[7]  # a flood of copies
    docs[500:560] = docs[7] + rng.normal(size=(60, 24)) * 1e-7
    asked = np.concatenate([rng.normal(size=(20, 24)), docs[[7, 100, 510]]])
    single = []
    for scale, broken in ((1.0, False), (1e-3, False), (1e25, False), (1.0, True)):
        matrix = docs * scale
        if broken:
            matrix[3, 2] = np.nan
        best = neighbours.BestRows(neighbours.Asked(np.arange(len(asked)), asked), 6, True)
        for at in range(0, 900, 300):
            part = matrix[at : at + 300]
            single.append((best._room(part) < neighbours._MAX_ROOM).all())
            best.add(np.arange(at, at + 300), part)
        scores = np.round(asked @ matrix.T, 6) + 0.0
        for q in range(len(asked)):
            order = [d for d in np.lexsort((np.arange(900), -scores[q])) if d != q and not np.isnan(scores[q, d])][:6]
            if not broken:
                assert np.allclose(best.score[q], scores[q, order], rtol=1e-12, atol=2e-6)
            if scale == 1.0 and not broken:
                assert best.doc[q].tolist() == order
    assert single == [True] * 6 + [False] * 4 + [True] * 2
