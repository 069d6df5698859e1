"""Fusion of complete lists against one that reads every place."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_neighbours import LAYOUTS, frame

from rankwell.operators import fusion, lexical, neighbours
from rankwell.plans.retrieve import Retriever

QUESTIONS, ROWS = 12, 300


def lists_of(spark, seed, lengths, asked_for):
    """Made-up complete lists; ``asked_for`` notes what was read of them."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, length in lengths.items():
        rows = [
            (q, place + 1, int(d), 1.0 / (place + 1))
            for q in range(QUESTIONS)
            for place, d in enumerate(rng.permutation(ROWS)[:length])
        ]
        full = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, score double")

        def top(n, full=full, name=name):
            asked_for.append((name, n))
            return full.where(F.col("rank") <= n)

        def places(wanted, full=full):
            return full.join(wanted, ["query_id", "doc_id"]).select("query_id", "doc_id", "rank")

        out[name] = (full, fusion.Ranked(top, places))
    return out


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("lengths", [{"a": ROWS, "b": ROWS, "c": 150}, {"a": ROWS, "b": 2, "c": 9}])
@pytest.mark.parametrize("weights", [{}, {"a": 1.0, "b": 0.5, "c": 0.75}, {"a": 0.01, "b": 3.0, "c": 0.01}])
def test_tops_and_places_equal_whole_lists(spark, lengths, weights):
    asked_for = []
    lists = lists_of(spark, 4, lengths, asked_for)
    got = fusion.fuse_complete({n: r for n, (_, r) in lists.items()}, 6, weights)
    assert rows(got) == rows(fusion.fuse({n: full for n, (full, _) in lists.items()}, 6, weights))
    assert {n for _, n in asked_for} == {fusion.sufficient_depth([weights.get(n, 1.0) for n in "abc"], 6)}
    assert max(n for _, n in asked_for) < ROWS


def test_sufficient_depth_is_sufficient_and_tight():
    for weights in ([1.0], [1.0, 1.0], [1.0, 0.5, 0.75], [5.0, 0.1, 0.1]):
        for k in (1, 5, 100):
            depth = fusion.sufficient_depth(weights, k)
            ordered = sorted(weights)
            for upto in range(1, len(ordered) + 1):
                best = ordered[upto - 1] / (60 + k)
                assert sum(ordered[:upto]) / (61 + depth) < best
            worst = max(sum(ordered[:n]) / ordered[n - 1] for n in range(1, len(ordered) + 1))
            assert depth <= worst * (60 + k) * 1.001 - 59
    with pytest.raises(ValueError, match="rounding"):
        fusion.sufficient_depth([1e-9, 1.0], 5)


def test_weights(spark):
    lists = {n: r for n, (_, r) in lists_of(spark, 1, {"a": 20, "b": 20}, []).items()}
    only = fusion.fuse_complete(lists, 3, {"b": 0.0})
    assert rows(only) == rows(fusion.fuse({"a": lists["a"].top(20)}, 3))
    with pytest.raises(ValueError, match="negative"):
        fusion.fuse_complete(lists, 3, {"b": -1.0})


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("cosine", [True, False])
def test_vector_places_equal_the_whole_ranking(spark, layout, cosine):
    """With copies, a zero vector, and wanted documents outside the probed clusters."""
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(50, 4)).astype(np.float32)
    matrix[30:40], matrix[12] = matrix[5], 0.0
    corpus = frame(spark, matrix, clusters=np.arange(50) % 3).repartition(4)
    routed = (
        frame(spark, matrix, "query_id")
        .where("query_id < 20")
        .withColumn("cluster", F.explode(F.array(F.lit(0), F.lit(2))))
    )
    options = {"cosine": cosine, "exclude_self": True}
    full = neighbours.routed_topk(corpus, routed, 50, **options)
    pairs = [(q, d) for q in range(20) for d in range(50) if (q + d) % 4 == 0]
    wanted = spark.createDataFrame(pairs, "query_id long, doc_id long")
    got = neighbours.places(corpus, routed, wanted, **options, **LAYOUTS[layout])
    expected = full.join(wanted, ["query_id", "doc_id"])
    key = lambda r: (r.query_id, r.doc_id, r["rank"])
    assert sorted(map(key, got.collect())) == sorted(map(key, expected.collect()))
    assert neighbours.places(corpus, routed, wanted.limit(0), **options).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(80)]
    rows += [(80 + i, "w1 w2 w3") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_bm25_places_equal_the_whole_ranking(spark, texts, workspace, limit):
    index = lexical.build_index(texts, F.col("text"), workspace)
    asked = texts.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    weighted = lexical.weighted_terms(index, lexical.question_terms(asked, F.col("text"))).cache()
    full = lexical.best_documents(index, weighted, 1000)
    wanted = asked.select("query_id", F.explode(F.array(*[F.lit(i) for i in range(0, 90, 2)])).alias("doc_id"))
    wanted = wanted.withColumn("doc_id", F.col("doc_id").cast("long"))
    got = lexical.places(index, weighted, wanted, max_broadcast=limit)
    expected = full.join(wanted, ["query_id", "doc_id"])
    key = lambda r: (r.query_id, r.doc_id, r["rank"])
    assert sorted(map(key, got.collect())) == sorted(map(key, expected.collect()))


def test_bm25_places_are_counted_over_blocks_without_listing_matches(spark, texts, workspace, monkeypatch):
    index = lexical.build_index(texts, F.col("text"), workspace)
    asked = texts.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    weighted = lexical.weighted_terms(index, lexical.question_terms(asked, F.col("text"))).cache()
    full = lexical.ranking(lexical.score_matches(index, weighted), 1000).cache()
    wanted = asked.select("query_id", F.explode(F.array(*[F.lit(i) for i in range(1, 90, 3)])).alias("doc_id"))
    wanted = wanted.withColumn("doc_id", F.col("doc_id").cast("long"))
    expected = full.join(wanted, ["query_id", "doc_id"]).select("query_id", "doc_id", "rank")
    expected = sorted(map(tuple, expected.collect()))
    monkeypatch.setattr(lexical, "score_matches", None)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 10)  # several passes
    assert sorted(map(tuple, lexical.places(index, weighted, wanted).collect())) == expected
    assert lexical.places(index, weighted, wanted.limit(0)).count() == 0


def test_bm25_places_with_repeated_documents(spark, texts, workspace):
    """A repeated document earns twice its parts, beyond the bounds of its block."""
    twice = texts.unionAll(texts.where("doc_id % 5 = 0"))
    index = lexical.build_index(twice, F.col("text"), workspace)
    asked = texts.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    weighted = lexical.weighted_terms(index, lexical.question_terms(asked, F.col("text"))).cache()
    full = lexical.ranking(lexical.score_matches(index, weighted), 1000)
    wanted = full.where("rank % 4 = 1 and rank < 20").select("query_id", "doc_id", "rank").cache()
    got = lexical.places(index, weighted, wanted.select("query_id", "doc_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_retriever_fuses_complete_lists(spark, texts, workspace):
    index = lexical.build_index(texts, F.col("text"), workspace)
    vector = F.array((F.col("doc_id") % 7 + 1).cast("float"), (F.col("doc_id") % 5).cast("float"))
    corpus = texts.select("doc_id", vector.alias("vector"))
    asked = texts.where("doc_id < 6").select(F.col("doc_id").alias("query_id"), "text").join(
        corpus.withColumnRenamed("doc_id", "query_id"), "query_id"
    )
    retriever = Retriever(corpus=corpus, index=index, question_text=F.col("text"))
    whole = {m: retriever.ranked(m, asked).top(200) for m in ("bm25", "cosine")}
    assert rows(retriever.retrieve("rrf", asked, 4)) == rows(fusion.fuse(whole, 4))
    with pytest.raises(ValueError, match="unknown mode"):
        retriever.retrieve("other", asked, 4)
