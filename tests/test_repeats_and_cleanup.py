"""Repeated keys, fusion without fillers, null vectors, and tables that go after use."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from rankwell.operators import lexical, rows
from rankwell.operators.clustering import Centroids, assign_nearest, route
from rankwell.operators.joins import scratch, settle
from rankwell.plans.retrieve import Retriever
from rankwell.sources import tables
from rankwell.sources.workspace import fingerprint, shared_root


def test_first_row_of_repeated_keys(spark):
    given = [("b", "q1"), ("a", "q1"), ("a", "q1"), ("c", "q2"), ("c", "q3"), ("d", "q3")]
    df = spark.createDataFrame(given, "id string, question string").repartition(4)
    got = sorted(tuple(r) for r in rows.dedup_first(df, "question", "id").collect())
    assert got == [("a", "q1"), ("c", "q2"), ("c", "q3")]


def test_a_null_key_keeps_its_first_row(spark):
    given = [(3, None, "x"), (1, None, "y"), (1, None, "w"), (2, "", "z"), (None, "q", "n"), (5, "q", "m"), (None, "r", "only")]
    wanted = None
    for parts in (1, 5):
        df = spark.createDataFrame(given, "id long, question string, other string").repartition(parts)
        got = {tuple(r) for r in rows.dedup_first(df, "question", "id").collect()}
        assert {r[:2] for r in got} == {(1, None), (2, ""), (5, "q"), (None, "r")}
        assert wanted in (None, got)
        wanted = got


def test_append_and_upsert_take_the_first_of_repeats_and_know_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 9), (1, "y", 2), (None, "n", 4), (None, "m", 3)], "id long, text string, place int")
    path = str(tmp_path / "t")
    for _ in range(3):
        tables.append_new_rows(spark, df.repartition(4), path, "id", order="place")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "y", 2), (None, "m", 3)}
    vectors = spark.createDataFrame([(1, "m", [1.0], 2), (1, "m", [2.0], 1)], "original_id long, model string, embedding array<float>, place int")
    assert [r.embedding for r in tables.upsert_vectors(vectors.limit(0), vectors, "place").collect()] == [[2.0]]


def test_an_index_belongs_to_its_corpus(spark, workspace):
    one = spark.createDataFrame([(1, "apple pie"), (2, "apple")], "doc_id long, text string")
    two = spark.createDataFrame([(7, "pear"), (8, "pear tree"), (9, "tree")], "doc_id long, text string")
    first, second = (lexical.build_index(d, F.col("text"), workspace) for d in (one, two))
    assert (first.n_docs, second.n_docs) == (2, 3)
    assert {r.doc_id for r in second.documents.collect()} == {7, 8, 9}


def test_append_takes_one_of_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id long, text string")
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.append_new_rows(spark, df, path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_upsert_replaces_the_table(spark, tmp_path):
    schema = "original_id long, model string, embedding array<float>"
    path = str(tmp_path / "vectors")
    first = spark.createDataFrame([(1, "m", [1.0]), (1, "m", [1.0])], schema)
    second = spark.createDataFrame([(1, "m", [9.0]), (1, "n", [2.0]), (2, "m", [3.0])], schema)
    assert tables.write_upsert(spark, first, path).count() == 1
    got = {(r.original_id, r.model): r.embedding for r in tables.write_upsert(spark, second, path).collect()}
    assert got == {(1, "m"): [1.0], (1, "n"): [2.0], (2, "m"): [3.0]}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["vectors"]


def test_ids_of_pairs_sort_like_their_numbers(spark):
    turns = [(c, t, r, "x") for c in (99_999_999, 100_000_000) for t, r in ((0, "user"), (1, "assistant"))]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    ids = [r.id for r in tables.question_answer_pairs(talk).orderBy("id").collect()]
    assert [int(i.split("-")[0]) for i in ids] == [99_999_999, 100_000_000]


def test_fusion_gives_no_credit_to_fillers(spark, workspace):
    docs = spark.createDataFrame([(i, "apple pear" if i % 2 else "stone wall") for i in range(8)], "doc_id long, text string")
    index = lexical.build_index(docs, F.col("text"), workspace)
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "doc_id long, vector array<float>")
    asked = spark.createDataFrame([(1, "nothing known", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    retriever = Retriever(corpus=corpus, index=index, question_text=F.col("text"))
    fused = retriever.retrieve("rrf", asked, 3).orderBy("rank").collect()
    cosine = retriever.retrieve("cosine", asked, 3).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [r.doc_id for r in cosine]
    longer = retriever.retrieve("rrf", asked, 6).orderBy("rank").collect()
    assert [r.doc_id for r in longer[:3]] == [r.doc_id for r in fused]


def test_rows_without_vector_have_no_cluster(spark):
    centroids = Centroids(np.array([3, 5], np.int32), np.array([[0.0, 0.0], [2.0, 0.0]]))
    df = spark.createDataFrame([(1, [0.1, 0.0]), (2, None), (3, [1.0, 0.0])], "query_id long, vector array<float>")
    assert {r.query_id: r.cluster for r in assign_nearest(df, centroids).collect()} == {1: 3, 3: 3}
    assert route(df, centroids, 2).count() == 4


def test_settled_tables_go_with_their_scratch(spark):
    root = Path(shared_root(spark).removeprefix("file:"))
    count = lambda: len([p for p in root.rglob("settled-*") if p.is_dir()])
    before = count()
    for _ in range(3):
        with scratch(spark):
            assert settle(spark.range(5)).count() == 5
            assert count() == before + 1
    assert count() == before
    settle(spark.range(2))
    assert count() == before + 1


def test_fingerprints_tell_inputs_and_parameters_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    one = fingerprint(spark.read.parquet(path), 4)
    assert one == fingerprint(spark.read.parquet(path), 4) != fingerprint(spark.read.parquet(path), 5)
    spark.range(4).write.mode("overwrite").parquet(path)
    assert fingerprint(spark.read.parquet(path), 4) != one
