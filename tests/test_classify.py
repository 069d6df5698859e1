import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.functions.vectors import softmax
from rankwell.functions.text import truncate_tokens
from rankwell.operators import classify, embedding
from rankwell.plans.build import build_corpus, train_classifier
from rankwell.plans.retrieve import Retriever
from rankwell.sources.workspace import Workspace

TOPICS = ["river boat water", "castle king stone", "engine wheel road"]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (i, TOPICS[i % 3].split()[i % 2], [f"{TOPICS[i % 3]} {i}"], i % 3) for i in range(60)
    ]
    return spark.createDataFrame(
        rows, "id long, question string, documents array<string>, cluster int"
    )


def test_report_on_a_hand_made_confusion(spark):
    """Class 2 is never predicted: its ratios are 0, not undefined."""
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 0), (2, 1)]
    df = spark.createDataFrame(pairs, "label int, pred int")
    got = {r["class"]: r for r in classify.classification_report(df).collect()}
    assert (got["0"].precision, got["0"].recall) == (0.666667, 0.666667)
    assert (got["1"].precision, got["1"].recall, got["1"].f1) == (0.333333, 1.0, 0.5)
    assert (got["2"].precision, got["2"].recall, got["2"].f1) == (0.0, 0.0, 0.0)
    assert got["accuracy"].f1 == 0.5
    assert got["macro avg"].recall == 0.555556
    assert got["weighted avg"].precision == pytest.approx((3 * 2 / 3 + 1 / 3) / 6, abs=1e-6)
    assert [got[c].support for c in ("0", "1", "2", "accuracy")] == [3, 1, 2, 6]
    assert classify.accuracy(df).first()["accuracy"] == 0.5


def test_classifier_learns_saves_and_loads(spark, labelled, tmp_path):
    rows = classify.training_rows(labelled)
    model = classify.fit_classifier(rows)
    assert classify.accuracy(classify.predict(model, rows)).first()["accuracy"] == 1.0
    path = str(tmp_path / "model")
    classify.save_classifier(model, path)
    asked = spark.createDataFrame([(1, "a king and a castle")], "query_id long, question string")
    tokens = classify.question_rows(asked)
    for m in (model, classify.load_classifier(path)):
        best = classify.classify_topn(m, tokens, 2).orderBy("rank").collect()
        assert best[0].cluster == 1 and best[0].probability > best[1].probability
    with pytest.raises(ValueError, match="asked for 4 clusters"):
        classify.classify_topn(model, tokens, 4)


def test_selection_keeps_the_first_of_equals(labelled):
    rows = classify.training_rows(labelled)
    settings = [classify.Setting(0.01, 10), classify.Setting(0.001, 10)]
    _, table = classify.select_model(rows, rows, settings)
    assert [(r.setting, r.best) for r in table.orderBy("setting").collect()] == [(0, True), (1, False)]


def test_loss_history_runs_up(labelled):
    rows = classify.training_rows(labelled)
    table = classify.loss_history(classify.fit_classifier(rows), rows).orderBy("iteration").collect()
    assert table[0].loss > table[-1].loss
    assert table[-1].running_loss == pytest.approx(sum(r.loss for r in table))


def test_classes_are_counted_from_the_largest_label(labelled):
    assert classify.class_count(labelled).first()["n_classes"] == 3


def test_the_classifier_reads_whole_texts(spark):
    df = spark.createDataFrame(
        [(0, "q", [" ".join(["w"] * 600)], 0)],
        "id long, question string, documents array<string>, cluster int",
    )
    assert classify.training_rows(df).select(F.size("tokens")).first()[0] == 601
    assert df.select(F.size(truncate_tokens(F.col("documents")[0]))).first()[0] == 512


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1000.0],), ([0.0, 0.0, 0.0],)], "x array<double>")
    got = [r[0] for r in df.select(softmax(F.col("x"))).collect()]
    assert got[0] == [0.0, 0.0, 1.0]
    assert got[1] == pytest.approx([1 / 3] * 3)


def test_embed_with_a_batch_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    got = embedding.embed(df, "text", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r.id: r.embedding for r in got.collect()} == {1: [2.0, 1.0], 2: [4.0, 1.0]}


def test_embed_only_missing_vectors(spark):
    store = spark.createDataFrame(
        [("x", "m", [9.0]), ("y", "n", [9.0])], "original_id string, model string, embedding array<float>"
    )
    docs = spark.createDataFrame([("x", "a"), ("y", "bb")], "original_id string, text string")
    got = embedding.embed_missing(store, docs, "text", "m", lambda ts: np.array([[len(t)] for t in ts]))
    assert {(r.original_id, r.model): r.embedding for r in got.collect()} == {
        ("x", "m"): [9.0], ("y", "n"): [9.0], ("y", "m"): [2.0],
    }


def _counting(workspace, built):
    """The workspace, noting every stage it has to build."""

    class Counting(Workspace):
        def child(self, name):
            return Counting(self.spark, self.path(name))

        def stage(self, name, build, **options):
            if not self.has(name):
                built.append(name)
            return super().stage(name, build, **options)

    return Counting(workspace.spark, workspace.root)


def test_build_train_and_retrieve(spark, labelled, workspace):
    """From a raw corpus to routed answers, and a second call that builds nothing."""
    raw = labelled.select(
        F.format_string("%04d", "id").alias("id"),
        F.concat_ws(" ", "question", "id").alias("question"),
        "documents",
        F.lit("made").alias("dataset_name"),
    )
    twice = raw.unionByName(raw.withColumn("id", F.concat(F.lit("x"), "id")))
    corpus = build_corpus(twice, workspace, n_clusters=3, dimensions=64)
    rows = corpus.rows.collect()
    assert sorted(r.id for r in rows) == list(range(60))  # repeated questions are gone
    assert {r.split for r in rows} == {"train", "test"}
    assert len({r.cluster for r in rows}) == 3
    model, table = train_classifier(corpus, workspace, [classify.Setting()])
    assert table.count() == 1
    retriever = Retriever(corpus=corpus.documents(), classifier=model)
    asked = corpus.questions("test")
    routed = retriever.retrieve("classifier", asked, 3, n_clusters=3)
    exact = retriever.retrieve("cosine", asked, 3)
    # With every cluster probed, routing changes nothing.
    assert sorted(routed.collect()) == sorted(exact.collect())
    with pytest.raises(ValueError, match="unknown mode"):
        retriever.retrieve("other", asked, 3)
    built = []
    again = build_corpus(twice, _counting(workspace, built), n_clusters=3, dimensions=64)
    assert again.rows.count() == 60 and built == []
    # Other rows, or another setting, never find these stages.
    fewer = build_corpus(raw.where("id < '0030'"), workspace, n_clusters=2, dimensions=32)
    assert fewer.rows.count() == 30 and fewer.rows.select("cluster").distinct().count() == 2
    assert len(fewer.rows.first()["embedding"]) == 32
