"""Snapshots that fail half-way, and a corpus that grows."""

import json

import pytest
from pyspark.sql import functions as F

from rankwell.operators import embedding, lexical
from rankwell.operators.lexical import bm25_topk, build_index
from rankwell.plans.increment import GrowingCorpus
from rankwell.sources.snapshots import MAX_PARTS, Conflict, Snapshots
from rankwell.sources.tables import CORPUS_SCHEMA, write_upsert

VECTORS = "original_id long, model string, embedding array<float>"


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "store"))


def test_appended_parts_are_seen_together(spark, store):
    assert store.read("t") is None
    for i in range(3):
        store.append("t", spark.range(i * 10, i * 10 + 2))
    store.append("empty", spark.range(0))
    assert ids(store.read("t")) == [0, 1, 10, 11, 20, 21] and store.read("empty").count() == 0
    store.compact("t")
    assert ids(store.read("t")) == [0, 1, 10, 11, 20, 21] and len(store.manifest()["tables"]["t"]["parts"]) == 1


def test_many_parts_become_one(spark, store):
    for i in range(MAX_PARTS + 2):
        store.append("t", spark.range(i, i + 1).coalesce(1))
    assert len(store.manifest()["tables"]["t"]["parts"]) < MAX_PARTS
    assert ids(store.read("t")) == list(range(MAX_PARTS + 2))


@pytest.mark.parametrize("torn", [b"", b'{"tables": {}, "done"', b'{"tables": {}, "done": [], "facts": {}}'])
def test_a_torn_manifest_leaves_the_snapshot_before(spark, store, tmp_path, torn):
    store.append("t", spark.range(2))
    held = store.manifest()
    (tmp_path / "store" / "_manifests" / "000000000002.json").write_bytes(torn)
    assert store.manifest() == held and ids(store.read("t")) == [0, 1]
    store.append("t", spark.range(5, 6))
    assert ids(store.read("t")) == [0, 1, 5] and store.manifest()["sealed"] == 3


def test_two_writers_of_one_snapshot(spark, store):
    base = store.manifest()
    one, two = store.write_part(spark.range(1)), store.write_part(spark.range(7, 8))
    store.commit(base, {"t": one})
    with pytest.raises(Conflict):
        store.commit(base, {"t": two})
    assert ids(store.read("t")) == [0]
    assert store.drop_unnamed() == 1 and ids(store.read("t")) == [0]


@pytest.mark.parametrize("step", ["write_part", "commit"])
def test_an_upsert_that_fails_leaves_the_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "vectors")
    write_upsert(spark, spark.createDataFrame([(1, "m", [1.0])], VECTORS), path)

    def fail(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(Snapshots, step, fail)
    with pytest.raises(OSError):
        write_upsert(spark, spark.createDataFrame([(2, "m", [2.0])], VECTORS), path)
    monkeypatch.undo()
    assert ids(Snapshots(spark, path).read("vectors")) == [1]
    assert write_upsert(spark, spark.createDataFrame([(2, "m", [2.0])], VECTORS), path).count() == 2


# --- a corpus that grows -------------------------------------------------------------

FIRST = [("b", "red house", ["red house on the hill", "blue door"]), ("a", "tree", ["green tree"]), ("c", "tree", ["lost"]), ("n", None, ["null question"])]
SECOND = [("z", "tree", ["known already"]), ("y", "river", ["blue river house", "unique"]), ("x", None, ["null again"]), ("w", "empty", [])]


def raw(spark, rows):
    return spark.createDataFrame([(*r, "set") for r in rows], CORPUS_SCHEMA)


@pytest.fixture
def grown(spark, tmp_path):
    corpus = GrowingCorpus(spark, str(tmp_path / "grown"))
    assert corpus.ingest(raw(spark, FIRST))
    assert corpus.embed("letters", embedding.letter_counts) == 3
    assert corpus.ingest(raw(spark, SECOND))
    return corpus


def test_rows_number_on(grown):
    assert {(r.id, r.original_id) for r in grown.rows().collect()} == {(0, "a"), (1, "b"), (2, "n"), (3, "w"), (4, "y")}


def test_deltas_equal_one_build(spark, grown, workspace):
    whole = grown.rows().select(F.col("id").alias("doc_id"), F.concat_ws(" ", "documents").alias("text"))
    once, steps = build_index(whole, F.col("text"), workspace), grown.index()
    assert (once.n_docs, once.avg_doc_len, once.n_postings) == (steps.n_docs, steps.avg_doc_len, steps.n_postings)
    for name in ("documents", "vocabulary", "rare", "postings"):
        one, two = getattr(once, name), getattr(steps, name)
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.select(*one.columns).collect()}
    asked = spark.createDataFrame([(1, "blue house"), (2, "tree lost")], "query_id long, text string")
    hits = [{tuple(r) for r in bm25_topk(i, asked, F.col("text"), 3).collect()} for i in (once, steps)]
    assert hits[0] == hits[1] and hits[0]


def test_a_step_counts_once_and_old_text_is_not_read_again(spark, grown, tmp_path, monkeypatch):
    held = grown.store.manifest()
    path = str(tmp_path / "input")
    raw(spark, [("q", "new question", ["tree of steps"])]).write.parquet(path)
    assert grown.ingest(spark.read.schema(CORPUS_SCHEMA).parquet(path))
    assert not grown.ingest(spark.read.schema(CORPUS_SCHEMA).parquet(path))
    now = grown.store.manifest()
    for name, table in now["tables"].items():
        old = held["tables"][name]["parts"]
        assert table["parts"][: len(old)] == old and len(table["parts"]) == len(old) + (name != "vectors")
    monkeypatch.setattr(lexical, "words", None)  # putting deltas together reads no text
    assert grown.index().n_docs == 6


def test_models_touch_only_what_they_lack(grown):
    assert grown.embed("letters", embedding.letter_counts) == 2
    assert grown.embed("lengths", embedding.text_lengths) == 5
    assert grown.embed("letters", embedding.letter_counts) == 0
    assert grown.vectors().groupBy("model").count().orderBy("model").collect() == [("lengths", 5), ("letters", 5)]


def test_a_failed_step_is_not_seen_and_can_be_repeated(spark, grown, monkeypatch):
    held, more = grown.store.manifest(), raw(spark, [("q", "again", ["house"])])

    def fail(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(Snapshots, "commit", fail)
    with pytest.raises(OSError):
        grown.ingest(more)
    monkeypatch.undo()
    assert grown.store.manifest() == held and grown.rows().count() == 5
    assert grown.ingest(more) and grown.rows().count() == 6


def test_manifest_is_plain_json(grown, tmp_path):
    names = sorted((tmp_path / "grown" / "_manifests").glob("*.json"))
    assert json.loads(names[-1].read_text())["facts"]["n_rows"] == 5


def test_texts_are_written_once_and_first_rows_stay(spark, tmp_path):
    raw = [("b", "same", ["late"], "x"), ("a", "same", ["first"], "x"), ("a", "same", ["first"], "x"), ("c", None, ["none"], "x"), (None, None, ["other"], "x"), ("d", "", ["empty"], "x"), (None, "lone", ["no id"], "x")]
    corpus = GrowingCorpus(spark, str(tmp_path / "grow"))
    corpus.ingest(spark.createDataFrame(raw, CORPUS_SCHEMA))
    corpus.ingest(spark.createDataFrame([("z", None, ["again"], "x"), ("y", "new", ["word word"], "x")], CORPUS_SCHEMA))
    got = {(r.id, r.original_id, r.question, r.documents[0]) for r in corpus.rows().collect()}
    assert got == {(0, None, "lone", "no id"), (1, "a", "same", "first"), (2, "c", None, "none"), (3, "d", "", "empty"), (4, "y", "new", "word word")}
    assert corpus.embed("letters", embedding.letter_counts) == 5 and corpus.embed("letters", embedding.letter_counts) <= 1
    index = corpus.index()
    assert {r.term: r.cf for r in index.vocabulary.collect()} == {"word": 2} and index.documents.count() == 5
    # Texts lie in the snapshot's parts alone, and no postings are put together for lengths and terms.
    assert not [p for name in ("rows", "postings", "blocks") for p in (tmp_path / "grow" / "work").rglob(name)]
    assert {r.term for r in lexical.pruned_postings(index).collect()} == {"word"}
