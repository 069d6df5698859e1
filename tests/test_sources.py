import pytest
from pyspark.sql import functions as F

from rankwell.sources import tables
from rankwell.sources.workspace import Workspace, is_complete, shared_root


def test_stage_is_built_once(spark, workspace):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert workspace.stage("s", build).count() == 3
    assert workspace.stage("s", build).count() == 3
    assert len(calls) == 1


def test_unfinished_stage_is_written_again(spark, workspace):
    spark.range(5).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(workspace.path("s"))
    assert not workspace.has("s")
    assert workspace.stage("s", lambda: spark.range(2)).count() == 2
    assert is_complete(spark, workspace.path("s"))


def test_bucketed_stage_needs_no_shuffle(spark, workspace):
    df = workspace.stage_bucketed("b", lambda: spark.range(50), ["id"], 4)
    plan = df.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again = workspace.stage_bucketed("b", lambda: spark.range(1), ["id"], 4)
    assert again.count() == 50


def test_workspace_lies_below_the_session_setting(spark):
    root = shared_root(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or root == named.rstrip("/")
    assert Workspace.of(spark, "x").root.startswith(root)


def test_append_adds_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "sink")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    two = spark.createDataFrame([(2, "changed"), (3, "c")], "id long, v string")
    for batch in (one, two, two, one):
        tables.append_new_rows(spark, batch, path, "id")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [
        (1, "a"), (2, "b"), (3, "c"),
    ]


def test_upsert_keeps_present_vectors(spark):
    schema = "original_id string, model string, embedding array<float>"
    store = spark.createDataFrame([("x", "m", [1.0]), ("y", "m", [2.0]), ("x", "n", [9.0])], schema)
    new = spark.createDataFrame([("x", "m", [5.0]), ("y", "n", [6.0]), ("z", "m", [7.0])], schema)
    got = {(r.original_id, r.model): r.embedding for r in tables.upsert_vectors(store, new).collect()}
    assert got == {
        ("x", "m"): [1.0], ("y", "m"): [2.0], ("x", "n"): [9.0],
        ("y", "n"): [6.0], ("z", "m"): [7.0],
    }
    wanted = new.select("original_id").distinct()
    assert [r[0] for r in tables.missing_vectors(store, wanted, "m").collect()] == ["z"]
    assert tables.vectors_of(store, "n").count() == 1


def test_jsonl_keeps_text_and_lists(spark, tmp_path):
    path = str(tmp_path / "corpus.jsonl")
    rows = [("a", 'line\nbreak "quoted" é', ["one", "two"], "d"), ("b", None, [], "d")]
    tables.write_jsonl(spark.createDataFrame(rows, tables.CORPUS_SCHEMA), path)
    got = tables.read_jsonl(spark, path, tables.CORPUS_SCHEMA).orderBy("id").collect()
    assert [tuple(r) for r in got] == rows


def test_splits_match_by_column_name(spark):
    a = spark.createDataFrame([(1, "x")], "id long, t string")
    b = spark.createDataFrame([("y", 2)], "t string, id long")
    got = tables.union_splits({"train": a, "test": b})
    assert sorted(tuple(r) for r in got.select("id", "t", "split").collect()) == [
        (1, "x", "train"), (2, "y", "test"),
    ]


def test_pairs_from_conversations(spark):
    turns = [
        (1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
        (1, 3, "user", "unanswered"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = tables.question_answer_pairs(df).orderBy("id").collect()
    assert [(r.question, r.documents) for r in got] == [("q1", ["a1"]), ("q2", ["a2"])]


def test_size_comes_from_the_files(spark, tmp_path):
    """Sizes of joined tables add up, they do not multiply."""
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.lit("text").alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    single = tables.text_bytes(df, F.col("t"))
    joined = df.join(df.select("id"), "id")
    assert 0 < single < tables.text_bytes(joined, F.col("t")) <= 3 * single
    made = spark.createDataFrame([("abc",), ("dé",)], "t string")
    assert tables.text_bytes(made, F.col("t")) == 6


def test_filters_reach_the_scan(spark):
    df = tables.read_table(spark, "/root/testdata/sf0.001", "embeddings")
    plan = df.where(F.col("label") == 3).select("vec_id")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "EqualTo(label,3)" in text
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in text


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Nothing:
        conf = Conf()

        class sparkContext:
            master = "yarn"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Empty:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Empty

                    return Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Nothing)
