import pytest
from pyspark.sql import functions as F

from rankwell.operators import context, evaluation
from rankwell.operators.fusion import fuse
from rankwell.operators.ranking import top_k
from rankwell.streaming.questions import answer_stream, read_questions

RANKING = "query_id long, rank int, doc_id long, score double"


@pytest.fixture
def hits(spark):
    """Question 1 finds its document first, 2 third, 3 never, 4 has no hits."""
    rows = [(1, 1, 10, 3.0), (1, 2, 11, 2.0), (2, 1, 12, 3.0), (2, 2, 13, 2.0),
            (2, 3, 20, 1.0), (3, 1, 14, 1.0)]
    return spark.createDataFrame(rows, RANKING)


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")


def test_ranks_and_report(spark, hits, questions):
    truth = spark.createDataFrame(
        [(1, 10), (1, 11), (2, 20), (3, 99), (4, 10)], "query_id long, doc_id long"
    )
    ranks = evaluation.truth_rank(questions, evaluation.relevant_by_pairs(hits, truth))
    assert {r.query_id: r["rank"] for r in ranks.collect()} == {1: 1, 2: 3, 3: None, 4: None}
    report = {r.k: r for r in evaluation.report(ranks, (1, 2, 3)).collect()}
    assert [(report[k].success, report[k].mrr) for k in (1, 2, 3)] == [
        (0.25, 0.25), (0.25, 0.25), (0.5, 0.333333),
    ]
    for r in report.values():
        assert report[1].success <= r.mrr <= r.success


def test_relevance_by_label(spark, hits, questions):
    asked = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 5)], "query_id long, label int")
    docs = spark.createDataFrame(
        [(10, 0), (11, 5), (12, 6), (13, 6), (20, 6), (14, 0)], "doc_id long, label int"
    )
    found = evaluation.relevant_by_label(hits, asked, docs)
    assert sorted((r.query_id, r["rank"]) for r in found.collect()) == [(1, 2), (2, 1), (2, 2), (2, 3)]


def test_fusing_one_ranking_keeps_it(hits):
    fused = fuse({"only": hits}, 3)
    order = lambda df: [(r.query_id, r["rank"], r.doc_id) for r in df.orderBy("query_id", "rank").collect()]
    assert order(fused) == order(hits)


def test_weights_decide(spark):
    a = spark.createDataFrame([(1, 1, 10, 9.0), (1, 2, 11, 8.0)], RANKING)
    b = spark.createDataFrame([(1, 1, 11, 0.9), (1, 2, 10, 0.8)], RANKING)
    first = lambda w: fuse({"a": a, "b": b}, 1, w).first().doc_id
    assert first(None) == 10  # equal sums: the smaller id
    assert first({"b": 2.0}) == 11
    score = fuse({"a": a, "b": b}, 2, {"b": 2.0}).where("rank = 1").first().score
    assert score == pytest.approx(1 / 62 + 2 / 61, abs=1e-9)


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("score")
    )
    top = top_k(df, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r.query_id, r.doc_id) for r in top.collect()) == [
        (0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5),
    ]


def test_context_and_prompts(spark, hits):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (10, 11, 12, 13, 14, 20)], "doc_id long, text string")
    contexts = context.build_context(hits, docs)
    got = {r.query_id: r.context for r in contexts.collect()}
    assert got[1] == "[1] text 10\n\n[2] text 11\n\n"
    asked = spark.createDataFrame([(1, "why?")], "query_id long, text string")
    messages = context.build_prompts(contexts, asked, "Use:\n%sEnd").first().messages
    assert [(m.role, m.content) for m in messages] == [
        ("system", "Use:\n[1] text 10\n\n[2] text 11\n\nEnd"), ("user", "why?"),
    ]


def test_stream_answers_each_question_once(spark, tmp_path):
    folder, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "query_id long, text string"

    def ask(ids):
        spark.createDataFrame([(i, f"q{i}") for i in ids], schema).coalesce(1).write.mode(
            "append"
        ).parquet(folder)

    def retrieve(batch):
        return batch.select(
            "query_id", F.lit(1).alias("rank"), F.lit(7).cast("long").alias("doc_id"),
            F.lit(0.5).alias("score"),
        )

    def run(checkpoint):
        stream = read_questions(spark, folder, schema, files_per_batch=1)
        answer_stream(stream, retrieve, sink, checkpoint).awaitTermination()
        return sorted(r.query_id for r in spark.read.parquet(sink).collect())

    ask([1, 2])
    ask([3])
    assert run(state) == [1, 2, 3]
    ask([4])
    assert run(state) == [1, 2, 3, 4]  # goes on where it stopped
    assert run(state) == [1, 2, 3, 4]
