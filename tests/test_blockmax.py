"""Packed postings: the same top-k, with blocks skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import blockmax, lexical


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    vocab = [f"term{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    docs = [(i * 7, " ".join(rng.choice(vocab, int(rng.integers(0, 60)), p=weight / weight.sum()))) for i in range(1500)]
    docs += [(20_000 + i, "term5 term250 term251 term252") for i in range(4)]  # ties
    asked = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 9)), p=weight / weight.sum()))) for i in range(40)]
    asked += [(100, "term5 term250 term251 term252"), (101, "nothing of this"), (102, ""), (103, "term5 term5 term9")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(asked, "query_id long, text string"),
    )


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    from rankwell.sources.workspace import Workspace

    return lexical.build_index(corpus[0], F.col("text"), Workspace(spark, str(tmp_path_factory.mktemp("blocks"))))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k, k1, b", [(1, 1.5, 0.75), (5, 1.5, 0.75), (50, 1.5, 0.75), (5, 1.2, 0.5), (2000, 2.0, 1.0)])
def test_blocks_give_the_plain_ranking(index, corpus, k, k1, b):
    weighted = lexical.weighted_terms(index, lexical.question_terms(corpus[1], F.col("text")))
    plain = lexical.ranking(lexical.score_matches(index, weighted, k1, b), k)
    assert rows(lexical.best_documents(index, weighted, k, k1, b)) == rows(plain)


def test_blocks_below_the_floor_are_not_read(index, corpus):
    weighted = lexical.weighted_terms(index, lexical.question_terms(corpus[1].where("query_id = 100"), F.col("text")))
    asked = blockmax.asked_of(weighted)
    setting = blockmax.Setting(lexical.K1, lexical.B, index.avg_doc_len)
    found = blockmax.best(index.blocks, asked, 1, setting, True, 1000).collect()
    held = weighted.agg(F.sum("df")).first()[0]
    read = sum(r["n_read"] for r in {r["n_read"]: r for r in found}.values())
    assert 0 < read < held


def test_the_scan_reads_only_asked_terms_without_a_shuffle(index, corpus):
    weighted = lexical.weighted_terms(index, lexical.question_terms(corpus[1].where("query_id = 100"), F.col("text")))
    setting = blockmax.Setting(lexical.K1, lexical.B, index.avg_doc_len)
    plan = blockmax.best(index.blocks, blockmax.asked_of(weighted), 5, setting, True, 1000)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "PushedFilters: [In(term" in physical and "Exchange" not in physical


def test_packed_rows_hold_all_postings(index):
    held = {}
    for r in index.blocks.collect():
        docs, f = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["f"], np.int32)
        cuts = np.frombuffer(r["cuts"], np.int32)
        assert cuts.sum() == len(docs) and (np.repeat(np.arange(blockmax.PARTS), cuts) == blockmax._block_of(docs)).all()
        for d, n in zip(docs.tolist(), f.tolist()):
            assert (d, r["term"]) not in held
            held[d, r["term"]] = n
    assert held == {(r["doc_id"], r["term"]): r["f"] for r in lexical.pruned_postings(index).collect()}


def test_many_question_terms_go_in_passes_without_shuffled_matches(index, corpus, monkeypatch):
    weighted = lexical.weighted_terms(index, lexical.question_terms(corpus[1], F.col("text")))
    plain = rows(lexical.ranking(lexical.score_matches(index, weighted), 5))
    monkeypatch.setattr(lexical, "BLOCK_TERMS", weighted.count() // 3)
    monkeypatch.setattr(lexical, "match_terms", None)
    assert rows(lexical.best_documents(index, weighted, 5, matches_per_task=0)) == plain


def test_more_terms_than_passes_held_are_not_shuffled_either(index, corpus, monkeypatch):
    weighted = lexical.weighted_terms(index, lexical.question_terms(corpus[1], F.col("text")))
    plain = rows(lexical.ranking(lexical.score_matches(index, weighted), 5))
    n_terms = weighted.count()
    monkeypatch.setattr(lexical, "MAX_PASSES", 2)
    monkeypatch.setattr(lexical, "match_terms", None)
    got = lexical.best_documents(index, weighted, 5, max_broadcast=-(-n_terms // 10), matches_per_task=0)
    assert rows(got) == plain
    # Ten passes in rounds, each written: what is left to run shuffles nothing.
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_rare_terms_are_left_out_of_the_blocks(spark, workspace):
    docs = spark.createDataFrame([(1, "lamp lamp once"), (2, "lamp garden"), (3, "garden twice twice")], "doc_id long, text string")
    index = lexical.build_index(docs, F.col("text"), workspace)
    assert {r["term"] for r in index.blocks.collect()} == {"lamp", "garden", "twice"}
    exchanges = blockmax.pack(index.postings, index.rare, index.buckets, blockmax.Setting(1.5, 0.75, 2.0))
    plan = exchanges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
