import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankwell.functions.text import content_tokens, stop_words, tokenize
from rankwell.operators import lexical
from rankwell.operators.ranking import pad_with_first
from rankwell.sources.workspace import Workspace

DOCS = [
    (0, "river stone river bridge"),
    (1, "bridge castle"),
    (2, ""),
    (3, "castle Castle bridge stone unique"),
    (4, "river bridge castle stone stone"),
]
QUESTIONS = [
    (10, "river river stone"),
    (11, "Castle"),
    (12, "nothing matches"),
    (13, "bridge castle"),
    (14, "unique"),
]


def brute_force(docs, questions, k, k1=1.5, b=0.75):
    """BM25 over all documents, straight from the definition."""
    tokens = {i: text.split() for i, text in docs}
    cf = Counter(t for ts in tokens.values() for t in ts)
    tokens = {i: [t for t in ts if cf[t] > 1] for i, ts in tokens.items()}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = []
    for q, text in questions:
        scores = []
        for i, ts in tokens.items():
            tf, score = Counter(ts), 0.0
            for t in text.split():
                if tf[t]:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    room = tf[t] + k1 * (1 - b + b * len(ts) / avg)
                    score += idf * tf[t] * (k1 + 1) / room
            scores.append((-round(score, 6), i))
        out += [(q, r, i, -s + 0.0) for r, (s, i) in enumerate(sorted(scores)[:k], start=1)]
    return sorted(out)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    root = str(tmp_path_factory.mktemp("index"))
    return lexical.build_index(docs, F.col("text"), Workspace(spark, root))


def ask(spark, rows=QUESTIONS):
    return spark.createDataFrame(rows, "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def test_statistics(index):
    lengths = {r.doc_id: r.doc_len for r in index.documents.collect()}
    # "Castle" and "unique" occur once in the collection and are pruned.
    assert lengths == {0: 4, 1: 2, 2: 0, 3: 3, 4: 5}
    assert (index.n_docs, index.avg_doc_len) == (5, 14 / 5)
    df = {r.term: (r.cf, r.df) for r in index.vocabulary.collect()}
    assert df == {"river": (3, 2), "stone": (4, 3), "bridge": (4, 4), "castle": (3, 3)}
    assert not {r.term for r in lexical.pruned_postings(index).collect()} & {"Castle", "unique"}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_topk_equals_definition(spark, index, k):
    got = rows(lexical.bm25_topk(index, ask(spark), F.col("text"), k))
    assert got == brute_force(DOCS, QUESTIONS, k)


@pytest.mark.parametrize("k1,b", [(1.2, 0.0), (2.0, 1.0)])
def test_parameters(spark, index, k1, b):
    got = rows(lexical.bm25_topk(index, ask(spark), F.col("text"), 5, k1=k1, b=b))
    assert got == brute_force(DOCS, QUESTIONS, 5, k1, b)


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("limits", [{"max_broadcast": 0}, {"matches_per_task": 0}])
def test_many_questions_give_the_same(spark, index, k, limits, monkeypatch):
    """The pruned plan, broadcast or shuffled with frequent terms split on both sides."""
    monkeypatch.setattr(lexical, "POSTINGS_PER_SALT", 2)
    monkeypatch.setattr(lexical, "QUESTIONS_PER_SALT", 1)
    got = rows(lexical.bm25_topk(index, ask(spark), F.col("text"), k, **limits))
    assert got == brute_force(DOCS, QUESTIONS, k)


def test_many_questions_with_pruned_terms(spark, tmp_path, monkeypatch):
    """A term in every document is left to complete scores; results do not change."""
    import random

    random.seed(3)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(300):
        text = ["common"] * random.randint(1, 3) + random.choices(words, k=random.randint(3, 9))
        docs.append((i, " ".join(text)))
    questions = [
        (1000 + i, " ".join(["common", *random.choices(words, k=4)])) for i in range(40)
    ]
    monkeypatch.setattr(lexical, "POSTINGS_PER_SALT", 100)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.build_index(frame, F.col("text"), Workspace(spark, str(tmp_path)))
    asked = ask(spark, questions)
    weighted = lexical.weighted_terms(index, lexical.question_terms(asked, F.col("text")))
    split = lexical._split_terms(index, weighted, 3, lexical.K1, lexical.B)
    assert split.where("term = 'common' and not decisive").count() > 0
    got = rows(lexical.bm25_topk(index, asked, F.col("text"), 3, max_broadcast=0))
    assert got == brute_force(docs, questions, 3)


def test_index_is_reopened_not_rebuilt(spark, tmp_path, monkeypatch):
    """A later session finds the files but no catalog entries."""
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    workspace = Workspace(spark, str(tmp_path / "kept"))
    lexical.build_index(docs, F.col("text"), workspace)
    (folder,) = (p for p in (tmp_path / "kept").iterdir() if p.is_dir())
    for name in ("raw_postings", "doc_lengths", "postings"):
        workspace.child(folder.name).forget(name)
    with monkeypatch.context() as patch:
        patch.setattr(lexical, "postings", None)  # no text is read again
        again = lexical.build_index(spark.read.parquet(str(tmp_path / "docs")), F.col("text"), workspace)
    assert rows(lexical.bm25_topk(again, ask(spark), F.col("text"), 3)) == brute_force(
        DOCS, QUESTIONS, 3
    )
    plan = again.postings.groupBy("doc_id").count()._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_padding_skips_hits_in_front(spark):
    docs = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    hits = spark.createDataFrame(
        [(1, 1, 0, 2.0), (1, 2, 1, 1.0)], "query_id long, rank int, doc_id long, score double"
    )
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = rows(pad_with_first(hits, asked, docs, 3))
    assert got == [
        (1, 1, 0, 2.0), (1, 2, 1, 1.0), (1, 3, 2, 0.0),
        (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0),
    ]


def test_equal_documents_rank_by_id(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words here") for i in (7, 3, 5)], "doc_id long, text string")
    index = lexical.build_index(docs, F.col("text"), Workspace(spark, str(tmp_path)))
    got = lexical.bm25_topk(index, ask(spark, [(1, "words")]), F.col("text"), 2)
    assert [r[2] for r in rows(got)] == [3, 5]


def test_score_of_pairs_and_covering_documents(spark, index):
    weighted = lexical.weighted_terms(index, lexical.question_terms(ask(spark), F.col("text")))
    covering = {(r.query_id, r.doc_id) for r in lexical.covering_documents(index, weighted).collect()}
    # Only indexed terms count, so "Castle" and "unique" ask for nothing.
    assert covering == {(10, 0), (10, 4), (13, 1), (13, 3), (13, 4)}
    pairs = spark.createDataFrame([(10, 0), (10, 2)], "query_id long, doc_id long")
    scores = {r.doc_id: r.score for r in lexical.score_pairs(index, weighted, pairs).collect()}
    best = {(q, d): s for q, _, d, s in brute_force(DOCS, QUESTIONS, 5)}
    assert scores == {0: best[10, 0], 2: 0.0}


def test_plan_shuffles_only_ranked_rows(spark, index):
    """No exchange below the per-question limit: scores are summed in their buckets."""
    weighted = lexical.weighted_terms(index, lexical.question_terms(ask(spark), F.col("text")))
    plan = lexical.best_documents(index, weighted, 3)._jdf.queryExecution().executedPlan().toString()
    top, _, below = plan.partition("WindowGroupLimit [query_id")
    limit, _, scoring = below.partition("Partial")
    assert "Exchange hashpartitioning(query_id" in limit
    assert "hashpartitioning(query_id" not in scoring.split("BroadcastExchange")[0]
    assert "Bucketed: true" in scoring


def test_prune_keeps_order_and_repeats(spark):
    docs = spark.createDataFrame(
        [(0, "b a b"), (1, "c lone a"), (2, "lonely"), (3, "")], "doc_id long, text string"
    ).withColumn("text", F.regexp_replace("text", r"\ba\b", "alpha"))
    got = {r.doc_id: r.tokens for r in lexical.prune_rare_terms(docs, F.col("text")).collect()}
    assert got == {0: ["b", "alpha", "b"], 1: ["alpha"], 2: [], 3: []}


def test_tokens(spark):
    text = "The Dog's café étude, 3.5\n\t$x \U0001f600 den?"
    got = spark.createDataFrame([(text,)], "t string").select(
        tokenize(F.col("t")).alias("all"), content_tokens(F.col("t")).alias("kept")
    ).first()
    assert got["all"] == [
        "The", "Dog", "'", "s", "café", "étude", ",", "3", ".", "5", "$", "x",
        "\U0001f600", "den", "?",
    ]
    assert got["kept"] == ["Dog", "café", "étude", "3", "5", "$", "x", "\U0001f600"]
    assert {"the", "den", "los", "nous"} <= set(stop_words())


def test_few_terms_reach_the_scan_of_the_postings(spark, tmp_path):
    from rankwell.sources.workspace import Workspace

    docs = spark.createDataFrame([(i, f"apple pear word{i % 7} stone") for i in range(60)], "doc_id long, text string")
    index = lexical.build_index(docs, F.col("text"), Workspace(spark, str(tmp_path / "stages")))
    asked = spark.createDataFrame([(1, "word3 apple")], "query_id long, text string")
    hits = lexical.bm25_topk(index, asked, F.col("text"), 3, pad=False)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "doc_len" in line)
    assert "In(term" in scan and "lower(term" not in scan
    assert {r.doc_id % 7 for r in hits.collect()} == {3}


@pytest.mark.parametrize("few", [True, False])
def test_terms_of_a_question_meet_all_its_documents(spark, few):
    pairs = spark.createDataFrame([(q, d) for q in (1, 2) for d in range(40)], "query_id long, doc_id long")
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "query_id long, term string")
    got = {(r.query_id, r.doc_id, r.term) for r in lexical.with_terms(pairs, terms, few).collect()}
    assert got == {(1, d, t) for d in range(40) for t in "ab"}


def test_scoring_pairs_shuffles_no_postings_and_packs_no_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(d, t) for d, t in DOCS for _ in range(1 + (d == 3))], "doc_id long, text string")
    index = lexical.build_index(docs, F.col("text"), Workspace(spark, str(tmp_path)))
    weighted = lexical.weighted_terms(index, lexical.question_terms(ask(spark), F.col("text")))
    asked = [(q, d) for q, _ in QUESTIONS for d, _ in DOCS]
    pairs = spark.createDataFrame([*asked, (None, 1), (10, None)], "query_id long, doc_id long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (lexical.matching_pairs(index, weighted, pairs), lexical.covering_documents(index, weighted)):
            found.collect()
            shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
            assert not [s for s in shuffles if "term#" in s and "doc_id#" in s]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not list(tmp_path.rglob("blocks"))
    # More terms than may be broadcast: both sides are shuffled, with the same rows.
    few, many = (sorted(r[:3] for r in lexical._matches_of(index, weighted, pairs, n).select("query_id", "doc_id", "term").collect()) for n in (1000, 0))
    assert few == many and len(few) > 5
