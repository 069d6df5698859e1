"""Top-k search against brute force, and the pipeline stage by stage."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

import corpus_pipeline  # noqa: E402
from rankwell.llm import topk_search  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def _plain(vectors, k):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 5:
            continue
        scored = sorted((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 7])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(int(i), (rng.normal(size=8) * rng.lognormal()).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[10][1]) for i in range(30)]  # ties
    vectors += [(400, None), (405, [None] * 8), (410, [float("nan")] * 8), (415, [float("inf")] * 8), (420, [0.0] * 8), (425, [1.0, 2.0]), (430, [2.0, 1.0]), (None, [1.0] * 8)]
    vectors += [(500 + i, (-np.abs(rng.normal(size=3))).tolist()) for i in range(9)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk_search.top_k(frame, F.col("vec_id") % 5 == 0, query_block=block).collect()
    assert sorted(tuple(r) for r in got) == _plain(vectors, 5)


def test_top_k_prunes_by_both_ways_without_loss():
    rng = np.random.default_rng(2)
    units = rng.integers(-100, 100, (400, 6))
    order = np.argsort(-(units**2).sum(axis=1))
    best = topk_search.Best(np.arange(1000, 1040), rng.integers(-300, 300, (40, 6)), 3)
    for a in range(0, 400, 50):
        best.scan(order[a : a + 50], units[order[a : a + 50]])
    for i in range(40):
        want = sorted((-int(best.units[i] @ units[j]), j) for j in range(400))[:3]
        assert [(-s, f) for s, f in zip(best.score[i].tolist(), best.found[i].tolist())] == want


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "decontamination", "sentencepiece"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = corpus.frame(spark)
    item = corpus.texts()[24].split()[-30:]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {d: t for d, t in corpus.texts().items() if t and any(c.isalpha() for c in t)}
    firsts = corpus.linked(list(left.items()))
    left = {d: t for d, t in left.items() if firsts[d][1] == d}
    seen, cut = set(), {}
    for d, t in sorted(left.items()):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        at, kept = 0, ""
        for c in t:
            size = len(c.encode())
            kept += "" if all(gone[at : at + size]) else c
            at += size
        if kept:
            cut[d] = kept
    assert 24 in cut and set(got) == set(cut) - {24}

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path("piece_bpe_32k.model"))
    assert all(got[d]["ids"] == model.encode(cut[d]) and got[d]["round_trip"] for d in got)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    corpus.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
