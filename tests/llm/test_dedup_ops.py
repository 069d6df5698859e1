"""Substring, suffix-array and Jaccard operators against brute force."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from rankwell.llm import components, jaccard_join, sketch, substring_dedup, suffix_dedup  # noqa: E402
from rankwell.llm import textblocks as tb  # noqa: E402
from rankwell.llm.suffix_array import suffix_array  # noqa: E402

DOCS = list(corpus.texts().items())


def _found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("window, gram", [(50, 20), (12, 5)])
def test_substring_dedup_equals_brute_force(spark, window, gram):
    got = _found(substring_dedup.digest(substring_dedup.substring_dedup(corpus.frame(spark), window, gram, bits=18)))
    assert got == corpus.window_words(DOCS, window)


def test_a_saturated_sketch_loses_nothing(spark):
    got = _found(substring_dedup.digest(substring_dedup.substring_dedup(corpus.frame(spark), bits=4)))
    assert got == corpus.window_words(DOCS, 50)


def test_a_sketch_is_filled_by_repeats_alone(spark):
    # Fifty thousand hashes on as many bits; two hundred of them come twice, ten three times.
    def hashes(batch):
        yield tb.mix(batch.column("id").to_numpy().astype(np.uint64))

    ids = spark.range(50_000).union(spark.range(200)).union(spark.range(10)).repartition(3)
    cells = sketch.Sketch.of(ids, hashes, bits=15).cells
    assert cells.repeated(tb.mix(np.arange(200, dtype=np.uint64))).all()
    assert cells.repeated(tb.mix(np.arange(200, 50_000, dtype=np.uint64))).mean() < 0.01


@pytest.mark.parametrize("length, k, letters", [(12, 5, 200), (12, 5, 2), (9, 9, 3), (30, 3, 1)])
def test_runs_have_the_leftmost_least_gram(length, k, letters):
    rng = np.random.default_rng(length + letters)
    sizes = [0, length - 1, 70, length, 0, 300, 3, length + 1, 1]
    bounds = np.cumsum([0] + sizes)
    values = tb.mix(rng.integers(0, letters, bounds[-1]).astype(np.uint64) + np.uint64(1))
    grams = tb.Rolling(values, 2).grams(k)
    found = tb.Runs(grams, bounds, length, k)
    want = []
    for doc, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for start in range(a, b - length + 1):
            at = start + int(np.argmin(grams[start : start + length - k + 1] >> np.uint64(32)))
            if want and want[-1][2:] == [at, doc]:
                want[-1][1] = start
            else:
                want.append([start, start, at, doc])
    assert np.stack([found.first, found.last, found.anchor, found.doc], axis=1).tolist() == want


@pytest.mark.parametrize("options", [{}, {"text_bytes": 2_000, "bits": 16, "slice_bytes": 1 << 12}, {"length": 30, "gram": 9, "bits": 18}])
def test_suffix_dedup_equals_brute_force(spark, options):
    got = _found(suffix_dedup.digest(suffix_dedup.suffix_dedup(corpus.frame(spark), **options)))
    assert got == corpus.repeated_bytes(DOCS, options.get("length", 100))


@pytest.mark.parametrize("bits", [6, 29])
def test_equal_rows_of_one_id_lose_nothing_to_a_full_bitmap(spark, bits):
    # No anchor has two contents, whatever a full bitmap lets through.
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(d, t, None, None, 0, None, 0, None, None, None) for d, t in ((7, text), (7, text), (9, "short"))]
    got = suffix_dedup.suffix_dedup(corpus.frame(spark, rows), bits=bits).collect()
    assert [r["n_removed"] for r in got] == [0, 0, 0]


def test_cut_texts_are_whole_characters(spark):
    docs = corpus.frame(spark)
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert got[1]["text"] is None and got[2]["text"] == "" and got[4]["text"] == "one two three"
    assert 11 not in got and "�" not in got[41]["text"] and got[41]["kept"] == "clash"


@pytest.mark.parametrize("n, top", [(1, 3), (2, 2), (5, 2), (40, 2), (999, 3), (1000, 3), (1001, 200)])
def test_suffix_array_orders_suffixes(n, top):
    x = np.random.default_rng(n).integers(1, top + 1, n)
    plain = sorted(range(n), key=lambda i: x[i:].tolist())
    assert suffix_array(x, 1 << 30).tolist() == plain
    short = [tuple(x[i : i + 7]) for i in suffix_array(x, 7)]
    assert short == sorted(short)


@pytest.mark.parametrize("tile", [512, 2])
def test_jaccard_components_equal_brute_force(spark, tile):
    got = _found(jaccard_join.jaccard_components(corpus.frame(spark), tile=tile))
    assert got == corpus.linked(DOCS)


def test_jaccard_of_chains_and_hot_groups(spark):
    # Each text changes another few words of the one before: neighbours link, ends don't.
    words = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(words)))
        words[(3 * i) % 120] = f"new{i}"
    docs += [(100 + i, f"tail{i} " + " ".join(f"hot{j}" for j in range(60))) for i in range(30)]
    rows = [(d, t, None, None, 0, None, 0, None, None, None) for d, t in docs]
    got = _found(jaccard_join.jaccard_components(corpus.frame(spark, rows), tile=8))
    assert got == corpus.linked(docs)


def test_a_set_of_several_blocks_counts_once(spark, monkeypatch):
    # Blocks of two texts: both sets, the first alone, the second alone.
    one = " ".join(f"w{i:03}" for i in range(104))
    other = " ".join([f"w{i:03}" for i in range(86)] + [f"x{i:03}" for i in range(18)])  # 82 of 118 shingles: 0.69
    monkeypatch.setattr(jaccard_join, "GROUP_BYTES", 2 * len(one))
    docs = list(enumerate([one, other, one, one, other, other]))
    frame = spark.createDataFrame([(d, t, None, None, 0, None, 0, None, None, None) for d, t in docs], corpus.SCHEMA).coalesce(1)
    assert _found(jaccard_join.jaccard_components(frame)) == corpus.linked(docs)


def test_equal_ids_keep_one_row(spark):
    rows = [r for r in corpus.rows() if r[0] in (10, 12)] * 2
    got = _found(jaccard_join.jaccard_components(corpus.frame(spark, rows)))
    assert {d: c for d, (_, c) in got.items()} == {10: 10, 12: 10}


def test_empty_tables(spark):
    empty = corpus.frame(spark, [])
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 51), (51, 52), (60, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50, 52: 50}


def test_a_pair_exactly_at_the_threshold_links(spark):
    # 100,000 shingles, 75,000 of them shared: a collision of two would lose the link.
    words = [f"w{i}" for i in range(100_004)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:75_004])), (3, " ".join(words[:75_003]))]
    frame = spark.createDataFrame([(d, t, None, None, 0, None, 0, None, None, None) for d, t in docs], corpus.SCHEMA)
    assert _found(jaccard_join.jaccard_components(frame)) == {1: (100_000, 1), 2: (75_000, 1), 3: (74_999, 1)}
    apart = spark.createDataFrame([(d, t, None, None, 0, None, 0, None, None, None) for d, t in docs if d != 2], corpus.SCHEMA)
    assert {d: c for d, (_, c) in _found(jaccard_join.jaccard_components(apart)).items()} == {1: 1, 3: 3}


def test_a_tile_gives_fewer_links_than_members():
    import pyarrow as pa

    n = 60
    base = np.arange(100)
    sets = [np.sort(np.concatenate([base[: 95 + i % 3], 1000 + i * 10 + np.arange(3)])) for i in range(n)]
    sets += [np.sort(np.concatenate([base[:30], 5000 + i * 100 + np.arange(70)])) for i in range(20)]
    sig = jaccard_join._signatures(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.uint64), len(sets))
    ids = np.arange(len(sets))
    rows = {
        "node": ids, "n": np.array([len(s) for s in sets], np.int32), "root": ids, "side": np.zeros(len(ids), np.int32),
        "sig": pa.array([x.tobytes() for x in sig], pa.binary()), "same": np.ones(len(ids), bool),
        "ids": pa.array([tb.planes(np.diff(s, prepend=0)).tobytes() for s in sets], pa.binary()),
        "cnts": pa.array([tb.planes(np.ones(len(s), np.int32)).tobytes() for s in sets], pa.binary()),
    }
    got = jaccard_join.tile_links(pa.table(rows), 75).to_pydict()
    assert len(got["a"]) == n - 1
    reached = {0}
    for _ in range(n):
        reached |= {b for a, b in zip(got["a"], got["b"]) if a in reached} | {a for a, b in zip(got["a"], got["b"]) if b in reached}
    assert reached == set(range(n))


def test_a_worker_keeps_one_table_of_powers_a_seed():
    tb._POWERS.clear()
    values = np.arange(1, 300_001, dtype=np.uint64)
    whole = tb.Rolling(values)(np.arange(100), np.arange(100) + 50)
    for n in (10, 70_000, 200_000):
        assert (tb.Rolling(values[:n])(np.zeros(1, int), np.array([10])) == tb.Rolling(values)(np.zeros(1, int), np.array([10]))).all()
    assert (tb.Rolling(values)(np.arange(100), np.arange(100) + 50) == whole).all()
    assert list(tb._POWERS) == [0] and len(tb._POWERS[0][0]) == 1 << 19
