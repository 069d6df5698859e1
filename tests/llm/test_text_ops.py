"""Language ID, quality, codec, token files, decontamination and chat formatting."""

import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from rankwell.llm import chat_format, decontaminate, language_id, quality, sentencepiece_codec, token_files  # noqa: E402
from rankwell.llm.queries import QUERIES, tokenizer_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PIECES = tokenizer_path("piece_bpe_32k.model")
BYTES = tokenizer_path("byte_bpe_50k.json")


# --- SentencePiece -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoding_equals_the_library(library):
    rng = np.random.default_rng(2)
    kinds = ["a ▁", "abcde  \n", "the in  er", "é日🙂a \n\t▁\x00", "<s></>0x41 "]
    for i in range(4000):
        kind = list(kinds[i % len(kinds)])
        text = "".join(rng.choice(kind, rng.integers(0, 60)))
        ids = np.frombuffer(sentencepiece_codec.encode_text(text, PIECES), np.int32)
        assert ids.tolist() == library.encode(text), repr(text)
        assert sentencepiece_codec.decode_ids(ids, np.array([0, len(ids)]), PIECES) == [library.decode(ids.tolist())]


@pytest.mark.parametrize("ids", [[131], [233, 154], [233, 154, 168, 264], [264, 258, 243, 162], [28705, 264], [1, 264, 2], []])
def test_decoding_any_ids_equals_the_library(library, ids):
    got = sentencepiece_codec.decode_ids(np.array(ids, np.int32), np.array([0, len(ids)]), PIECES)
    assert got == [library.decode(ids)]


def test_a_long_text_without_a_space_takes_linear_time(library):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400_000))
    began = time.process_time()
    ids = np.frombuffer(sentencepiece_codec.encode_text(text, PIECES), np.int32)
    assert time.process_time() - began < 10
    assert ids.tolist() == library.encode(text)


def test_one_pass_encodes_and_decodes(spark):
    docs = corpus.frame(spark)
    both = sentencepiece_codec.encode(docs, PIECES, decoded="kept")
    apart = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES)
    assert [f for f in both.columns if f != "kept"] == [f for f in apart.columns if f not in ("kept", "decoded")]
    assert {(r["doc_id"], tuple(r["ids"]), r["kept"]) for r in both.collect()} == {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in apart.collect()}


def test_codec_keeps_columns_and_edge_cases(spark, library):
    docs = corpus.frame(spark)
    encoded = sentencepiece_codec.encode(docs, PIECES)
    got = {r["doc_id"]: r for r in sentencepiece_codec.decode(encoded, PIECES).collect()}
    assert encoded.columns == [*docs.columns, "ids"]
    for d, text in corpus.texts().items():
        assert got[d]["ids"] == library.encode(text or "") and got[d]["decoded"] == library.decode(got[d]["ids"])
        assert got[d]["kept"] == "clash"
    assert sentencepiece_codec.encode(corpus.frame(spark, []), PIECES).count() == 0


def test_backtracking_equals_merging():
    pieces = sentencepiece_codec.Pieces(PIECES)
    rng = np.random.default_rng(4)
    for _ in range(500):
        text = "".join(rng.choice(list("▁theinrao"), rng.integers(1, 24)))
        if "▁" in text.lstrip("▁"):
            continue
        assert [pieces.texts[i] for i in pieces._backtrack(text)] == pieces.merged(text)


# --- token files ---------------------------------------------------------------------


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    shards = token_files.write_shards(corpus.frame(spark), BYTES, shard_tokens=700)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_documents(shards).collect()}
    at = 0
    for d, text in sorted(corpus.texts().items()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes())), d
        at += len(ids)
    assert token_files.read_documents(token_files.write_shards(corpus.frame(spark, []), BYTES)).count() == 0


def test_words_equal_the_library():
    words = token_files.Words(BYTES)
    texts = ["a  b", " lead", "trail ", "x\n y", "x \n y", "don't  stop　x", "a  b", "a\n  b", "<|endoftext|> a", "a<|endoftext|>", "\t", "", "a\tb  c", "a\t \tc d", "one\ntwo three\nfour", "a\x1cb c"]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint16).tolist() for x in words.encode(texts)] == want


def test_words_put_together_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    words = token_files.Words(BYTES)
    rng = np.random.default_rng(3)
    stems = ["house", "Straße", "été", "don", "it", "a", "ªµ", "über", "дом", "数据", "e\u0301t", "x²", "Ǆ", "ɐb", "42nd", ""]
    tails = ["", ",", "'s", "'ll!", "'", "...", "-house", "_a", "###", "(s)", ".5", "’s", "é", "\U0001f600", "'sa", "/été/"]
    texts = []
    for _ in range(60):
        some = [stems[i] + tails[j] for i, j in zip(rng.integers(0, 16, 30), rng.integers(0, 16, 30))]
        gaps = rng.choice([" ", " ", " ", "\n"], 30).tolist()
        texts.append("".join(x for pair in zip([w for w in some if w], gaps) for x in pair)[:-1])
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = [x for a in range(0, 60, 7) for x in words.encode(texts[a : a + 7])]
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == want
    assert words.encode([]) == []


def test_words_met_again_are_learnt_once(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    words = token_files.Words(BYTES)
    learnt = []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learnt.extend(new), learn(new)))
    for i in range(40):
        words.encode([f"the house, the hill {' '.join(f'w{i}x{j}' for j in range(20))}"])
        assert len(words.known) + len(getattr(words, "old", ())) < 200
    assert learnt.count("house,") == learnt.count("hill") == 1 and len(learnt) == 804


def test_the_library_sees_letters_once():
    words = token_files.Words(BYTES)
    pieces = []
    lettered = words._lettered
    words._lettered = lambda new: (pieces.extend(new), lettered(new))[1]
    words.encode(["a garden garden, garden; garden's (garden) garden-hose"])
    words.encode(["a garden!"])
    assert pieces.count("garden") == 1


def test_repair_random_access():
    ids = (np.random.default_rng(0).zipf(1.4, 30_000) % 3000).astype(np.uint16)
    bounds = np.array([0, 10, 10, 9000, 30_000])
    parts = token_files.compress(ids, bounds, 50_257)
    assert len(parts[0]) < 0.8 * len(ids) and len(parts[2]) > 20
    row = {"doc_ids": np.arange(4).tobytes(), "bounds": parts[1].tobytes(), "symbols": parts[0].tobytes()}
    shard = token_files.Shard(row | {"rules": parts[2].tobytes(), "lengths": parts[3].tobytes(), "base": 50_257})
    for i in range(4):
        assert (shard.document(i) == ids[bounds[i] : bounds[i + 1]]).all()
    for a, b in ((0, 1), (5, 9001), (29_990, 30_000), (123, 123)):
        assert (shard.tokens(a, b) == ids[a:b]).all()


# --- language ID ---------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, SMALL).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()


def test_mixed_text_gets_spans(spark):
    train = spark.createDataFrame(
        [(1, "the cat and the dog with this that " * 20, "en"), (2, "der hund und die katze nicht ein " * 20, "de"), (3, "кот и собака это не что " * 20, "ru"), (4, "zzz", None)],
        "doc_id long, text string, lang string",
    )
    model = language_id.fit(train)
    text = "the cat and the dog that was with this der hund und die katze nicht ein hund und кот и собака"
    rows = [(1, text), (2, None), (3, ""), (4, "123 !? …"), (5, "кот"), (5, "кот")]
    got = language_id.label(spark.createDataFrame(rows, "doc_id long, text string"), model, switch=4.0).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and [s["lang"] for s in by_id[1]["spans"]] == ["en", "de", "ru"]
    assert [by_id[i]["lang_pred"] for i in (2, 3, 4, 5)] == ["und", "und", "und", "ru"] and by_id[4]["score"] == 0


def test_without_labels_all_is_unknown(spark):
    docs = corpus.frame(spark)
    got = language_id.language_id(docs, docs.where("lang = 'none'"))
    assert {r["lang_pred"] for r in got.collect()} == {"und"} and got.count() == len(corpus.texts())
    assert language_id.language_id(docs.limit(0), docs).count() == 0


def test_viterbi_equals_trying_all_paths():
    from itertools import product

    scores = np.random.default_rng(1).normal(size=(7, 3))
    bounds = np.array([0, 4, 4, 7])
    got = language_id.viterbi(scores, bounds, 0.7)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue

        def value(path):
            return sum(scores[a + i, s] for i, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))

        best = max(product(range(3), repeat=b - a), key=value)
        assert value(got[a:b].tolist()) == pytest.approx(value(best))


# --- quality -------------------------------------------------------------------------


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, bounds, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    shapes = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": ()}
    w = {k: rng.normal(size=s) for k, s in shapes.items()}

    def loss(w):
        p = quality._forward(x, bounds, w)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, grad in quality._gradients(x, bounds, y, w).items():
        at = tuple(0 for _ in shapes[k])
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert np.asarray(grad)[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), k


def test_quality_finds_junk_and_edge_cases(spark):
    rng = np.random.default_rng(3)
    good = ["".join(rng.choice(list("abcdefg ."), 900)) for _ in range(60)]
    junk = ["".join(rng.choice(list("#$%ab| "), 900)) for _ in range(60)]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(good + junk)]
    labelled = spark.createDataFrame(rows + [(500, "x", None)], "doc_id long, text string, quality int")
    model = quality.fit(labelled)
    got = {r["doc_id"]: r["score"] for r in quality.score(labelled, model).collect()}
    assert np.mean([(got[i] > 0.5) == (i < 60) for i in range(120)]) > 0.95
    odd = quality.score(corpus.frame(spark), model).collect()
    assert len(odd) == len(corpus.texts()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.fit(labelled.limit(0)).prior == 0.5
    assert quality.score(corpus.frame(spark, []), model).count() == 0


# --- decontamination -----------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_stay(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(500)]
    pick = lambda n: list(rng.choice(vocabulary, n))
    items = {i: pick(40) for i in range(5)}
    edited = list(items[1])
    edited[7] = "changed"
    edited[20:21] = []
    edited.insert(30, "added")
    docs = [(1, " ".join(pick(100) + items[0] + pick(100))), (2, " ".join(pick(50) + edited)), (3, " ".join(pick(400)))]
    docs += [(4, None), (5, ""), (6, " ".join(items[2][:8] + pick(90))), (7, "tiny item"), (8, " ".join(items[3]).upper())]
    docs += [(100 + i, " ".join(items[4])) for i in range(40)]
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, " . "), (52, "Tiny item!"), (None, "x y z")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string")
    tests = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_matches(frame, tests).collect()}
    assert set(got) == {(1, 0), (2, 1), (7, 52), (8, 3), *((100 + i, 4) for i in range(40))}
    assert got[1, 0] == 1 and 0.8 < got[2, 1] < 1
    kept = decontaminate.decontaminated(frame, tests)
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6} and kept.columns == frame.columns
    assert decontaminate.find_matches(frame.limit(0), tests).count() == 0
    assert decontaminate.find_matches(frame, tests.limit(0)).count() == 0


@pytest.mark.parametrize("beside", [False, True])
def test_copies_with_many_edits_are_found(spark, beside):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    pick = lambda n: list(rng.choice(vocabulary, n))
    item = pick(40)
    docs = {}
    for n in (3, 4, 5, 6):
        edited = [f"new{n}x{i}" if i % n == n - 1 else w for i, w in enumerate(item)]
        docs[n] = " ".join(pick(60) + edited + pick(60))
    docs[7] = " ".join(pick(60) + [x for i, w in enumerate(item) for x in ([w, f"add{i}"] if i % 2 else [w])] + pick(60))
    docs[8] = " ".join(pick(60) + [w for i, w in enumerate(item) if i % 3] + pick(60))
    docs[9] = " ".join(pick(60) + item[20:] + pick(60))
    docs |= {20: " ".join(item[:19]), 21: " ".join(pick(300)), 22: " ".join(sorted(item)), 23: " ".join(w for i, w in enumerate(item) for _ in range(3))}
    if beside:
        docs |= {30 + i: " ".join(item) for i in range(5)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.find_matches(frame, bench).collect()}
    hashes = {d: next(decontaminate._hashed_words(pa.array([t]), 1 << 20))[1] for d, t in (docs | {0: " ".join(item)}).items()}
    scores = {d: decontaminate.align([hashes[d]], hashes[0])[0] / 80 for d in docs}
    assert {3, 4, 5, 6, 7, 8, 9} <= set(got)
    assert got == {d: s for d, s in scores.items() if s >= 0.5}


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(20):
        item = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64)
        texts = [rng.integers(0, 5, n).astype(np.uint64) for n in (1, 4, 12)]
        want = []
        for t in texts:
            h = np.zeros((len(item) + 1, len(t) + 1), int)
            for i in range(1, len(item) + 1):
                for j in range(1, len(t) + 1):
                    match = 2 if item[i - 1] == t[j - 1] else -1
                    h[i, j] = max(0, h[i - 1, j - 1] + match, h[i - 1, j] - 1, h[i, j - 1] - 1)
            want.append(h.max())
        assert decontaminate.align(texts, item).tolist() == want


# --- chat ----------------------------------------------------------------------------


def test_marked_transcripts_are_recovered(spark):
    turns = [(c, t, r, x) for c in range(12) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hello\nare you there?"), ("assistant", "Yes.\n\nIndeed: I am."), ("user", "Good")])]
    frame = spark.createDataFrame(turns + [(99, 0, "user", None), (98, 0, None, "x")], "conv_id long, turn long, role string, text string")
    model = chat_format.fit(frame)
    for style in range(4):
        texts = chat_format.transcripts(frame.where("conv_id < 12"), F.lit(style))
        got = chat_format.format_transcripts(texts, model, ["conv_id", "true_roles"]).collect()
        assert all(r["roles"] == r["true_roles"] and r["n_turns"] == 4 for r in got)
        assert got[0]["rendered"].startswith("<|system|>\nBe kind.\n<|end|>\n<|user|>\nHello\nare you there?\n<|end|>\n")
    assert chat_format.parse(None, model) == [] and chat_format.parse("", model) == []
    assert chat_format.transcripts(frame.limit(0)).count() == 0
    assert len(chat_format.parse("just a line", model)) == 1


def test_marks():
    assert chat_format.marker("User: hi") == (1, "hi") and chat_format.marker("### Assistant") == (2, "")
    assert chat_format.marker("Note: hi") == (chat_format.NONE, "Note: hi") and chat_format.marker("- hi")[0] == chat_format.OTHER
