"""PII, phrases and spelling variants against brute force."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from corpus import SCHEMA, frame, rows, texts

from rankwell.llm import char_tagger, phrases, pii, spelling
from rankwell.llm.staging import ship

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# --- personal data -------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                if not 12 <= len(digits) <= 19 or sum(x - 9 if x > 9 else x for x in doubled) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


CASES = [
    "", "no data at all", "a@b.c@d.e", "a@b.c_d@e.f x@y", "@a.b", "é.b@c-d.e.f.", "A%+-_.@x.y.", "a@@b.c a@b..c", "1.2.3.4.5.6.7.8.9",
    "256.1.1.1 01.002.0255.3", "1..2.3.4.5", "4111 1111 1111 1111", "4111-1111--1111 1111", "x4111111111111111y 5", "79927398713 0000000000000000",
    "+1 (017) 555-7713", "+1 2", "+12345678", "++49 30 1234567 .", "+1 (017) 555-7713 +1 (017) 555-7713", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7",
    "mail x@mail.example.com ip 10.0.0.1, +1 (243) 555-5526 card 4012888888881881", "🙂 ü@a.b 🙂x@a.b", "\n1.1.1.1\n",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_random_texts_equal_the_patterns():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("@.-+ ()0123a_%é1"), int(rng.integers(1, 60))))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["x" * 400_000, "@" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000])
def test_base_spans_take_linear_time(text):
    pii.base_spans(text)


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    w = char_tagger.start_weights(3, 4)
    x, y = rng.integers(0, 20, (7, 5)), rng.integers(0, 3, (7, 5))
    _, gradient = char_tagger.loss_and_gradient(w, x, y)
    for k, a in enumerate(w):
        place = (1, int(x[2, 1]), 3) if k == 0 else tuple(int(rng.integers(0, s)) for s in a.shape)
        old, step = a[place], 1e-5
        sides = []
        for d in (step, -step):
            a[place] = old + d
            sides.append(char_tagger.loss_and_gradient(w, x, y)[0])
        a[place] = old
        assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(gradient[k][place], rel=1e-4, abs=1e-7)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    w = char_tagger.start_weights(3, 4)
    w = w._replace(step=rng.normal(0, 1, (3, 3)), first=rng.normal(0, 1, 3), last=rng.normal(0, 1, 3))
    decoder = char_tagger.Decoder(w)
    x = rng.integers(0, 60, (5, 8))
    scores, found = decoder.scores(x), decoder.decode(x)
    for n in range(8):
        paths = np.stack(np.meshgrid(*[range(3)] * 5, indexing="ij"), axis=-1).reshape(-1, 5)
        value = w.first[paths[:, 0]] + w.last[paths[:, -1]] + sum(scores[t, n][paths[:, t]] for t in range(5))
        value = value + sum(w.step[paths[:, t], paths[:, t + 1]] for t in range(4))
        assert found[:, n].tolist() == paths[value.argmax()].tolist()


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(2)
    words = "the of and letter about road write please number under server card".split()
    passages = []
    for _ in range(240):
        digits = "".join(rng.choice(list("0123456789"), 10))
        kind = int(rng.integers(4))
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        cell = (f"{rng.choice(words)}.{digits[:2]}@mail{digits[2]}.example.com", ip, f"4{digits}{digits[:5]}", f"+1 ({digits[:3]}) 555-{digits[3:7]}")[kind]
        head = " ".join(rng.choice(words, 5)) + " "
        passages.append((head + cell + " " + " ".join(rng.choice(words, 4)), [(len(head), kind, len(head) + len(cell))]))
    return pii.fit(passages, steps=200)


def test_tagger_finds_disguised_data_and_leaves_plain_text(spark, weights):
    held = {
        1: "please write to road.42 (at) mail7 (dot) example (dot) com about the letter",
        2: "under server 10[.]20[.]30[.]40 and road",
        3: "number of the road 555 and letter 12 about 2019",
        4: "write (243) 555-5526 please and +1 (243) 555-7777 about",
    }
    docs = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    got = {r["doc_id"]: [(held[r["doc_id"]][s.start : s.end], s.kind, s.base) for s in r["spans"]] for r in pii.find_spans(docs, weights).collect()}
    assert ("road.42 (at) mail7 (dot) example (dot) com", "email", False) in got[1]
    assert ("10[.]20[.]30[.]40", "ip", False) in got[2]
    assert got[3] == []
    assert ("+1 (243) 555-7777", "phone", True) in got[4]


def test_windows_agree_with_the_text_as_a_whole(weights):
    decoder = char_tagger.Decoder(weights)
    text = ("please write to road.42 (at) mail7 (dot) example (dot) com about the letter and the road under it " * 30)[:2500]
    codes = char_tagger.symbols(np.array([ord(c) for c in text]))
    whole = decoder.decode(codes[:, None].astype(np.int64))[:, 0]
    bounds = np.array([0, len(codes)])
    cut = pii.window_tags(codes, bounds, decoder)
    assert (cut != whole).mean() < 0.01
    assert len(pii._runs(cut, bounds)[0]) == len(pii._runs(whole, bounds)[0])


def test_pii_digest_on_awkward_rows(spark, weights):
    some = rows() + [(50, "x@y.z and 1.2.3.4", "en", "s", 1, "c", 1, "c", 1, 0.1)] * 2
    found = pii.digest(pii.find_spans(frame(spark, some), weights)).collect()
    assert len(found) == len(some)
    by_id = {r["doc_id"]: r for r in found}
    for doc_id, text in [*texts().items(), (50, "x@y.z and 1.2.3.4")]:
        spans = plain_spans(text or "")
        row = by_id[doc_id]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(1 for s in spans if s[1] == i) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))


def test_pii_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.labelled_passages(empty) == [] and pii.fit([]) is None
    assert pii.digest(pii.find_spans(empty, None)).count() == 0
    one = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    assert pii.digest(pii.find_spans(one, None)).first()["spans"] == "email:0:5"


# --- phrases -------------------------------------------------------------------------


def plain_phrases(docs, min_count, top, longest=4):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    held = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    inside = collections.Counter()
    for (lang, w), a in held.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    found = collections.defaultdict(list)
    for (lang, w), a in held.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = set()
    for lang, rows_ in found.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def wordy(n_docs=60, seed=4):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Ünder", "New", "YORK", "日本"]
    weight = 1 / np.arange(1, len(vocab) + 1)
    out = []
    for i in range(n_docs):
        words = list(rng.choice(vocab, 300, p=weight / weight.sum()))
        for j in range(5, 295, 23):
            words[j : j + 4] = ["New", "York", "city", "hall"] if j % 2 else ["a\tb", "c", "c", "c"]
        ends = rng.choice([" ", "  ", " ", ". ", "\n", ",", "\t"], len(words), p=[0.6, 0.05, 0.15, 0.05, 0.05, 0.05, 0.05])
        out.append((["en", "de", None][i % 3], "".join(w + e for w, e in zip(words, ends))))
    return [*out, ("en", None), ("fr", ""), ("fr", " ., "), (None, "x"), out[0], out[0]]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    docs = wordy()
    if small:  # several rounds of sums
        monkeypatch.setattr(phrases, "FAN", 2)
    frame_ = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string")
    got = phrases.collocations(frame_.repartition(7 if small else 2), 8, 40).collect()
    assert {tuple(r) for r in got} == plain_phrases(docs, 8, 40)
    assert len(got) == len({(r["lang"], r["rank"]) for r in got})


def test_sparse_and_dense_tiles_count_alike():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 9000, (2, 20_000)) ** 2 % 9000
    times = rng.integers(1, 5, 20_000)
    want = collections.Counter()
    for a, b, n in zip(left.tolist(), right.tolist(), times.tolist()):
        want[a, b] += n
    homes = phrases._homes(left, right, 3)
    got = {}
    for home in np.unique(homes):
        at = np.flatnonzero(homes == home)
        batches = [phrases._row(phrases.ENTRY, int(home), 0, *(x[p].astype(np.int64) for x in (left, right, times))) for p in np.array_split(at, 3)]
        for a, b, n in zip(*(x.tolist() for x in phrases._sums(int(home), iter(batches)))):
            assert (a, b) not in got
            got[a, b] = n
    assert got == dict(want) and (homes < 0).any() and (homes >= 0).any()


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(frame(spark), 10_000).count() == 0


# --- spelling ------------------------------------------------------------------------


def plain_variants(docs, min_count=3):
    counts = collections.Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in vocab if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in vocab}
    form = {}
    for w in vocab:
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best and vocab[best] >= 2 * vocab[w] else None
    out = set()
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, vocab[w], len(near[w]), vocab.get(form[w])))
    return out


def misspelt(seed=6):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéÿ×")
    vocab = ["".join(rng.choice(letters[:3], int(rng.integers(4, 8)))) for _ in range(150)]
    vocab += ["".join(rng.choice(letters, int(rng.integers(5, 12)))) for _ in range(60)] + ["Straße", "straße", "strasse", "aaaaa", "aaaaaa", "aaaaaaa"]
    vocab += [v[:3] + "x" + v[3:] for v in vocab[150:190]] + ["z" * 90, "z" * 91, "z" * 40 + "y" + "z" * 50, "ab" * 300, "ab" * 299 + "aa"]
    weight = 1 / np.arange(1, len(vocab) + 1) ** 0.5
    out = []
    for i in range(80):
        words = rng.choice(vocab, 120, p=weight / weight.sum())
        out.append((i * 37, " ".join(words) + "日本straßeŁabcab " + "_".join(words[:9])))
    return [*out, (5, None), (6, ""), (-4, out[0][1]), out[1], out[1]]


@pytest.mark.parametrize("group_rows", [spelling.GROUP_ROWS, 6])
def test_variants_equal_brute_force(spark, group_rows):
    docs = misspelt()
    frame_ = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(None, "lostword " * 9, "x", 1)], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.spelling_variants(frame_, group_rows=group_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs)
    assert sum(1 for r in got if r[1]) > 20 and max(r[4] for r in got) > 4


def test_pairs_of_one_partition_are_unique():
    rng = np.random.default_rng(8)
    three = {"".join(rng.choice(list("ab"), 4)) for _ in range(14)}
    four = {"".join(rng.choice(list("ab"), 5)) for _ in range(25)}
    got = list(spelling.near_pairs(sorted(three), sorted(four)))
    want = {frozenset((a, b)) for a in three for b in three if sum(x != y for x, y in zip(a, b)) == 1}
    want |= {frozenset((a, b)) for a in three for b in four if any(b[:i] + b[i + 1 :] == a for i in range(5))}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_equal_futures_are_one_state():
    machine = spelling.Acceptor()
    machine.add(sorted(a + b for a in "pqrs" for b in ("ing", "ong", "ung")))
    assert len(machine.arcs) == 5  # one state for each letter left


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(frame(spark), 10_000).count() == 0
