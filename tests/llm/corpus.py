"""A small corpus with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept string, n int, spans string, root long, score double"


def texts() -> dict[int, str | None]:
    """Null, empty, blank, short and long texts, copies, near copies, shared passages."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "der", "und", "les", "the", "naïve", "日本", "🙂x", "a,b", "Upper", "CASE"]
    pick = lambda n: [rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n)]
    base = pick(300)
    near = list(base)
    near[40] = "changed"
    near[200:202] = []
    far = list(base)
    far[::6] = pick(len(far[::6]))
    passage = pick(80)
    out: dict[int, str | None] = {1: None, 2: "", 3: "  \n\t ", 4: "one two three", 5: "ONE two three", 6: "..!! 12"}
    out |= {10: " ".join(base), 11: " ".join(base), 12: " ".join(near), 13: " ".join(far), 9: "\n".join(base)}
    out |= {20 + i: " ".join(pick(60 + i) + passage[i : 70 + i] + pick(30)) for i in range(6)}
    out |= {30: " ".join(passage + passage), 31: " ".join(["same"] * 400), 32: "x" * 5000, 33: "ab" * 300 + " end"}
    out |= {40: " ".join(pick(6000)), 41: "é" * 120 + "ü" * 10 + "é" * 120, 42: "Ünïcode " * 30, -7: " ".join(base[:120])}
    return out


def rows(extra: bool = True):
    langs = ["en", "de", None]
    out = []
    for i, (d, t) in enumerate(texts().items()):
        out.append((d, t, langs[i % 3], "s", len(t or ""), "clash", 1, "clash", 7, 0.5))
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def window_words(docs, size):
    first, found = {}, {}
    split = {d: (t or "").encode().split() for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        found[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return found


def repeated_bytes(docs, size):
    seen, found = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        found[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return found


def shingle_set(text, size=5):
    w = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def linked(docs, percent=75):
    sets = {d: shingle_set(t) for d, t in docs}
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
