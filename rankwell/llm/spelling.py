"""Spelling variants: which words of the vocabulary differ by one letter from another.

The vocabulary is an acceptor A of its words. Composed with a transducer E that makes
exactly one edit, and with A again, it accepts the pairs (x, y) of near words. The
composed machine is never built as a whole: it is cut at its initial states.

* A pair has one place where it first differs, the length of the common prefix. A word of
  ``m`` letters is looked at once for each stretch of places ``[lo, hi)``: what stands
  before ``lo`` and after ``hi`` is then the same in both words, so it is the key of a
  partition, and the two words without it are accepted from the partition's initial state.
* A partition with more than ``GROUP_ROWS`` words has its stretch halved, again and again:
  at a stretch of one place the alphabet bounds it. No key keeps more rows than that.
* In a partition the words become a minimised acceptor (states with equal futures are one
  state), and E is composed on the fly: follow equal letters, take one edit, then intersect
  the futures of the two states reached; each pair of states is met once and remembered.
* Every pair is accepted in just one partition, so counts and best partners are summed
  without listing pairs in a table.

Roots are found by pointer doubling: forms are at least twice as frequent as their words,
so chains are short.

Rows: a null text has no words; rows without ``doc_id`` are dropped; repeated rows count
each. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered
from .staging import staged

MIN_LETTERS = 5
MIN_COUNT = 3
HELD_WORDS = 200_000
STRETCH = 32
GROUP_ROWS = 8192

# Single bytes of Latin-1: the letters a-z and U+00C0 to U+00FF.
_RUNS = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LETTERS)


def runs_with_typos(doc_id: int, text: str) -> Iterator[tuple[bytes, int]]:
    """Words of a text as Latin-1 bytes and how often; a run whose hash 97 divides loses a letter.

    Letters beyond Latin-1 end a run as any other sign does, so they may become one.
    """
    prefix = zlib.crc32(b"%d:" % doc_id)
    for run, times in Counter(_RUNS.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if h % 97 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LETTERS:
                continue
        yield run, times


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n, id``: words that occur ``min_count`` times, numbered in code-point order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sums() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.record_batch([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if text:
                    for word, times in runs_with_typos(doc_id, text):
                        held[word] += times
                if len(held) >= HELD_WORDS:
                    yield sums()
                    held = Counter()
        if held:
            yield sums()

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    counted = rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return numbered(staged(counted.where(F.col("n") >= min_count), "vocabulary"), [F.col("word")])


def _keyed(rows: DataFrame) -> DataFrame:
    """The partition of each row ``(word, m, lo, hi)``: ``m`` letters, equal outside the stretch."""
    tail = F.greatest(F.lit(0), F.col("m") - F.col("hi"))
    before, after = F.expr("left(word, lo)"), F.expr("right(word, greatest(0, m - hi))")
    key = F.md5(F.concat_ws(" ", "m", "lo", "hi", before, after))
    middle = F.col("word").substr(F.col("lo") + 1, F.length("word") - F.col("lo") - tail)
    return rows.withColumn("key", F.unhex(key)).withColumn("middle", middle)


def _split(rows: DataFrame) -> DataFrame:
    """Each stretch as its two halves."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return rows.withColumn("x", F.explode(halves)).withColumn("lo", F.col("x.lo")).withColumn("hi", F.col("x.hi")).drop("x")


def partitions(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``key, end, long, middle, id, n``: every word of ``words (word, n, id)`` in its partitions.

    A word takes part as the shorter (or equal) one of a pair, and with ``long`` as the
    longer one. Stretches start as halves of a word, or pieces of ``STRETCH`` places; ``end``
    marks the one that reaches past the last letter.
    """
    size = F.length("word")
    sides = words.withColumn("m", F.explode(F.array(size, size - 1))).where(F.col("m") >= MIN_LETTERS)
    pieces = F.greatest(F.lit(2), F.ceil((F.col("m") + 1) / STRETCH)).cast("int")
    cut = sides.withColumn("pieces", pieces).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    def edge(i: Column) -> Column:
        return F.floor(i * (F.col("m") + 1) / F.col("pieces")).cast("int")

    rows = cut.withColumn("lo", edge(F.col("i"))).withColumn("hi", edge(F.col("i") + 1))
    rows = _keyed(rows.select("word", "n", "id", "m", "lo", "hi"))
    done = None
    while True:
        large = staged(rows.groupBy("key", (F.col("hi") - F.col("lo")).alias("places")).count().where((F.col("count") > group_rows) & (F.col("places") > 1)), "large")
        if large.isEmpty():
            break
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionAll(small)
        rows = staged(_keyed(_split(rows.join(large, "key", "left_semi"))), "halved")
    done = rows if done is None else done.unionAll(rows)
    return done.select("key", (F.col("hi") > F.col("m")).alias("end"), (F.length("word") > F.col("m")).alias("long"), "middle", "id", "n")


class Acceptor:
    """Minimised acceptors of sets of words of equal length, with one register of states.

    A state is its arcs (letter to state); state 0 ends a word. Two sets share states, so
    equal futures are equal states across them.
    """

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.register: dict[tuple, int] = {(): 0}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
        return found

    def add(self, words: list[str]) -> int | None:
        """Initial state of the acceptor of ``words``, sorted, distinct and of one length."""
        if not words:
            return None
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            while len(path) - 1 > common:
                done = self._state(path.pop())
                path[-1][last[len(path) - 1]] = done
            path += [{} for _ in range(len(word) - common)]
            last = word
        while len(path) > 1:
            done = self._state(path.pop())
            path[-1][last[len(path) - 1]] = done
        return self._state(path[0])

    def common(self, s: int, t: int) -> list[str]:
        """Words accepted from both states."""
        key = (s, t) if s < t else (t, s)
        found = self.shared.get(key)
        if found is None:
            if s == 0 or t == 0:
                found = [""] if s == t else []
            else:
                other = self.arcs[t]
                found = [c + z for c, u in self.arcs[s].items() if c in other for z in self.common(u, other[c])]
            self.shared[key] = found
        return found


def near_pairs(shorter: list[str], longer: list[str], end: bool = True) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart: two of ``shorter``, or one of it and one of ``longer``.

    The composition A . E . A, walked from its initial state: equal letters keep both
    tapes in one state, then E replaces a letter or puts one in, then the futures meet.
    An inserted letter differs from the one it stands before, which makes the edit's place
    the first difference and each pair unique. Only the stretch at the ``end`` of words may
    take one after the last letter; elsewhere that place is the next stretch's first.
    """
    machine = Acceptor()
    first, second = machine.add(sorted(shorter)), machine.add(sorted(longer))
    if first is None:
        return
    stack: list[tuple[int, int | None, str]] = [(first, second, "")]
    while stack:
        q, r, before = stack.pop()
        out = list(machine.arcs[q].items())
        for i, (c, s) in enumerate(out):
            for d, t in out[i + 1 :]:
                for z in machine.common(s, t):
                    yield before + c + z, before + d + z
        more = machine.arcs[r] if r is not None else {}
        for d, t in more.items() if q or end else ():
            for z in machine.common(q, t):
                if z[:1] != d:
                    yield before + z, before + d + z
        for c, s in out:
            stack.append((s, more.get(c), before + c))


def near_words(parts: DataFrame) -> DataFrame:
    """``id, n_near, best``: number of near words, and the count and id of the best one."""

    def tell(rows: list[tuple[bool, bool, str, int, int]]) -> dict[int, tuple[int, int, int]]:
        known = {(long, middle): (i, n) for _, long, middle, i, n in rows}
        found: dict[int, list[int]] = {}

        def meet(i: int, n: int, other: int) -> None:
            cell = found.setdefault(i, [0, 0, 0])
            cell[0] += 1
            if (n, -other) > (cell[1], -cell[2]) or cell[0] == 1:
                cell[1], cell[2] = n, other

        short = [m for _, long, m, _, _ in rows if not long]
        size = len(short[0]) if short else 0
        for x, y in near_pairs(short, [m for _, long, m, _, _ in rows if long], rows[0][0]):
            (i, n), (j, k) = known[False, x], known[len(y) > size, y]
            meet(i, k, j)
            meet(j, n, i)
        return {i: tuple(c) for i, c in found.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def told() -> pa.RecordBatch:
            cells = list(zip(*out))
            return pa.record_batch([pa.array(c, pa.int64()) for c in cells], names=["id", "near", "n", "best"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "end", "long", "middle", "id", "n")]
            for k, *row in zip(*columns):
                if k != key:
                    if len(group) > 1:
                        out += [(i, *c) for i, c in tell(group).items()]
                    key, group = k, []
                    if len(out) > 100_000:
                        yield told()
                        out = []
                group.append(tuple(row))
        if len(group) > 1:
            out += [(i, *c) for i, c in tell(group).items()]
        if out:
            yield told()

    dealt = parts.repartition(F.col("key")).sortWithinPartitions("key")
    told = dealt.mapInArrow(work, "id long, near long, n long, best long")
    best = F.max(F.struct("n", (-F.col("best")).alias("best")))
    return told.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "id", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.best")).alias("form_id")
    )


def roots(links: DataFrame) -> DataFrame:
    """``id, root_id`` of ``links (id, form_id)``, which never turn back: pointer doubling."""
    now = staged(links.select("id", F.col("form_id").alias("root_id")), "forms")
    while True:
        ahead = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        joined = staged(now.join(ahead, "root_id", "left"), "doubled")
        if joined.where("next is not null").isEmpty():
            return now
        now = joined.select("id", F.coalesce("next", "root_id").alias("root_id"))


def spelling_variants(docs: DataFrame, min_count: int = MIN_COUNT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = staged(vocabulary(docs, min_count), "words")
    near = staged(near_words(partitions(words, group_rows)), "near")
    counted = words.join(near, "id", "left")
    form = F.col("form_n") >= 2 * F.col("n")
    links = counted.where(form).select("id", "form_id", "form_n")
    followed = links.join(roots(links), "id")
    named = followed.join(words.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id")
    named = named.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id")
    found = words.join(near.select("id", "n_near"), "id", "left").join(named.select("id", "form", "root", "form_n"), "id", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
