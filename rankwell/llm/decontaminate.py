"""Benchmark decontamination: find test items in training texts, also edited copies.

1. The words of all items are counted over all documents. A copy that reaches the score
   holds at least ``min_score`` of an item's words, so of any choice that leaves out fewer,
   it holds some: an item keeps as seeds its rarest words that occur at all, just so many
   that every such copy holds ``HITS`` of them (fewer only for very short items). The
   choice is by rank inside the item, so one that leaked a million times is still found,
   and words that edits destroyed take no place in it.
2. Places where a document holds a seed are joined with the item; ``HITS`` places within the
   reach of one copy make a passage. Passages with too few words of the item are out.
3. Smith-Waterman alignment of passage and item over words (match 2, mismatch and gap -1)
   scores the passage: the best local score by the score of the whole item. Changed,
   dropped and added words only lower it.

Steps 1 and 2 lose no document and item that step 3 would score at ``min_score`` or more.

Words are runs of letters and digits of the lower-cased text; every byte beyond ASCII
counts as a letter.

The items come to the tasks in blocks of bounded bytes, one scan of the documents a block.

Rows: null or empty texts match nothing; items without words match nothing; an item
shorter than ``GRAM`` words is one seed, the whole item. Equal items each match. Rows without id are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .staging import ship

GRAM = 3
HITS = 4
MIN_SCORE = 0.5
BLOCK_BYTES = 8 << 20
MATCH, OTHER, GAP = 2, -1, -1
FILTER_BITS = 22
ALIGN_CELLS = 1 << 22
HELD_ROWS = 1 << 20
MATCHES = "doc_id long, item_id long, score double, first_word int, last_word int"


def _gaps() -> np.ndarray:
    gap = np.ones(256, bool)
    gap[48:58] = gap[65:91] = gap[97:123] = gap[128:] = False
    return gap


def _hashed_words(column: pa.Array, limit: int) -> Iterator[tuple[tb.Texts, np.ndarray, np.ndarray]]:
    """Blocks of lower-cased texts: word hashes, and where each document's words begin."""
    for block in tb.blocks(pc.utf8_lower(column), limit):
        start, end, bounds = tb.words(block, _gaps())
        yield block, tb.word_hashes(block, start, end), bounds


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    return tb.Rolling(words, 4).grams(size)


class Seeds(NamedTuple):
    """Items of a block and their seeds.

    ``items``: word hashes of each item; ``grams``: sorted distinct hashes of their words
    (of a short item, the whole); ``bounds``, ``item``, ``place``: for each gram the items
    that have it as a seed and where; ``held``, ``times``: sorted keys of item and gram, and
    how often the item holds the gram; ``least``: words a copy must hold; ``need``: seeds
    among them; ``extra``: words that a copy may have more than the item.
    """

    ids: np.ndarray
    items: list[np.ndarray]
    grams: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    held: np.ndarray
    times: np.ndarray
    least: np.ndarray
    need: np.ndarray
    extra: np.ndarray
    short: list[int]
    sieve: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a gram, and the gram's number."""
        cell = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        at = np.flatnonzero(self.sieve[cell])
        if not len(at):
            return at, at
        number = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        ok = self.grams[number] == hashes[at]
        return at[ok], number[ok]


def _least(words: int, size: int, min_score: float) -> int:
    """Words of an item that each copy of ``min_score`` holds; of a short item, the one seed."""
    return max(1, ceil(min_score * words - 1e-9)) if words >= size else 1


def _seeds(ids: np.ndarray, items: list[np.ndarray], size: int, min_score: float, counts: np.ndarray | None = None) -> Seeds:
    """Items with their rarest words by ``counts`` of all grams as seeds; without, no seeds."""
    found = [_grams(w, 1 if len(w) >= size else len(w)) if len(w) else np.zeros(0, np.uint64) for w in items]
    lengths = np.array([len(f) for f in found], np.int64)
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    unique, number = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(items)), lengths)
    held, times = np.unique(owner * max(len(unique), 1) + number, return_counts=True)
    words = np.array([len(w) for w in items], np.int64)
    least = np.array([_least(n, size, min_score) for n in words.tolist()], np.int64)
    need = np.minimum(HITS, least)
    chosen = [np.zeros(0, np.int64)]
    ends = np.cumsum(lengths)
    for i in range(len(items) if counts is not None else 0):
        own = counts[number[ends[i] - lengths[i] : ends[i]]]
        there = int((own > 0).sum())
        if there >= least[i]:
            rare = np.argsort(own, kind="stable")[len(own) - there :][: there - least[i] + need[i]]
            chosen.append(ends[i] - lengths[i] + np.sort(rare))
    at = np.concatenate(chosen)
    at = at[np.argsort(number[at], kind="stable")]
    sieve = np.zeros(1 << FILTER_BITS, bool)
    sieve[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Seeds(
        ids,
        items,
        unique,
        np.searchsorted(number[at], np.arange(len(unique) + 1)),
        owner[at],
        at - (ends - lengths)[owner[at]],
        held,
        times,
        least,
        need,
        np.array([floor(2 * n * (1 - min_score) + 1e-9) if n >= size else 0 for n in words.tolist()], np.int64),
        sorted({n for n in words.tolist() if 1 < n < size}),
        sieve,
    )


def _hits(words: np.ndarray, bounds: np.ndarray, seeds: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """Places (of words) and numbers of all grams of items inside documents."""
    places, numbers = [], []
    for k in [1, *seeds.short]:
        at, number = seeds.find(_grams(words, k))
        doc = np.searchsorted(bounds, at, side="right") - 1
        ok = at + k <= bounds[doc + 1]
        places.append(at[ok])
        numbers.append(number[ok])
    place, number = np.concatenate(places), np.concatenate(numbers)
    order = np.argsort(place, kind="stable")
    return place[order], number[order]


def gram_counts(docs: DataFrame, seeds: Seeds) -> np.ndarray:
    """How often each gram of ``seeds`` occurs in all documents; one short row a gram."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(sent.value.grams), np.int64)
        for batch in batches:
            for _, words, bounds in _hashed_words(batch.column("text"), tb.BLOCK_BYTES):
                _, number = _hits(words, bounds, sent.value)
                counts += np.bincount(number, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(len(seeds.grams), np.int64)
    for row in rows.toLocalIterator():
        out[row["gram"]] = row["n"]
    return out


def rare_seeds(docs: DataFrame, ids: np.ndarray, items: list[np.ndarray], size: int, min_score: float) -> Seeds:
    """Each item's rarest words by their counts over all documents."""
    counts = gram_counts(docs, _seeds(ids, items, size, min_score))
    return _seeds(ids, items, size, min_score, counts)


def align(passages: list[np.ndarray], item: np.ndarray) -> np.ndarray:
    """Best local alignment score of each passage with ``item``, all rows at once."""
    width = max(map(len, passages))
    text = np.zeros((len(passages), width), np.uint64)
    real = np.zeros((len(passages), width), bool)
    for i, p in enumerate(passages):
        text[i, : len(p)] = p
        real[i, : len(p)] = True
    above = np.zeros((len(passages), width + 1), np.int32)
    best = np.zeros(len(passages), np.int32)
    steps = np.arange(width + 1, dtype=np.int32) * -GAP
    for word in item:
        same = (text == word) & real
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, OTHER), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        # A gap along the row: the best earlier cell less its distance.
        row = np.maximum.accumulate(row + steps, axis=1) - steps
        best = np.maximum(best, row.max(axis=1))
        above = row
    return best


def _passages(place, number, bounds, seeds: Seeds) -> list[tuple[int, int, int, int]]:
    """``doc, item, first, last``: word ranges around seeds that lie close together."""
    times = np.diff(seeds.bounds)[number]
    if not times.sum():
        return []
    rows = np.arange(times.sum()) + np.repeat(seeds.bounds[:-1][number] - (np.cumsum(times) - times), times)
    item, where = seeds.item[rows], np.repeat(place, times)
    begin = where - seeds.place[rows]  # where the item would begin
    doc = np.searchsorted(bounds, where, side="right") - 1
    order = np.lexsort((where, item, doc))
    doc, item, where, begin = doc[order], item[order], where[order], begin[order]
    # A place counts once, also where the item has its word several times.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1])
    at = np.flatnonzero(new)
    low, high = np.minimum.reduceat(begin, at), np.maximum.reduceat(begin, at)
    doc, item, where = doc[at], item[at], where[at]
    size = np.array([len(w) for w in seeds.items], np.int64)
    reach = size + seeds.extra
    end = np.arange(len(doc)) + seeds.need[item] - 1
    to = np.minimum(end, len(doc) - 1)
    full = (end == to) & (doc[to] == doc) & (item[to] == item) & (where[to] - where <= reach[item])
    edge = np.bincount(np.flatnonzero(full), minlength=len(doc) + 1) - np.bincount(end[full] + 1, minlength=len(doc) + 1)
    keep = np.cumsum(edge)[:-1] > 0
    if not keep.any():
        return []
    doc, item, where, low, high = doc[keep], item[keep], where[keep], low[keep], high[keep]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (where[1:] - where[:-1] > reach[item[1:]])
    at = np.flatnonzero(new)
    doc, item = doc[at], item[at]
    first = np.maximum(np.minimum.reduceat(low, at) - seeds.extra[item], bounds[doc])
    last = np.minimum(np.maximum.reduceat(high, at) + reach[item], bounds[doc + 1])
    enough = _held(place, number, item, first, last, seeds) >= seeds.least[item]
    return list(zip(*(x[enough].tolist() for x in (doc, item, first, last))))


def _held(place, number, item, first, last, seeds: Seeds) -> np.ndarray:
    """How many words of its item each passage holds, in any order."""
    a, b = np.searchsorted(place, first), np.searchsorted(place, last)
    sums = np.cumsum(b - a)
    out = np.zeros(len(item), np.int64)
    low = 0
    while low < len(item):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + HELD_ROWS, side="right")))
        n = (b - a)[low:high]
        rows = np.arange(n.sum()) + np.repeat(a[low:high] - (np.cumsum(n) - n), n)
        passage = np.repeat(np.arange(low, high), n)
        key = item[passage] * len(seeds.grams) + number[rows]
        at = np.minimum(np.searchsorted(seeds.held, key), len(seeds.held) - 1)
        same = seeds.held[at] == key
        pair, times = np.unique(passage[same] * len(seeds.held) + at[same], return_counts=True)
        np.add.at(out, pair // len(seeds.held), np.minimum(times, seeds.times[pair % len(seeds.held)]))
        low = high
    return out


def _scored(found: list[tuple[int, int, int, int]], words: np.ndarray, seeds: Seeds) -> list[tuple[int, int, float, int, int]]:
    out = []
    by_item: dict[int, list] = {}
    for x in found:
        by_item.setdefault(x[1], []).append(x)
    for i, rows in by_item.items():
        rows.sort(key=lambda x: x[3] - x[2])
        a = 0
        while a < len(rows):
            b = a + 1
            while b < len(rows) and (rows[b][3] - rows[b][2]) * (b + 1 - a) < ALIGN_CELLS:
                b += 1
            scores = align([words[f:l] for _, _, f, l in rows[a:b]], seeds.items[i])
            whole = MATCH * len(seeds.items[i])
            out += [(d, i, float(s) / whole, f, l) for (d, _, f, l), s in zip(rows[a:b], scores)]
            a = b
    return out


def matches_of(docs: DataFrame, seeds: Seeds, min_score: float) -> DataFrame:
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block, words, bounds in _hashed_words(batch.column("text"), tb.BLOCK_BYTES):
                place, number = _hits(words, bounds, seeds)
                best: dict[tuple[int, int], tuple] = {}
                for d, i, score, first, last in _scored(_passages(place, number, bounds, seeds), words, seeds):
                    row = (score, -int(first - bounds[d]), int(last - bounds[d]))
                    if score >= min_score and row > best.get((d, i), (0.0,)):
                        best[d, i] = row
                rows = [(int(ids[block.first + d]), int(seeds.ids[i]), s, -f, l) for (d, i), (s, f, l) in sorted(best.items())]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in MATCHES.split(", ")]
                )

    return docs.select("doc_id", "text").mapInArrow(work, MATCHES)


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0

    def out():
        items: list[np.ndarray] = []
        for _, words, bounds in _hashed_words(pa.array(texts, pa.string()), limit):
            items += [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        return np.array(ids, np.int64), items

    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"] or "")
        size += len(texts[-1])
        if size >= limit:
            yield out()
            ids, texts, size = [], [], 0
    if ids:
        yield out()


def find_matches(
    docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word``: items found in documents.

    One row for a document and item, with the best score (0 to 1, at least ``min_score``)
    and the words of the document that were aligned.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    out = None
    for ids, items in _item_blocks(benchmark, block_bytes):
        found = matches_of(docs, rare_seeds(docs, ids, items, gram, min_score), min_score)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], MATCHES)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those in which an item was found."""
    found = find_matches(docs, benchmark, min_score=min_score).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
