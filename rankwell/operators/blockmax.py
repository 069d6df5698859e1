"""BM25 top-k over packed postings with block bounds.

The documents of an index lie in hash buckets; inside a bucket a second hash deals them to
``PARTS`` blocks. A row holds all postings of one term in one bucket, block after block,
and beside them the largest contribution the term makes in each block. A task scores its
buckets question by question: the bounds of a question's terms add up to what any document
of a block can reach at most, blocks are taken from the highest bound down, and once ``k``
documents are found every block whose bound stays below the ``k``-th score is skipped, its
postings never touched. What is left out cannot enter the top-k, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 16
# Room for rounding where scores are compared with bounds or with each other.
SLACK = 2e-6
PACKED = "bucket int, term string, docs binary, f binary, doc_len binary, cuts binary, tops binary"
SCORED = "query_id long, doc_id long, score double, n_read long"
FALLEN = "query_id long, place int, n long"


class Setting(NamedTuple):
    k1: float
    b: float
    avg_doc_len: float

    def saturation(self, f: np.ndarray, doc_len: np.ndarray) -> np.ndarray:
        relative = doc_len / self.avg_doc_len if self.avg_doc_len else np.zeros(len(doc_len))
        return f * (self.k1 + 1.0) / (f + self.k1 * (1.0 - self.b + self.b * relative))


def _block_of(docs: np.ndarray) -> np.ndarray:
    """Block of each document, from the high bits of a multiplicative hash."""
    return ((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.int64)


def pack(postings: DataFrame, rare: DataFrame, buckets: int, setting: Setting) -> DataFrame:
    """Postings ``(doc_id, term, f, doc_len)`` as ``PACKED`` rows, one for a term and bucket.

    Those of ``rare (doc_id, term)`` are left out: such a term has one document, so a row
    without occurrences travels beside its posting and marks the term in that bucket. A
    partition holds one bucket.
    """
    bucket = F.pmod(F.hash("doc_id"), F.lit(buckets)).alias("bucket")
    none = F.lit(0).cast("long")
    marks = rare.select("doc_id", "term", none.alias("f"), none.alias("doc_len"))
    rows = postings.select("doc_id", "term", "f", "doc_len").unionByName(marks)
    rows = rows.select(bucket, "term", "doc_id", "f", "doc_len").where(F.col("doc_id").isNotNull())
    sorted_ = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            edges = _edges(table)
            # The last term may go on in the next batch.
            last = int(edges[-2]) if len(edges) > 1 else 0
            if last:
                yield _packed(table.slice(0, last), edges[:-1], setting)
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield _packed(held, _edges(held), setting)

    return sorted_.mapInArrow(work, PACKED)


def _edges(table: pa.Table) -> np.ndarray:
    """Where rows of another term or bucket begin, and the end."""
    terms = table.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    code = terms.indices.to_numpy()
    bucket = table.column("bucket").to_numpy()
    new = np.flatnonzero((np.diff(code) != 0) | (np.diff(bucket) != 0)) + 1
    return np.concatenate([[0], new, [table.num_rows]]) if table.num_rows else np.zeros(1, np.int64)


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each edge to the next."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _packed(table: pa.Table, edges: np.ndarray, setting: Setting) -> pa.RecordBatch:
    table = table.slice(0, edges[-1])
    seen = np.minimum.reduceat(table.column("f").to_numpy(), edges[:-1]) > 0
    table = table.filter(pa.array(np.repeat(seen, np.diff(edges)))).combine_chunks()
    edges = np.concatenate([[0], np.cumsum(np.diff(edges)[seen])])
    docs = table.column("doc_id").to_numpy().astype(np.int64)
    f = table.column("f").to_numpy().astype(np.float64)
    doc_len = table.column("doc_len").to_numpy().astype(np.float64)
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    block = _block_of(docs)
    order = np.lexsort((docs, block, group))
    docs, f, doc_len, block = docs[order], f[order], doc_len[order], block[order]
    cell = group * PARTS + block
    tops = np.zeros(len(edges[:-1]) * PARTS)
    np.maximum.at(tops, cell, setting.saturation(f, doc_len))
    cuts = np.bincount(cell, minlength=len(tops)).reshape(-1, PARTS).astype(np.int32)
    first = table.take(pa.array(edges[:-1]))
    cells = np.arange(len(edges)) * PARTS
    columns = [
        first.column("bucket").cast(pa.int32()),
        first.column("term"),
        _binary(docs.astype(np.int64), edges),
        _binary(f.astype(np.int32), edges),
        _binary(doc_len.astype(np.int32), edges),
        _binary(cuts.ravel(), cells),
        _binary(tops.astype(np.float64), cells),
    ]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.record_batch(columns, names=[c.split()[0] for c in PACKED.split(", ")])


class Asked(NamedTuple):
    """Question terms, sorted by question: numbers of questions and terms, weights."""

    query_ids: np.ndarray
    terms: dict[str, int]
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def asked_of(weighted: DataFrame) -> Asked:
    """``(query_id, term, weight)`` rows, of checked size, for the tasks."""
    rows = weighted.select("query_id", "term", "weight").toArrow()
    ids, query = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
    names = rows.column("term").to_pylist()
    terms = {t: i for i, t in enumerate(dict.fromkeys(names))}
    order = np.argsort(query, kind="stable")
    number = np.array([terms[t] for t in names], np.int64)
    return Asked(ids, terms, query[order], number[order], rows.column("weight").to_numpy()[order].astype(float))


class _Bucket:
    """The postings of one bucket, end to end, and the bounds of their blocks."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, ...]], asked: Asked, setting: Setting, exact_tops: bool):
        numbers = np.array(list(rows), np.int64)
        self.asked = asked
        self.place = np.full(len(asked.terms), -1, np.int64)
        self.place[numbers] = np.arange(len(numbers))
        self.docs_of, self.local = np.unique(np.concatenate([r[0] for r in rows.values()]), return_inverse=True)
        ends = np.cumsum([0] + [len(r[0]) for r in rows.values()])
        parts = [setting.saturation(r[1].astype(float), r[2].astype(float)) for r in rows.values()]
        self.part = np.concatenate(parts)
        self.cuts = np.stack([r[3] for r in rows.values()])
        # Where each block of each term begins in the arrays.
        self.begin = ends[:-1, None] + np.cumsum(self.cuts, axis=1) - self.cuts
        if exact_tops:
            self.tops = np.stack([r[4] for r in rows.values()])
        else:  # other settings than the stored bounds were made for: no part reaches k1 + 1
            self.tops = np.where(self.cuts > 0, setting.k1 + 1.0, 0.0)
        self.bounds = np.searchsorted(asked.query, np.arange(len(asked.query_ids) + 1))
        # A repeated document gains a part for each of its rows: more than the bounds say.
        self.repeated = any((np.diff(r[0]) == 0).any() for r in rows.values())

    def terms_of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of the question's terms that the bucket has."""
        mine = self.place[self.asked.term[self.bounds[q] : self.bounds[q + 1]]]
        weight = self.asked.weight[self.bounds[q] : self.bounds[q + 1]]
        return mine[mine >= 0], weight[mine >= 0]

    def scores(self, mine: np.ndarray, weight: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, int]:
        """Scores of the bucket's documents from ``some`` blocks, and the postings read."""
        sizes = self.cuts[np.ix_(mine, some)].ravel()
        total = int(sizes.sum())
        first = self.begin[np.ix_(mine, some)].ravel()
        at = np.arange(total) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        gained = np.repeat(np.repeat(weight, len(some)), sizes) * self.part[at]
        return np.bincount(self.local[at], weights=gained, minlength=len(self.docs_of)), total


def bucket_best(
    rows: dict[int, tuple[np.ndarray, ...]], asked: Asked, k: int, setting: Setting, exact_tops: bool, floors: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Best documents of a bucket: number of the question, documents, scores, postings read.

    ``rows``: number of the term to its documents, f, lengths, cuts and tops. ``floors``
    are the questions' ``k``-th scores so far; they rise.
    """
    bucket = _Bucket(rows, asked, setting, exact_tops)
    for q in range(len(asked.query_ids)):
        mine, weight = bucket.terms_of(q)
        if not len(mine):
            continue
        reach = weight @ bucket.tops[mine]
        found_docs, found, n_read = np.zeros(0, np.int64), np.zeros(0), 0
        order = np.argsort(-reach, kind="stable")
        # The best block alone, then all that are left above the floor it gives.
        for some in (order[:1], order[1:]):
            some = some[(reach[some] > 0) & (reach[some] >= floors[q] - SLACK)]
            scores, total = bucket.scores(mine, weight, some)
            if not total:
                continue
            n_read += total
            hit = np.flatnonzero(scores >= max(floors[q] - SLACK, 1e-300))
            found_docs, found = np.concatenate([found_docs, bucket.docs_of[hit]]), np.concatenate([found, scores[hit]])
            if len(found) > k:
                kth = np.partition(found, len(found) - k)[len(found) - k]
                floors[q] = max(floors[q], kth)
                keep = found >= kth - SLACK
                found_docs, found = found_docs[keep], found[keep]
        yield q, found_docs, found, n_read


def _asked_blocks(blocks: DataFrame, asked: Asked, literals: int) -> DataFrame:
    """Rows of the question terms."""
    if len(asked.terms) <= literals:
        return blocks.where(F.col("term").isin(list(asked.terms)))
    names = blocks.sparkSession.createDataFrame([(t,) for t in asked.terms], "term string")
    return blocks.join(F.broadcast(names), "term", "left_semi")


def _bucket_rows(batches: Iterator[pa.RecordBatch], asked: Asked) -> dict[int, tuple[np.ndarray, ...]]:
    """The rows of one bucket as arrays, by number of the term."""
    kinds = {"docs": np.int64, "f": np.int32, "doc_len": np.int32, "cuts": np.int32, "tops": np.float64}
    rows: dict[int, tuple[np.ndarray, ...]] = {}
    for batch in batches:
        terms = batch.column("term").to_pylist()
        for i, term in enumerate(terms):
            rows[asked.terms[term]] = tuple(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items())
    return rows


def best(
    blocks: DataFrame, asked: Asked, k: int, setting: Setting, exact_tops: bool, literals: int, held: list | None = None
) -> DataFrame:
    """``SCORED``: at least the top ``k`` of each question in each bucket, ties included.

    ``held`` gets what was sent, for a caller that ends it.
    """
    # Plain values: executors need no copy of this module to read a broadcast.
    sent = blocks.sparkSession.sparkContext.broadcast(tuple(asked))
    if held is not None:
        held.append(sent)
    blocks = _asked_blocks(blocks, asked, literals)

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(*sent.value)
        rows = _bucket_rows(batches, asked)
        cells = list(bucket_best(rows, asked, k, setting, exact_tops, np.zeros(len(asked.query_ids))))
        sizes = [len(docs) for _, docs, _, _ in cells]
        ids = asked.query_ids[np.array([q for q, *_ in cells], np.int64)]
        columns = [
            np.repeat(ids, sizes).astype(np.int64),
            np.concatenate([np.zeros(0, np.int64), *(c[1] for c in cells)]),
            np.concatenate([np.zeros(0), *(c[2] for c in cells)]),
            np.repeat(np.array([c[3] for c in cells], np.int64), sizes),
        ]
        yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in SCORED.split(", ")])

    return blocks.groupBy("bucket").applyInArrow(work, SCORED)


class Wanted(NamedTuple):
    """Documents of each question whose places are asked for, best first."""

    first: np.ndarray  # where those of each question begin
    docs: np.ndarray
    scores: np.ndarray


def wanted_of(rows: pa.Table, asked: Asked, digits: int) -> Wanted:
    """``(query_id, doc_id, score)`` rows, of checked size, for the tasks."""
    query = np.searchsorted(asked.query_ids, rows.column("query_id").to_numpy())
    docs, scores = rows.column("doc_id").to_numpy(), np.round(rows.column("score").to_numpy(), digits)
    order = np.lexsort((docs, -scores, query))
    return Wanted(np.searchsorted(query[order], np.arange(len(asked.query_ids) + 1)), docs[order], scores[order])


def fallen_places(docs: np.ndarray, scores: np.ndarray, own_docs: np.ndarray, own_scores: np.ndarray) -> np.ndarray:
    """For each document, how many of the own ones (best first) it does not stand before."""
    left = np.searchsorted(-own_scores, -scores, "left")
    place = np.searchsorted(-own_scores, -scores, "right")
    tied = np.flatnonzero(left < place)
    for at in np.unique(left[tied]):  # own ones of one score are sorted by document
        mine = tied[left[tied] == at]
        place[mine] = at + np.searchsorted(own_docs[at : place[mine[0]]], docs[mine], "right")
    return place


def fallen(
    blocks: DataFrame, asked: Asked, wanted: Wanted, setting: Setting, exact_tops: bool, literals: int, digits: int
) -> DataFrame:
    """``FALLEN``: how many documents of each bucket fall to each place between the wanted ones.

    Blocks that cannot reach the lowest wanted score of a question are skipped; a task
    sends counts, no documents.
    """
    sent = blocks.sparkSession.sparkContext.broadcast((tuple(asked), tuple(wanted)))
    blocks = _asked_blocks(blocks, asked, literals)

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = Asked(*sent.value[0]), Wanted(*sent.value[1])
        bucket = _Bucket(_bucket_rows(batches, asked), asked, setting, exact_tops)
        cells = []
        for q in range(len(asked.query_ids)):
            own = slice(wanted.first[q], wanted.first[q + 1])
            mine, weight = bucket.terms_of(q)
            if own.start == own.stop or not len(mine):
                continue
            lowest = wanted.scores[own][-1]
            reach = weight @ bucket.tops[mine]
            some = np.flatnonzero((reach > 0) & ((reach >= lowest - SLACK) | bucket.repeated))
            scores, _ = bucket.scores(mine, weight, some)
            hit = np.flatnonzero((scores > 0) & (scores >= lowest - SLACK))
            place = fallen_places(bucket.docs_of[hit], np.round(scores[hit], digits), wanted.docs[own], wanted.scores[own])
            n = np.bincount(place, minlength=own.stop - own.start)[: own.stop - own.start]
            at = np.flatnonzero(n)
            cells.append((np.full(len(at), asked.query_ids[q], np.int64), at.astype(np.int32), n[at].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*cells)] or [np.zeros(0, kind) for kind in (np.int64, np.int32, np.int64)]
        yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in FALLEN.split(", ")])

    return blocks.groupBy("bucket").applyInArrow(work, FALLEN)
