"""Exact vector search, all questions at once.

Scores come from block matrix products inside Arrow tasks; what leaves a task is only
the best ``k`` rows per question and cluster. Three layouts give the same rows:

* few questions (a checked number): their matrix is broadcast and the corpus is
  scanned where it lies, without a shuffle;
* a few such blocks of questions: one scan after the other, unless the tasks would emit
  more than it takes to shuffle the corpus;
* many questions: corpus and questions are cut into bounded blocks by a hash of the
  id, and each pair of blocks is one group. Blocks of documents are the larger ones.

The corpus has ``doc_id, vector, cluster`` and the questions ``query_id, vector,
cluster``: a question is compared only with documents of its clusters. Unrouted search
is the case of a single cluster.

A question may bring a ``floor``, a score its k-th best is known to reach: less is never
emitted. :func:`places` runs over the same layouts and counts, for given documents, how
many are better.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.vectors import SCORE_DIGITS
from ..sources.tables import file_bytes
from .joins import is_stored, keep_matching, settle
from .ranking import ranking, top_k

SCORED = "query_id long, cluster int, doc_id long, score double"
_FIELDS = ["query_id", "cluster", "doc_id", "score"]
COUNTED = "query_id long, cluster int, doc_id long, better long"

MAX_BROADCAST_QUESTIONS = 20_000  # rows collected for a broadcast
MAX_BROADCAST_BYTES = 128 << 20  # and their size as a float64 matrix
MAX_SCANS = 8  # scans of the corpus before shuffling it is cheaper
SCAN_BYTES = 256 << 20  # stored bytes a scanning task reads, if there are many
BLOCK_ROWS = 20_000  # questions of a block pair, at most
BLOCK_DOCS = 8  # documents of a block pair, at most so many times its questions ...
BLOCK_BYTES = 64 << 20  # ... and of this size as a float64 matrix
ROW_BYTES = 16  # a written row of the result, about
_CELLS = 4_000_000  # scores held at once inside a task
_MAX_ROOM = 1e-2  # error of single precision, beyond which it is not used
_EXACT = 1_000_000  # components gathered at once for that
_SPARSE = 16  # cells of a question scored again one by one: at most one in so many
_LEAST_QUESTIONS = 1_000  # a block pair of fewer questions is not worth its documents
_FEW = 20  # rows a question, so few that scans never emit too much
_ROUNDING = 10.0**-SCORE_DIGITS
# Columns questions may bring along: see Asked.
_EXTRAS = ("floor", "wanted_docs", "wanted_scores")


# --- inside a task -------------------------------------------------------------------


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Array column as a float64 matrix; all vectors must have the same dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if np.any(np.diff(column.offsets.to_numpy()) != flat.size // rows):
        raise ValueError("vectors differ in dimension")
    return flat.reshape(rows, -1).astype(np.float64)


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows had a length at all."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    alive = norms > 0
    return matrix / np.where(alive, norms, 1.0)[:, None], alive


def keep_best(
    query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` entries per query, smaller document first on equal scores."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(query.size) - np.repeat(starts, np.diff(np.r_[starts, query.size]))
    kept = place < k
    return query[kept], doc[kept], score[kept]


def _cells_where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask.ravel()), max(1, mask.shape[1]))


def _tiles(
    ids: np.ndarray, questions: np.ndarray, docs: np.ndarray, matrix: np.ndarray, exclude_self: bool
) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of some questions at a time, from number ``at`` on, with some documents."""
    if not len(ids) or not len(docs):
        return
    # A question's own document, by its number in both.
    own, place = np.intersect1d(ids, docs, return_indices=True)[1:] if exclude_self else (np.zeros(0, int),) * 2
    order = np.argsort(own)
    own, place = own[order], place[order]
    step = max(1, _CELLS // len(docs))
    for at in range(0, len(ids), step):
        scores = questions[at : at + step] @ matrix.T
        mine = slice(*np.searchsorted(own, [at, at + step]))
        scores[own[mine] - at, place[mine]] = -np.inf
        yield at, scores


class BestRows:
    """Running best ``k`` documents per question of one cluster, fed block by block.

    ``floor`` is a question's k-th best score so far and ``last`` its document: only
    what beats them is looked at again, so most scores cost one comparison, and a flood
    of equal copies is turned away by id. A question's rows are sorted again only when
    something enters, at most once for each batch of documents.

    Products are made in single precision; what they leave possible, error included, is
    scored again in double precision, and only these scores count.
    """

    FIELDS = SCORED

    def __init__(self, asked: Asked, k: int, exclude_self: bool):
        ids, matrix = asked.ids, asked.matrix
        self.ids, self.matrix, self.k, self.exclude_self = ids, matrix, k, exclude_self
        self.lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        with np.errstate(over="ignore"):
            self.single = matrix.astype(np.float32)
        self.doc = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.score = np.full((len(ids), k), -np.inf)
        self.floor = np.full(len(ids), -np.inf) if asked.floor is None else asked.floor.copy()
        self.last = np.full(len(ids), np.iinfo(np.int64).max)

    def add(self, docs: np.ndarray, matrix: np.ndarray) -> None:
        if not len(self.ids) or not len(docs):
            return
        room = self._room(matrix)
        exact = not (room < _MAX_ROOM).all()  # NaN, too: single precision says nothing there
        questions, rows = (self.matrix, matrix) if exact else (self.single, matrix.astype(np.float32))
        for at, scores in _tiles(self.ids, questions, docs, rows, self.exclude_self):
            self._add_tile(at, docs, scores, matrix, np.zeros(len(scores)) if exact else room[at : at + len(scores)])

    def _room(self, matrix: np.ndarray) -> np.ndarray:
        """What a score in single precision may be off, for each question."""
        longest = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)).max()
        return (matrix.shape[1] + 8) * 2.0**-24 * self.lengths * longest + 1e-12

    def _exact(self, at: int, rows: np.ndarray, cols: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Scores of some cells in double precision."""
        values = np.empty(len(rows))
        per_row = np.bincount(rows, minlength=1)
        many = np.flatnonzero(per_row > len(matrix) // _SPARSE)  # copies of one document, mostly
        place = np.full(len(per_row), -1)
        place[many] = np.arange(len(many))
        whole = place[rows] >= 0
        if len(many):
            values[whole] = (self.matrix[at + many] @ matrix.T)[place[rows[whole]], cols[whole]]
        few = np.flatnonzero(~whole)
        step = max(1, _EXACT // max(1, matrix.shape[1]))
        for start in range(0, len(few), step):
            some = few[start : start + step]
            values[some] = np.einsum("ij,ij->i", self.matrix[at + rows[some]], matrix[cols[some]])
        return values

    def _add_tile(self, at: int, docs: np.ndarray, scores: np.ndarray, matrix: np.ndarray, room: np.ndarray) -> None:
        floor, last = self.floor[at : at + len(scores)], self.last[at : at + len(scores)]
        limit = floor - room
        unfilled = np.flatnonzero(np.isinf(limit))
        if unfilled.size and len(docs) > self.k:
            edge = len(docs) - self.k
            limit[unfilled] = np.partition(scores[unfilled], edge, axis=1)[:, edge] - 2.0 * room[unfilled]
        # Scores count as rounded, so compare with room for the rounding first.
        limit = limit - _ROUNDING
        if scores.dtype == np.float32:
            limit = np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
        rows, cols = _cells_where(scores >= limit[:, None])
        values = scores[rows, cols]
        if scores.dtype == np.float32:
            open_ = values > -np.inf  # not the question itself
            rows, cols = rows[open_], cols[open_]
            values = self._exact(at, rows, cols, matrix)
        values = np.round(values, SCORE_DIGITS) + 0.0
        enters = values > floor[rows]
        enters |= (values == floor[rows]) & (docs[cols] < last[rows])
        enters &= values > -np.inf
        if not enters.any():
            return
        rows, cols, values = rows[enters], cols[enters], values[enters]
        changed = np.unique(rows)
        held_row, held_place = np.nonzero(self.score[at + changed] > -np.inf)
        held = at + changed[held_row], held_place
        query, doc, score = keep_best(
            np.r_[held[0], at + rows],
            np.r_[self.doc[held], docs[cols]],
            np.r_[self.score[held], values],
            self.k,
        )
        # Results are sorted by question, then best first.
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        sizes = np.diff(np.r_[starts, query.size])
        place = np.arange(query.size) - np.repeat(starts, sizes)
        self.doc[query, place], self.score[query, place] = doc, score
        full = query[starts[sizes == self.k]]
        self.floor[full], self.last[full] = self.score[full, -1], self.doc[full, -1]

    def rows(self, cluster: int) -> pa.RecordBatch:
        query, place = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[query], pa.int64()),
                pa.array(np.full(len(query), cluster), pa.int32()),
                pa.array(self.doc[query, place], pa.int64()),
                pa.array(self.score[query, place], pa.float64()),
            ],
            names=_FIELDS,
        )


class Places:
    """How many documents are better than each wanted one, fed block by block.

    Wanted documents are sorted once, by question and best first. Each score that is not
    below all wanted ones of its question is looked up among them and counted there; what
    was counted at or before a wanted one is better.
    """

    FIELDS = COUNTED

    def __init__(self, asked: Asked, k: int, exclude_self: bool):
        self.ids, self.matrix, self.exclude_self = asked.ids, asked.matrix, exclude_self
        doc = np.concatenate([np.asarray(d, np.int64) for d in asked.docs] or [[]]).astype(np.int64)
        score = np.concatenate([np.asarray(s, float) for s in asked.scores] or [[]])
        query = np.repeat(np.arange(len(asked.ids)), [len(d) for d in asked.docs]).astype(np.int64)
        order = np.lexsort((doc, -score, query))
        self.doc, self.score, self.query = doc[order], score[order], query[order]
        self.lowest = np.full(len(asked.ids), np.inf)
        np.minimum.at(self.lowest, self.query, self.score)
        # A question and a score as one number, ascending as the wanted ones are sorted.
        self.levels, level = np.unique(-self.score, return_inverse=True)
        self.key = self.query * (2 * len(self.levels) + 2) + 2 * level + 1
        self.fallen = np.zeros(len(self.doc) + 1, np.int64)
        self.first = np.searchsorted(self.query, np.arange(len(asked.ids) + 1))

    def add(self, docs: np.ndarray, matrix: np.ndarray) -> None:
        for at, scores in _tiles(self.ids, self.matrix, docs, matrix, self.exclude_self):
            self._add_tile(at, docs, scores)

    def _add_tile(self, at: int, docs: np.ndarray, scores: np.ndarray) -> None:
        lowest = self.lowest[at : at + len(scores)]
        rows, cols = _cells_where(scores >= (lowest - _ROUNDING)[:, None])
        values = np.round(scores[rows, cols], SCORE_DIGITS) + 0.0
        met = values >= lowest[rows]
        rows, cols, values = rows[met] + at, cols[met], values[met]
        # Even numbers lie between the levels, odd ones are levels that a wanted one has.
        place = np.searchsorted(self.levels, -values)
        near = np.minimum(place, len(self.levels) - 1)
        same = self.levels[near] == -values if len(self.levels) else np.zeros(0, bool)
        key = rows * (2 * len(self.levels) + 2) + 2 * place + same
        left = np.searchsorted(self.key, key)
        tied = np.flatnonzero(self.key[np.minimum(left, len(self.key) - 1)] == key) if len(self.key) else []
        if len(tied):
            # A wanted document stands before itself, so it is not counted.
            n = len(self.doc)
            some = np.unique(key[tied])
            begin, end = np.searchsorted(self.key, some), np.searchsorted(self.key, some, "right")
            own = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange((end - begin).sum())
            keys, docs_ = np.r_[self.key[own], key[tied]], np.r_[self.doc[own], docs[cols[tied]]]
            scanned = np.arange(len(keys)) >= len(own)
            order = np.lexsort((scanned, docs_, keys))
            passed = np.cumsum(~scanned[order])
            group = np.searchsorted(some, keys[order])
            before = np.r_[0, np.cumsum(end - begin)][group]
            at_place = begin[group] + passed - before
            hit = scanned[order]
            left[tied[order[hit] - len(own)]] = at_place[hit]
        # What is behind all wanted ones of its question is better than none of them.
        left = left[left < self.first[rows + 1]]
        self.fallen += np.bincount(left, minlength=len(self.fallen))

    @property
    def better(self) -> np.ndarray:
        total = np.r_[0, np.cumsum(self.fallen)]
        # What earlier questions brought is taken off again.
        return total[1 : len(self.doc) + 1] - total[self.first[self.query]]

    def rows(self, cluster: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[self.query], pa.int64()),
                pa.array(np.full(len(self.doc), cluster), pa.int32()),
                pa.array(self.doc, pa.int64()),
                pa.array(self.better, pa.int64()),
            ],
            names=["query_id", "cluster", "doc_id", "better"],
        )


class Asked(NamedTuple):
    """Questions of one cluster, and what they bring beside their vectors."""

    ids: np.ndarray
    matrix: np.ndarray
    floor: np.ndarray | None = None
    docs: list | None = None
    scores: list | None = None

    @classmethod
    def of(cls, rows: pa.Table, cosine: bool) -> Asked:
        ids, matrix = rows.column("query_id").to_numpy(), to_matrix(rows.column("vector"))
        alive = np.ones(len(ids), bool)
        if cosine and len(ids):
            matrix, alive = unit_rows(matrix)

        def extra(name: str, read: Callable[[pa.ChunkedArray], object]) -> object:
            if name not in rows.column_names:
                return None
            return read(rows.column(name).filter(pa.array(alive)))

        return cls(
            ids[alive],
            matrix[alive],
            extra("floor", lambda column: column.to_numpy()),
            extra("wanted_docs", lambda column: column.to_pylist()),
            extra("wanted_scores", lambda column: column.to_pylist()),
        )


def _prepared(matrix: np.ndarray, ids: np.ndarray, cosine: bool):
    if not cosine or len(ids) == 0:
        return matrix, ids
    matrix, alive = unit_rows(matrix)
    return matrix[alive], ids[alive]


# --- the two layouts -----------------------------------------------------------------


def _scan_corpus(
    corpus: DataFrame,
    questions: pa.Table,
    k: int,
    cosine: bool,
    exclude_self: bool,
    collector: type[BestRows] | type[Places],
) -> DataFrame:
    clusters = questions.column("cluster").to_numpy()
    by_cluster = {
        int(cluster): Asked.of(questions.filter(pa.array(clusters == cluster)), cosine)
        for cluster in np.unique(clusters)
    }
    shared = corpus.sparkSession.sparkContext.broadcast(by_cluster)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, BestRows | Places] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            labels = batch.column("cluster").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            vectors = to_matrix(batch.column("vector"))
            for cluster in np.unique(labels):
                label = int(cluster)
                if label not in shared.value:
                    continue
                if label not in best:
                    best[label] = collector(shared.value[label], k, exclude_self)
                rows = labels == cluster
                unit, alive = _prepared(vectors[rows], docs[rows], cosine)
                best[label].add(alive, unit)
        for label, found in best.items():
            yield found.rows(label)

    # The probed clusters are known here, so a corpus stored by cluster is pruned.
    probed = corpus.where(F.col("cluster").isin(list(by_cluster)))
    probed = probed.select("doc_id", "vector", "cluster")
    # A task emits up to k rows per question, so small files are read together; a floor
    # leaves little to emit, and files then stay as Spark cuts them.
    if "floor" not in questions.column_names:
        spark = corpus.sparkSession
        tasks = max(
            8 * spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            file_bytes(probed) // SCAN_BYTES,
        )
        probed = probed.coalesce(tasks)
    return probed.mapInArrow(scan, collector.FIELDS)


def _block_counts(df: DataFrame, block_rows: int, name: str) -> DataFrame:
    """Blocks each cluster is cut into; a hot cluster just gets more of them."""
    return df.groupBy("cluster").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias(name)
    )


def _block_of(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")


def _pair_blocks(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    cosine: bool,
    exclude_self: bool,
    collector: type[BestRows] | type[Places],
    doc_rows: int,
    query_rows: int,
) -> DataFrame:
    extras = [c for c in _EXTRAS if c in questions.columns]
    doc_blocks = _block_counts(corpus, doc_rows, "doc_blocks")
    query_blocks = _block_counts(questions, query_rows, "query_blocks")
    # One row per cluster: the number of clusters is a parameter of the model.
    grid = F.broadcast(doc_blocks.join(query_blocks, "cluster"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        corpus.join(grid, "cluster")
        .withColumn("doc_block", _block_of("doc_id", "doc_blocks"))
        .withColumn("query_block", every("query_blocks"))
        .select("cluster", "doc_block", "query_block", "doc_id", "vector")
    )
    right = (
        questions.join(grid, "cluster")
        .withColumn("query_block", _block_of("query_id", "query_blocks"))
        .withColumn("doc_block", every("doc_blocks"))
        # Fresh columns: the questions are often the corpus itself.
        .select(
            *[F.col(c).alias(c) for c in ("cluster", "doc_block", "query_block", "query_id", "vector", *extras)],
        )
    )
    keys = ["cluster", "doc_block", "query_block"]

    last = ("better", pa.int64()) if collector is Places else ("score", pa.float64())

    def score(docs: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema(
            [
                ("query_id", pa.int64()),
                ("cluster", pa.int32()),
                ("doc_id", pa.int64()),
                last,
            ]
        )
        if docs.num_rows == 0 or asked.num_rows == 0:
            return schema.empty_table()
        best = collector(Asked.of(asked, cosine), k, exclude_self)
        unit, ids = _prepared(
            to_matrix(docs.column("vector")), docs.column("doc_id").to_numpy(), cosine
        )
        best.add(ids, unit)
        return pa.Table.from_batches([best.rows(docs.column("cluster")[0].as_py())])

    cogroups = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return cogroups.applyInArrow(score, collector.FIELDS)


def search(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    cosine: bool = True,
    exclude_self: bool = False,
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Candidates ``(query_id, cluster, doc_id, score)`` that contain the best ``k``
    per question and cluster. Zero vectors have no cosine and are dropped. Where the
    questions have a ``floor``, only scores that reach it count."""
    return _run(corpus, questions, k, cosine, exclude_self, BestRows, max_broadcast, block_rows)


def _run(
    corpus: DataFrame,
    questions: DataFrame,
    k: int,
    cosine: bool,
    exclude_self: bool,
    collector: type[BestRows] | type[Places],
    max_broadcast: int,
    block_rows: int,
) -> DataFrame:
    corpus = corpus.where(F.col("vector").isNotNull())
    questions = questions.where(F.col("vector").isNotNull()).select(
        "query_id", "vector", "cluster", *[c for c in _EXTRAS if c in questions.columns]
    )
    if not is_stored(questions):
        questions = settle(questions)  # counted, then cut into blocks
    width = F.max(F.size("vector"))
    listed = F.max(F.size("wanted_docs")) if collector is Places else F.lit(0)
    n, width, listed = questions.agg(F.count("*"), width, listed).first()
    width, listed = max(1, width or 0), max(0, listed or 0)
    # Bytes are known before any vector is fetched.
    per_block = min(max_broadcast, MAX_BROADCAST_BYTES // (8 * (width + 2 * listed)))
    if n <= per_block:
        return _scan_corpus(corpus, questions.toArrow(), k, cosine, exclude_self, collector)
    blocks = -(-n // max(1, per_block))
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    # Every block of documents emits rows for a question, so these blocks are the larger ones.
    query_rows = min(block_rows, max(_LEAST_QUESTIONS, -(-n // (2 * cores))))
    doc_rows = max(1, min(BLOCK_DOCS * block_rows, BLOCK_BYTES // (8 * width)))
    paired = per_block < 1 or blocks > MAX_SCANS
    if not paired and k > _FEW:
        # A scanning task emits k rows for each question; block pairs move the corpus.
        emitted = ROW_BYTES * n * k * corpus.rdd.getNumPartitions()
        paired = emitted > file_bytes(corpus) * -(-n // query_rows)
    if paired:
        return _pair_blocks(corpus, questions, k, cosine, exclude_self, collector, doc_rows, query_rows)
    # A few scans in place cost less than shuffling the corpus. Blocks are cut by a hash,
    # so that they are about equal.
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    scans = [
        _scan_corpus(
            corpus, questions.where(part == b).toArrow(), k, cosine, exclude_self, collector
        )
        for b in range(blocks)
    ]
    return reduce(DataFrame.unionAll, scans)


# --- operators -----------------------------------------------------------------------


def exact_topk(
    corpus: DataFrame, questions: DataFrame, k: int, **options: object
) -> DataFrame:
    """Exact top-k of the whole corpus for every question."""
    one = F.lit(0)
    return ranking(
        search(
            corpus.withColumn("cluster", one), questions.withColumn("cluster", one), k, **options
        ),
        k,
    )


def topk_per_cluster(
    corpus: DataFrame, routed: DataFrame, k: int, **options: object
) -> DataFrame:
    """Top-k of every probed cluster: ``routed`` has one row per question and cluster."""
    return top_k(search(corpus, routed, k, **options), k, ("query_id", "cluster"))


def routed_topk(
    corpus: DataFrame, routed: DataFrame, k: int, **options: object
) -> DataFrame:
    """Top-k over all probed clusters of each question."""
    return ranking(search(corpus, routed, k, **options), k)


def places(
    corpus: DataFrame,
    routed: DataFrame,
    wanted: DataFrame,
    cosine: bool = True,
    exclude_self: bool = False,
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rank of each ``wanted (query_id, doc_id)`` in the complete list of its question.

    The list holds all documents of the question's clusters in ``routed``; a wanted
    document outside it has no row. One scan counts the better ones; no list is written.
    """
    measure = vectors.cosine if cosine else vectors.dot
    docs = (
        keep_matching(corpus, wanted, "doc_id")
        .join(wanted.select("query_id", "doc_id"), "doc_id")
        .withColumnRenamed("vector", "doc_vector")
    )
    own = docs.join(routed.select("query_id", "vector", "cluster"), ["query_id", "cluster"]).select(
        "query_id",
        "doc_id",
        (vectors.rounded(measure(F.col("vector"), F.col("doc_vector"))) + 0.0).alias("score"),
    )
    own = own.where(F.col("score").isNotNull())
    if exclude_self:
        own = own.where(F.col("query_id") != F.col("doc_id"))
    # As many per question as the caller wants.
    lists = own.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "score")).alias("own"))
    asked = routed.join(lists, "query_id").select(
        *[F.col(c).alias(c) for c in ("query_id", "vector", "cluster")],
        F.col("own.doc_id").alias("wanted_docs"),
        F.col("own.score").alias("wanted_scores"),
    )
    counted = _run(corpus, asked, 0, cosine, exclude_self, Places, max_broadcast, block_rows)
    return counted.groupBy("query_id", "doc_id").agg(
        (F.sum("better") + 1).cast("int").alias("rank")
    )


def topk_for_one(
    corpus: DataFrame, score: Column, k: int
) -> DataFrame:
    """Top-k for a single question given as a score column: one pass, no shuffle."""
    return (
        corpus.select("doc_id", score.alias("score"))
        .where(F.col("score").isNotNull())
        .orderBy(F.desc("score"), F.asc("doc_id"))
        .limit(k)
    )


def dimension(df: DataFrame, vector: str = "vector") -> int:
    """The one dimension all vectors share; raises when they differ."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors have dimensions {low} to {high}")
    return low
