"""Exact top-k inner product search over vectors grouped by length.

Vectors are sorted by length and cut into buckets of nearly equal length. A query that
already has k products of at least ``theta`` can only gain from a bucket whose longest
vector ``l`` allows it: a product above ``theta`` needs a cosine of ``theta / (|q| l)``, the
local threshold. Above one, the bucket is skipped. A high threshold confines each
coordinate of a candidate (coordinate pruning on the query's largest ones); a low one only
asks for the vectors long enough (length pruning). What is left is multiplied exactly.

Queries come in blocks of bounded size; each block scans the buckets in place.

Rows: vectors that are null or hold null or non-finite components, or have no id, take no
part; an empty vector has product 0 with empty ones. Vectors meet vectors of their own
dimension. A query is not compared with rows of its own id; other repeated rows each
count. Components beyond 2**26 after scaling are refused, since sums might overflow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged

K = 5
SCALE = 256
BUCKET = 1024
QUERY_BLOCK = 16_384
PART_ROWS = 8_192
FOCUS = 4
COORDINATE_FROM = 0.6
SLACK = 1e-9
BUCKETS = "dim int, n int, ids binary, units binary"
HITS = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x), only of vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return (
        vectors.where("vec_id is not null and embedding is not null")
        .where(~bad)
        .select(F.col("vec_id").cast("long"), scaled.alias("v"))
    )


def _buckets(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors by descending length, in buckets of one dimension, as binary matrices."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    parts = max(1, -(-rows // PART_ROWS))
    placed = vectors.select("vec_id", "v", F.size("v").alias("dim"), length.alias("length"))
    ordered = placed.repartitionByRange(parts, "dim", F.desc("length"), "vec_id").sortWithinPartitions(
        "dim", F.desc("length"), "vec_id"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(dims)) + 1, [len(dims)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                for at in range(a, b, BUCKET):
                    part = batch.slice(at, min(BUCKET, b - at))
                    values = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    if len(values) and np.abs(values).max() > 1 << 26:
                        raise ValueError("a component is too large for exact 64-bit products")
                    ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    cells = [pa.array([x.tobytes()], pa.binary()) for x in (ids, values)]
                    sizes = [pa.array([x], pa.int32()) for x in (int(dims[a]), len(ids))]
                    yield pa.record_batch([*sizes, *cells], names=["dim", "n", "ids", "units"])

    return ordered.select("dim", "vec_id", "v").mapInArrow(work, BUCKETS)


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products; as floating point where no sum can leave 53 bits."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries @ candidates.T


class Best:
    """The k best candidates of each query of a block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int):
        self.ids, self.units, self.k = ids, units, k
        self.length = np.sqrt((units.astype(np.float64) ** 2).sum(axis=1))
        self.cosines = units / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.cosines), axis=1)[:, :FOCUS]
        self.score = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.theta = np.full(len(ids), -np.inf)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, open_: np.ndarray) -> None:
        """Merge candidates ``ids`` of queries ``rows``; ``open_`` marks those that count."""
        width = self.score.shape[1]
        if width < self.k:
            more = self.k - width
            self.score = np.pad(self.score, ((0, 0), (0, more)), constant_values=np.iinfo(np.int64).min)
            self.found = np.pad(self.found, ((0, 0), (0, more)), constant_values=np.iinfo(np.int64).max)
        open_ = open_ & (ids[None, :] != self.ids[rows][:, None])
        score = np.where(open_, score, np.iinfo(np.int64).min)
        gains = score.max(axis=1) >= self.theta[rows] if score.shape[1] else np.zeros(len(rows), bool)
        for i in np.flatnonzero(gains):
            r = rows[i]
            pick = np.flatnonzero(open_[i] & (score[i] >= self.theta[r]))
            s = np.concatenate([self.score[r], score[i, pick]])
            f = np.concatenate([self.found[r], ids[pick]])
            best = np.lexsort((f, -s.astype(np.float64) if abs(s).max() < 2**53 else -s))[: self.k]
            self.score[r], self.found[r] = s[best], f[best]
            if self.found[r, -1] != np.iinfo(np.int64).max:
                self.theta[r] = self.score[r, -1]

    def scan(self, ids: np.ndarray, units: np.ndarray) -> None:
        """One bucket: prune by its local thresholds, then verify."""
        length = np.sqrt((units.astype(np.float64) ** 2).sum(axis=1))
        top = length.max() if len(length) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.theta <= 0, 0.0, self.theta / (self.length * top)) - SLACK
        local = np.where(np.isnan(local), 0.0, local)
        by_length = np.flatnonzero(local < COORDINATE_FROM)
        for a in range(0, len(by_length), 1024):
            rows = by_length[a : a + 1024]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.theta[rows] <= 0, 0.0, self.theta[rows] / self.length[rows]) * (1 - SLACK)
            long_enough = length[None, :] >= np.nan_to_num(need)[:, None]
            last = int(long_enough.any(axis=0).sum())
            score = _products(self.units[rows], units[:last])
            self.offer(rows, score, ids[:last], long_enough[:, :last])
        by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1))
        if not len(by_coordinate):
            return
        cosines = units / np.maximum(length, 1e-300)[:, None]
        for r in by_coordinate:
            t = max(0.0, local[r])
            f = self.focus[r]
            q = self.cosines[r, f]
            reach = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - q * q)) + 1e-7
            # A cosine of at least t keeps coordinate f within q t +- reach, or above it
            # where the query's own coordinate is beyond t.
            c = cosines[:, f]
            low = np.where(q <= -t, -np.inf, q * t - reach)
            high = np.where(q >= t, np.inf, q * t + reach)
            keep = np.flatnonzero(((c >= low) & (c <= high)).all(axis=1))
            if len(keep):
                score = _products(self.units[r : r + 1], units[keep])
                self.offer(np.array([r]), score, ids[keep], np.ones(score.shape, bool))

    def rows(self) -> pa.RecordBatch:
        ok = self.found != np.iinfo(np.int64).max if self.score.shape[1] else np.zeros(self.score.shape, bool)
        who = np.repeat(self.ids, ok.sum(axis=1))
        return pa.record_batch(
            [pa.array(who), pa.array(self.found[ok]), pa.array(self.score[ok])], names=["query_id", "vec_id", "score"]
        )


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["units"], np.int64).reshape(len(ids), row["dim"])


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row that ``is_query`` names."""
    spark = vectors.sparkSession
    valid = staged(integer_vectors(vectors, scale), "vectors")
    rows = valid.count()
    buckets = staged(_buckets(valid, rows), "buckets")
    asked = valid.where(is_query)
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // query_block))
    out = None
    for b in range(blocks):
        # A block has a bounded number of queries, by a hash of the id.
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        by_dim: dict[int, list] = {}
        for row in part.toLocalIterator():
            by_dim.setdefault(len(row["v"]), []).append((row["vec_id"], row["v"]))
        queries = {
            d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64).reshape(len(x), d))
            for d, x in by_dim.items()
        }
        # The longest vectors give every query of the block a first threshold.
        heads = {}
        for d in queries:
            longest = valid.where(F.size("v") == d).orderBy(
                F.desc(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "vec_id"
            ).limit(BUCKET).collect()
            heads[d] = np.array([x["vec_id"] for x in longest], np.int64), np.array([x["v"] for x in longest], np.int64).reshape(-1, d)
        seeds = {}
        for d, (ids, units) in queries.items():
            best = Best(ids, units, k)
            best.scan(*heads[d])
            seeds[d] = best.theta
        sent = spark.sparkContext.broadcast((queries, seeds))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, seeds = sent.value
            best: dict[int, Best] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    d = row["dim"]
                    if d not in queries:
                        continue
                    if d not in best:
                        best[d] = Best(*queries[d], k)
                        best[d].theta = seeds[d].copy()
                    best[d].scan(*_matrix(row))
            for x in best.values():
                yield x.rows()

        hits = buckets.mapInArrow(work, HITS)
        out = hits if out is None else out.unionAll(hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
