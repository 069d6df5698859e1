"""Exact vector search that leaves out what distances to the centroids rule out.

Every cluster is cut into rings of like distance to its centroid. A ring keeps the least
and the largest of these distances, and both bound what a question can score in it:

* inner product: ``q.x = q.c + q.(x - c) <= q.c + |q| * far``;
* cosine, on unit vectors: also ``1 - gap**2 / 2``, where by the triangle inequality
  ``gap = max(0, |q - c| - far, near - |q - c|)`` is the least distance to a row.

A question first searches the few rings with the best bounds that hold enough rows. Its
k-th score there is a floor; of the other rings only those whose bound reaches it are
read, and only rows that reach it leave a task. No row is lost, however poor the clusters
are; poor ones only rule out less, which ``compared`` shows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.workspace import Workspace
from .clustering import Centroids, assign_nearest, write_by_cluster
from .joins import scratch, settle
from .neighbours import search, to_matrix, unit_rows
from .ranking import ranking

MAX_RINGS = 256  # of one cluster
RING_ROWS = 5_000
_SLACK = 2e-6  # scores are rounded to 6 digits
_CELLS = 500_000  # bounds held at once inside a task
SENT_BYTES = 8 << 20  # of vectors in a batch that leaves a task


@dataclass(frozen=True)
class RingIndex:
    """``rows``: ``doc_id, vector, distance, cluster``, stored by ring (as ``cluster``).

    The arrays have one entry per ring, at most ``MAX_RINGS`` a cluster.
    """

    rows: DataFrame
    cosine: bool
    rings: np.ndarray
    sizes: np.ndarray
    near: np.ndarray
    far: np.ndarray
    centers: np.ndarray
    center_of: np.ndarray

    def bounds(self, matrix: np.ndarray) -> np.ndarray:
        """Largest score that each question (row) can have in each ring."""
        products = matrix @ self.centers.T
        lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
        upper = products[:, self.center_of] + lengths * self.far
        if self.cosine:
            squares = np.einsum("ij,ij->i", self.centers, self.centers)
            to_center = np.sqrt(np.maximum(lengths**2 + squares - 2.0 * products, 0.0))
            to_center = to_center[:, self.center_of]
            gap = np.maximum(np.maximum(to_center - self.far, self.near - to_center), 0.0)
            upper = np.minimum(upper, 1.0 - gap**2 / 2.0)
        return upper + _SLACK + 1e-9 * np.abs(upper)

    def homes(self, bounds: np.ndarray, rows: int) -> np.ndarray:
        """Rings with the best bounds that together hold ``rows`` rows, per question."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = self.sizes[order]
        taken = np.cumsum(held, axis=1) - held < rows
        home = np.zeros(bounds.shape, bool)
        np.put_along_axis(home, order, taken, axis=1)
        return home


def build_rings(
    corpus: DataFrame,
    centroids: Centroids,
    workspace: Workspace,
    name: str,
    cosine: bool = True,
    ring_rows: int = RING_ROWS,
) -> RingIndex:
    """Index ``doc_id, vector`` by nearest centroid and distance to it.

    Any centroids give right results; for ``cosine`` those of unit vectors rule out most.
    Rows without a vector, and zero vectors under ``cosine``, are left out, as no search
    finds them. Clusters are numbers below 2**23. Rows of equal distance share a ring.
    """
    spark = corpus.sparkSession
    if not workspace.has(name):
        with scratch(spark):
            ringed = _ringed(corpus, centroids, cosine, ring_rows)
            write_by_cluster(ringed, "doc_id", workspace, name)
    columns = corpus.select(
        "doc_id", "vector", F.lit(0.0).alias("distance"), F.lit(0).alias("cluster")
    )
    rows = workspace.stage(name, lambda: columns, schema=columns.schema)
    found = workspace.stage(
        f"{name}_rings",
        lambda: rows.groupBy("cluster").agg(
            F.count("*").alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far")
        ),
    ).orderBy("cluster").toArrow()
    rings, sizes, near, far = (found.column(c).to_numpy() for c in ("cluster", "n", "near", "far"))
    place = {int(c): at for at, c in enumerate(centroids.clusters)}
    center_of = np.array([place[int(r) // MAX_RINGS] for r in rings], dtype=np.int64)
    return RingIndex(rows, cosine, rings, sizes, near, far, centroids.matrix, center_of)


def _ringed(corpus: DataFrame, centroids: Centroids, cosine: bool, ring_rows: int) -> DataFrame:
    point = vectors.as_double(F.col("vector"))
    if cosine:
        length = F.nullif(vectors.norm(F.col("vector")), F.lit(0.0))
        point = F.when(length.isNotNull(), F.transform(point, lambda x: x / length))
    points = corpus.select("doc_id", F.col("vector").alias("stored"), point.alias("vector"))
    centers = F.broadcast(centroids.table(corpus.sparkSession))  # held by the driver already
    measured = settle(
        assign_nearest(points, centroids)
        .join(centers, "cluster")
        .select(
            "doc_id",
            F.col("stored").alias("vector"),
            "cluster",
            F.sqrt(vectors.squared_distance(F.col("vector"), F.col("centroid"))).alias("distance"),
        )
    )
    shares = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
    cuts = measured.groupBy("cluster").agg(
        F.percentile_approx("distance", shares).alias("cuts"),
        F.least(F.ceil(F.count("*") / ring_rows), F.lit(MAX_RINGS)).alias("n_rings"),
    )
    passed = F.size(F.filter("cuts", lambda cut: cut <= F.col("distance")))
    ring = F.floor(passed * F.col("n_rings") / MAX_RINGS)
    return measured.join(F.broadcast(cuts), "cluster").select(  # one row per cluster
        "doc_id",
        "vector",
        "distance",
        (F.col("cluster") * MAX_RINGS + ring).cast("int").alias("cluster"),
    )


def _sent(chosen: np.ndarray, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chosen cells, some at a time: a question may go to every ring, and its vector with it."""
    rows, cols = np.nonzero(chosen)
    most = max(1, SENT_BYTES // (8 * max(1, dim)))
    for first in range(0, len(rows), most):
        yield rows[first : first + most], cols[first : first + most]


def _routes(index: RingIndex, questions: DataFrame, rows: int, rest: bool) -> DataFrame:
    """Rings to search: the homes, or the ``rest`` whose bound reaches the floor."""
    plain = {f.name: getattr(index, f.name) for f in index.__dataclass_fields__.values() if f.name != "rows"}
    fields = "query_id long, vector array<double>, cluster int" + (", floor double" if rest else "")
    schema = pa.schema(
        [("query_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("cluster", pa.int32())]
        + ([("floor", pa.float64())] if rest else [])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = RingIndex(None, **plain)
        step = max(1, _CELLS // max(1, len(known.rings)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                matrix = to_matrix(part.column("vector"))
                points, alive = unit_rows(matrix) if known.cosine else (matrix, np.ones(len(matrix), bool))
                bounds = known.bounds(points)
                chosen = known.homes(bounds, rows)
                if rest:
                    floor = part.column("floor").to_numpy()[:, None]
                    chosen = (bounds >= floor) & ~chosen
                for at, ring in _sent(chosen & alive[:, None], matrix.shape[1]):
                    columns = [
                        part.column("query_id").take(pa.array(at)),
                        part.column("vector").take(pa.array(at)),
                        pa.array(known.rings[ring].astype(np.int32)),
                    ]
                    if rest:
                        columns.append(part.column("floor").take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
                    )

    asked = questions.where(F.col("vector").isNotNull()).select(
        F.col("query_id").cast("long").alias("query_id"),
        vectors.as_double(F.col("vector")).alias("vector"),
        *(["floor"] if rest else []),
    )
    return asked.mapInArrow(work, fields)


@dataclass(frozen=True)
class RingHits:
    hits: DataFrame
    """The ranking: ``query_id, rank, doc_id, score``."""
    compared: DataFrame
    """``query_id, n_rings, compared``: rings read and rows in them."""


def ring_topk(
    index: RingIndex, questions: DataFrame, k: int, exclude_self: bool = False, **options: object
) -> RingHits:
    """Exact top-k of the whole corpus, as ``neighbours.exact_topk`` gives it."""
    options |= {"cosine": index.cosine, "exclude_self": exclude_self}
    home = settle(_routes(index, questions, k + exclude_self, rest=False))
    first = settle(search(index.rows, home, k, **options))
    floors = ranking(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    none = F.lit(float("-inf"))
    asked = questions.select("query_id", "vector").join(floors, "query_id", "left")
    asked = asked.withColumn("floor", F.coalesce("floor", none))
    rest = settle(_routes(index, asked, k + exclude_self, rest=True))
    second = search(index.rows, rest, k, **options)
    sizes = questions.sparkSession.createDataFrame(
        [(int(r), int(n)) for r, n in zip(index.rings, index.sizes)], "cluster int, n long"
    )
    read = home.select("query_id", "cluster").unionByName(rest.select("query_id", "cluster"))
    compared = (
        read.join(F.broadcast(sizes), "cluster")  # one row per ring
        .groupBy("query_id")
        .agg(F.count("*").alias("n_rings"), F.sum("n").alias("compared"))
    )
    return RingHits(ranking(first.unionByName(second), k), compared)
