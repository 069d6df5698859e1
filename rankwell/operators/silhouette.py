"""Mean distances for the exact silhouette, without comparing all rows with all.

A row needs its mean distance to its own cluster and to the nearest other one. What the
mean distance ``E d`` to a cluster can be follows from the cluster's moments. With ``c``
its mean, ``w = y - c`` for a member ``y``, ``z = x - c`` for the row ``x``, and
``S = d**2 = |z|**2 + |w|**2 - 2 z.w``:

* ``m = E S = |z|**2 + E |w|**2`` and ``v = Var S = Var |w|**2 + 4 z'Cov(w)z - 4 z.Cov(|w|**2, w)``;
* ``E d <= sqrt(m)``, and ``E d >= |z|`` (Jensen);
* ``E d >= sqrt(m) * (1 - v / (2 * (1 + s)**2 * m**2))`` when no distance is below
  ``s * sqrt(m)``, since ``sqrt(t) >= 1 + (t-1)/2 - (t-1)**2 / (2 * (1+s)**2)`` for
  ``t >= s**2``. The triangle inequality over the members' distances to ``c`` gives ``s``.

A row is compared with its own cluster and with the one of least upper bound; of the rest
only clusters whose lower bound does not exceed that mean are compared. No value changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import settle
from .neighbours import MAX_BROADCAST_BYTES, to_matrix

#: Covariances of all clusters are held up to this size; beyond it the other bounds remain.
MAX_MOMENT_BYTES = MAX_BROADCAST_BYTES // 4
_SLACK = 1e-7  # squared distances come from products
_CELLS = 4_000_000  # distances held at once inside a task

PARTS = "id long, cluster int, a double, b double, compared long"


def _distance_totals(points: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Sum of distances from each point to all members."""
    squares = np.einsum("ij,ij->i", members, members)
    totals = np.zeros(len(points))
    step = max(1, _CELLS // max(1, len(members)))
    for start in range(0, len(points), step):
        x = points[start : start + step]
        d2 = np.einsum("ij,ij->i", x, x)[:, None] + squares - 2.0 * (x @ members.T)
        totals[start : start + step] = np.sqrt(np.maximum(d2, 0.0)).sum(axis=1)
    return totals


@dataclass(frozen=True)
class Moments:
    """Per cluster: size, mean, and what the bounds need. ``skew`` is ``Cov(|w|**2, w)``.

    ``covariance`` is None when all of them together pass ``MAX_MOMENT_BYTES``.
    """

    clusters: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    near: np.ndarray
    far: np.ndarray
    spread: np.ndarray
    spread_variance: np.ndarray
    skew: np.ndarray
    covariance: np.ndarray | None

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest mean distance from each point (row) to each cluster."""
        lower = np.empty((len(points), len(self.clusters)))
        upper = np.empty_like(lower)
        for at in range(len(self.clusters)):
            z = points - self.means[at]
            square = np.einsum("ij,ij->i", z, z)
            length = np.sqrt(square)
            mean = np.maximum(square + self.spread[at], np.finfo(float).tiny)
            gap = np.maximum(np.maximum(length - self.far[at], self.near[at] - length), 0.0)
            low = np.maximum(length, gap)
            if self.covariance is not None:
                variance = self.spread_variance[at] - 4.0 * (z @ self.skew[at])
                variance += 4.0 * np.einsum("ij,ij->i", z @ self.covariance[at], z)
                closeness = 2.0 * (1.0 + gap / np.sqrt(mean)) ** 2
                share = np.maximum(variance, 0.0) / (closeness * mean**2)
                low = np.maximum(low, np.sqrt(mean) * (1.0 - share))
            lower[:, at] = low * (1.0 - _SLACK)
            upper[:, at] = np.sqrt(mean) * (1.0 + _SLACK)
        return lower, upper

    def places(self, labels: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.clusters, labels)

    def homes(self, upper: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The other cluster of least upper bound; the own one if there is no other."""
        upper = upper.copy()
        upper[np.arange(len(own)), own] = np.inf
        home = upper.argmin(axis=1)
        return np.where(np.isinf(upper[np.arange(len(own)), home]), own, home)


def moments(rows: DataFrame, clusters: np.ndarray, means: np.ndarray) -> Moments:
    """Moments of ``vector`` about the given means of each ``cluster``.

    Tasks sum up what they read, one row per task and cluster is shuffled.
    """
    dim = means.shape[1]
    full = len(clusters) * dim * dim * 8 <= MAX_MOMENT_BYTES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 + dim + (dim * dim if full else 0)
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        ends: dict[int, tuple[float, float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            points = to_matrix(batch.column("vector"))
            labels = batch.column("cluster").to_numpy()
            for label in np.unique(labels):
                w = points[labels == label] - means[np.searchsorted(clusters, label)]
                square = np.einsum("ij,ij->i", w, w)
                parts = [[square.sum(), square @ square], square @ w]
                if full:
                    parts.append((w.T @ w).ravel())
                counts[int(label)] = counts.get(int(label), 0) + len(w)
                total = sums.setdefault(int(label), np.zeros(width))
                total += np.concatenate(parts)
                near, far = ends.get(int(label), (np.inf, 0.0))
                length = np.sqrt(square)
                ends[int(label)] = (min(near, length.min()), max(far, length.max()))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int32()),
                    pa.array([counts[c] for c in sums], pa.int64()),
                    pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64())),
                    pa.array([ends[c][0] for c in sums], pa.float64()),
                    pa.array([ends[c][1] for c in sums], pa.float64()),
                ],
                names=["cluster", "n", "sums", "near", "far"],
            )

    partial = rows.select("vector", "cluster").mapInArrow(
        gather, "cluster int, n long, sums array<double>, near double, far double"
    )
    found = (
        partial.groupBy("cluster")
        .agg(
            F.sum("n").alias("n"),
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"),
            F.min("near").alias("near"),
            F.max("far").alias("far"),
        )
        .toArrow()
        .sort_by("cluster")
    )
    sums = to_matrix(found.column("sums"))
    sizes = found.column("n").to_numpy()
    spread = sums[:, 0] / sizes
    covariance = None
    if full:
        covariance = (sums[:, 2 + dim :] / sizes[:, None]).reshape(-1, dim, dim)
    return Moments(
        clusters=clusters,
        sizes=sizes,
        means=means,
        near=found.column("near").to_numpy(),
        far=found.column("far").to_numpy(),
        spread=spread,
        spread_variance=np.maximum(sums[:, 1] / sizes - spread**2, 0.0),
        skew=sums[:, 2 : 2 + dim] / sizes[:, None],
        covariance=covariance,
    )


def mean_distances(
    rows: DataFrame, known: Moments, max_broadcast: int, block_rows: int
) -> DataFrame:
    """``id, cluster, a, b, compared`` of every row of ``id, vector, cluster``.

    ``a`` is the mean distance to the other rows of the own cluster (null if alone), ``b``
    the least mean distance to another cluster (null if there is none), ``compared`` the
    number of rows it was compared with. Ids are distinct.
    """
    n_rows = int(known.sizes.sum())
    if n_rows <= max_broadcast and n_rows * known.means.shape[1] * 8 <= MAX_BROADCAST_BYTES:
        return _by_broadcast(rows, known)
    return _by_blocks(rows, known, block_rows)


def _by_broadcast(rows: DataFrame, known: Moments) -> DataFrame:
    """All rows, few by their count, go to the tasks sorted by cluster."""
    everything = rows.select("vector", "cluster").toArrow()
    labels = everything.column("cluster").to_numpy()
    order = np.argsort(labels, kind="stable")
    matrix = to_matrix(everything.column("vector"))[order]
    ends = np.cumsum(known.sizes)
    shared = rows.sparkSession.sparkContext.broadcast((matrix, ends - known.sizes, ends))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, starts, ends = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = to_matrix(batch.column("vector"))
            own = known.places(batch.column("cluster").to_numpy())
            lower, upper = known.bounds(points)
            home = known.homes(upper, own)
            totals = np.full(lower.shape, np.nan)

            def compare(wanted: np.ndarray) -> None:
                for at in np.flatnonzero(wanted.any(axis=0)):
                    mine = wanted[:, at]
                    totals[mine, at] = _distance_totals(points[mine], matrix[starts[at] : ends[at]])

            each = np.arange(len(own))
            first = np.zeros(lower.shape, bool)
            first[each, own] = first[each, home] = True
            compare(first)
            best = np.where(home == own, np.inf, totals[each, home] / known.sizes[home])
            compare((lower <= best[:, None]) & ~first)
            yield _parts(batch.column("id"), own, totals, known)

    return rows.mapInArrow(scan, PARTS)


def _parts(ids: pa.Array, own: np.ndarray, totals: np.ndarray, known: Moments) -> pa.RecordBatch:
    each = np.arange(len(own))
    others = known.sizes[own] - 1
    a = totals[each, own] / np.maximum(others, 1)
    means = np.where(np.isnan(totals), np.inf, totals / known.sizes)
    means[each, own] = np.inf
    b = means.min(axis=1)
    compared = (~np.isnan(totals)) @ known.sizes
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array(known.clusters[own], pa.int32()),
            pa.array(a, pa.float64(), mask=others == 0),
            pa.array(b, pa.float64(), mask=np.isinf(b)),
            pa.array(compared, pa.int64()),
        ],
        names=["id", "cluster", "a", "b", "compared"],
    )


_ASKED = "id long, cluster int, vector array<double>, target int"


def _by_blocks(rows: DataFrame, known: Moments, block_rows: int) -> DataFrame:
    """Rows meet the members of a cluster in pairs of blocks, so that one large cluster is
    many tasks. Pairs of rows exist only inside block products."""
    rows = settle(rows)
    first = settle(_totals(rows.mapInArrow(_first_targets(known), _ASKED), rows, known, block_rows))
    best = first.where("target <> cluster").select("id", F.col("mean").alias("best"))
    second = rows.join(best, "id").mapInArrow(_other_targets(known), _ASKED)
    return (
        first.unionByName(_totals(second, rows, known, block_rows))
        .groupBy("id", "cluster")
        .agg(
            F.max(F.when(F.col("target") == F.col("cluster"), F.col("mean"))).alias("a"),
            F.min(F.when(F.col("target") != F.col("cluster"), F.col("mean"))).alias("b"),
            F.sum("n").alias("compared"),
        )
    )


def _asked(batch: pa.RecordBatch, points: np.ndarray, wanted: np.ndarray, known: Moments):
    """One row for each wanted cluster (column) of each point (row)."""
    at, target = np.nonzero(wanted)
    values = pa.array(points[at].ravel(), pa.float64())
    offsets = pa.array(np.arange(len(at) + 1) * points.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("id").take(pa.array(at)).cast(pa.int64()),
            batch.column("cluster").take(pa.array(at)).cast(pa.int32()),
            pa.ListArray.from_arrays(offsets, values),
            pa.array(known.clusters[target], pa.int32()),
        ],
        names=["id", "cluster", "vector", "target"],
    )


def _first(points: np.ndarray, own: np.ndarray, known: Moments) -> tuple[np.ndarray, np.ndarray]:
    lower, upper = known.bounds(points)
    first = np.zeros(lower.shape, bool)
    each = np.arange(len(own))
    first[each, own] = first[each, known.homes(upper, own)] = True
    return lower, first


def _first_targets(known: Moments):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = to_matrix(batch.column("vector"))
                own = known.places(batch.column("cluster").to_numpy())
                yield _asked(batch, points, _first(points, own, known)[1], known)

    return scan


def _other_targets(known: Moments):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = to_matrix(batch.column("vector"))
                own = known.places(batch.column("cluster").to_numpy())
                lower, first = _first(points, own, known)
                best = batch.column("best").to_numpy()[:, None]
                yield _asked(batch, points, (lower <= best) & ~first, known)

    return scan


def _totals(asked: DataFrame, rows: DataFrame, known: Moments, block_rows: int) -> DataFrame:
    """``id, cluster, target, n, mean``: mean distance of asked rows to their targets."""
    spark = rows.sparkSession
    asked = settle(asked)
    counts = dict(asked.groupBy("target").count().collect())  # one row per cluster
    sizes = [
        (int(c), int(n), -(-int(n) // block_rows), -(-counts[int(c)] // block_rows))
        for c, n in zip(known.clusters, known.sizes)
        if int(c) in counts
    ]
    blocks = spark.createDataFrame(sizes, "target int, n long, members int, askers int")
    at = F.xxhash64("id")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = asked.join(blocks, "target").select(
        "id", "cluster", "vector", "target",
        F.pmod(at, F.col("askers")).cast("int").alias("x"), every("members").alias("y"),
    )
    right = (
        rows.select("id", "vector", F.col("cluster").alias("target"))
        .join(blocks, "target")
        .select(
            "vector", "target",
            every("askers").alias("x"), F.pmod(at, F.col("members")).cast("int").alias("y"),
        )
    )

    def measure(x: pa.Table, y: pa.Table) -> pa.Table:
        totals = np.zeros(x.num_rows)
        if x.num_rows and y.num_rows:
            totals = _distance_totals(to_matrix(x.column("vector")), to_matrix(y.column("vector")))
        return x.select(["id", "cluster", "target"]).append_column("total", pa.array(totals))

    keys = ["target", "x", "y"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        measure, "id long, cluster int, target int, total double"
    )
    others = F.col("n") - F.when(F.col("target") == F.col("cluster"), 1).otherwise(0)
    return (
        partial.groupBy("id", "cluster", "target")
        .agg(F.sum("total").alias("total"))
        .join(blocks.select("target", "n"), "target")
        .select(
            "id", "cluster", "target", "n",
            F.when(others > 0, F.col("total") / F.nullif(others, F.lit(0))).alias("mean"),
        )
    )
