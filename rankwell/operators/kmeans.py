"""K-means whose result follows from the rows alone, so that it can be repeated elsewhere.

Seeds are farthest-first: the row of smallest id, then again and again the row farthest
from all seeds so far (ties to the smaller id). Rounds assign every row to its nearest
center, the smaller number on ties of rounded distances, and average each cluster, until no
center moves more than a tolerance. The driver holds the centers only.

A round is one scan, whose tasks send a sum for each cluster. The vectors are written down
once, packed, and several fits go on in one scan. From time to time the rows
are written down with their distances to the nearest and the second nearest center. Later
rounds compare these with how far the centers have moved since: by the triangle inequality
most rows cannot have changed cluster, and are added up without a distance to any center.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SCORE_DIGITS, as_double
from .joins import scratch, settle
from .neighbours import to_matrix

CENTER_DIGITS = 9  # of a center's components: the order of summation leaves no trace
BLOCK_ROWS = 1_024  # vectors in a stored row
ANCHOR_WORK = 3  # rows are written down when so many times all of them were measured
_TIE = 2 * 10.0**-SCORE_DIGITS  # squared distances closer than this may round to a tie


@dataclass(frozen=True)
class Round:
    """``inertia`` is measured before the centers move; ``measured`` counts the rows
    whose distances to the centers were needed."""

    number: int
    inertia: float
    moved: float
    measured: int


@dataclass(frozen=True)
class Fit:
    centers: np.ndarray
    rounds: list[Round]

    def history(self, spark) -> DataFrame:
        rows = [(r.number, r.inertia, r.moved, r.measured) for r in self.rounds]
        return spark.createDataFrame(rows, "round int, inertia double, moved double, measured long")


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", points, points)[:, None]
    d2 = squares + np.einsum("ij,ij->i", centers, centers) - 2.0 * (points @ centers.T)
    return np.maximum(d2, 0.0)


def compared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances as they are compared: rounded."""
    return np.round(squared_distances(points, centers), SCORE_DIGITS) + 0.0


def _margin(points: np.ndarray) -> np.ndarray:
    """What rounding and the products may have changed in a row's squared distances."""
    return _TIE + 1e-12 * np.einsum("ij,ij->i", points, points)


def farthest_first(df: DataFrame, k: int) -> np.ndarray:
    """Up to ``k`` seeds, fewer if ``id, vector`` has fewer different vectors.

    The first j of them are the seeds for j clusters. One scan a seed; a task sends its
    farthest row.
    """
    rows = _points(df)
    first = rows.select(F.min_by("vector", "id").alias("vector")).first()["vector"]
    if first is None:
        raise ValueError("no row has a vector")
    seeds = np.array([first], dtype=np.float64)
    while len(seeds) < k:
        farthest = rows.mapInArrow(_farthest(seeds), "id long, vector array<double>, d2 double")
        found = farthest.orderBy(F.desc("d2"), "id").first()
        if found["d2"] == 0.0:
            break
        seeds = np.vstack([seeds, found["vector"]])
    return seeds


def _points(df: DataFrame) -> DataFrame:
    vector = as_double(F.col("vector")).alias("vector")
    return df.where("vector is not null").select(F.col("id").cast("long").alias("id"), vector)


def _farthest(seeds: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            d2 = compared_distances(to_matrix(batch.column("vector")), seeds).min(axis=1)
            ids = batch.column("id").to_numpy()
            at = np.lexsort((ids, -d2))[0]
            if best is None or (-d2[at], ids[at]) < best[0]:
                best = (-d2[at], ids[at]), batch.slice(int(at), 1)
        if best:
            yield best[1].append_column("d2", pa.array([-best[0][0]], pa.float64()))

    return scan


def lloyd(
    df: DataFrame, seeds: np.ndarray, max_iter: int = 300, tolerance: float = 0.0
) -> Fit:
    """Rounds from ``seeds`` over ``id, vector`` until no center moves more than
    ``tolerance`` or ``max_iter``. A center without rows stays where it is.

    Rows without a vector take no part.
    """
    return lloyd_all(df, [seeds], max_iter, tolerance)[0]


def lloyd_all(
    df: DataFrame, starts: list[np.ndarray], max_iter: int = 300, tolerance: float = 0.0
) -> list[Fit]:
    """:func:`lloyd` from several seeds at once: a scan is a round of every fit that goes on."""
    with scratch(df.sparkSession):
        runs = [_Run(np.asarray(seeds, dtype=np.float64)) for seeds in starts]
        _rounds(settle(_packed(_points(df))), runs, max_iter, tolerance)
    return [Fit(run.centers, run.rounds) for run in runs]


def fit(df: DataFrame, k: int, max_iter: int = 300, tolerance: float = 0.0) -> Fit:
    return lloyd(df, farthest_first(df, k), max_iter, tolerance)


@dataclass
class _Run:
    """A fit on its way."""

    centers: np.ndarray
    anchor: np.ndarray | None = None
    work: int = 0
    rounds: list[Round] = field(default_factory=list)

    def move(self, counts: np.ndarray, squares: float, sums: np.ndarray, measured: int) -> float:
        """Centers go to the means of their rows; how far the farthest went."""
        centers = self.centers
        inertia = squares - 2.0 * np.sum(sums * centers) + counts @ np.sum(centers**2, axis=1)
        means = np.round(sums / np.maximum(counts, 1)[:, None], CENTER_DIGITS) + 0.0
        self.centers = np.where(counts[:, None] > 0, means, centers)
        moved = float(np.sqrt(((self.centers - centers) ** 2).sum(axis=1).max()))
        self.rounds.append(Round(len(self.rounds) + 1, float(inertia), moved, measured))
        self.work += measured
        return moved

    def anchor_due(self, n_rows: int) -> bool:
        since = np.inf if self.anchor is None else np.sqrt(((self.centers - self.anchor) ** 2).sum(axis=1).max())
        return self.work >= ANCHOR_WORK * n_rows and self.rounds[-1].moved < since / 2


def _rounds(blocks: DataFrame, runs: list[_Run], max_iter: int, tolerance: float) -> None:
    active = list(range(len(runs))) if max_iter > 0 else []
    while active:
        found = _sums(blocks, {i: (runs[i].anchor, runs[i].centers) for i in active})
        going, due = [], []
        for i in active:
            if runs[i].move(*found[i]) > tolerance and len(runs[i].rounds) < max_iter:
                going.append(i)
                if runs[i].anchor_due(found[i][0].sum()):
                    due.append(i)
        active = going
        if due:
            kept = [i for i in active if i not in due and runs[i].anchor is not None]
            for i in due:
                runs[i].anchor, runs[i].work = runs[i].centers, 0
            columns = ["n int", "vectors binary", *(f"{c}_{i} binary" for i in sorted([*kept, *due]) for c in _STATE)]
            anchors = {i: runs[i].anchor for i in due}
            blocks = settle(blocks.mapInArrow(_measured(anchors, columns), ", ".join(columns)), only=True)


_STATE = {"nearest": np.int32, "upper": np.float64, "lower": np.float64}


def _packed(points: DataFrame) -> DataFrame:
    """Vectors as bytes, many to a row: rounds read them again and again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = to_matrix(batch.column("vector"))
            parts = [matrix[at : at + BLOCK_ROWS] for at in range(0, len(matrix), BLOCK_ROWS)]
            columns = [pa.array([len(x) for x in parts], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "vectors"])

    return points.select("vector").mapInArrow(scan, "n int, vectors binary")


def _cell(batch: pa.RecordBatch, name: str, at: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[at].as_buffer(), kind)


def _block(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return _cell(batch, "vectors", at, np.float64).reshape(batch.column("n")[at].as_py(), -1)


def _measured(anchors: dict[int, np.ndarray], columns: list[str]):
    """For each row and anchor the nearest center, the distance to it and to the next one."""
    names = [c.split()[0] for c in columns]

    def state(points: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
        margin = _margin(points)
        nearest = compared_distances(points, anchor).argmin(axis=1)
        d2 = squared_distances(points, anchor)
        each = np.arange(len(d2))
        upper = np.sqrt(d2[each, nearest] + margin)
        d2[each, nearest] = np.inf
        return nearest, upper, np.sqrt(np.maximum(d2.min(axis=1) - margin, 0.0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[str, list[bytes]] = {f"{c}_{i}": [] for i in anchors for c in _STATE}
            for at in range(batch.num_rows):
                points = _block(batch, at)
                for i, anchor in anchors.items():
                    for (c, kind), values in zip(_STATE.items(), state(points, anchor)):
                        new[f"{c}_{i}"].append(values.astype(kind).tobytes())
            cells = [pa.array(new[c], pa.binary()) if c in new else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cells, names=names)

    return scan


class _Moves:
    """What the way of the centers since the anchor says about a row."""

    def __init__(self, anchor: np.ndarray, centers: np.ndarray):
        self.way = np.sqrt(((centers - anchor) ** 2).sum(axis=1))
        gaps = np.sqrt(np.maximum(squared_distances(centers, centers) - _margin(centers), 0.0))
        np.fill_diagonal(gaps, np.inf)
        self.apart = gaps.min(axis=1)
        order = np.argsort(-self.way)
        self.longest = np.full(len(centers), self.way[order[0]])  # way of any other center
        self.longest[order[0]] = self.way[order[1]] if len(order) > 1 else 0.0

    def settled(self, nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Rows whose nearest center is surely the same, ties of rounding included."""
        upper = upper + self.way[nearest]
        others = np.maximum(lower - self.longest[nearest], self.apart[nearest] - upper)
        return (others > upper) & (others**2 - upper**2 > _TIE * (1.0 + upper**2))


def _sums(
    blocks: DataFrame, fits: dict[int, tuple[np.ndarray | None, np.ndarray]]
) -> dict[int, tuple[np.ndarray, float, np.ndarray, int]]:
    """For each fit (anchor and centers): rows of each center, sum of all squares, sum vector
    of each center's rows, and the number of rows that were measured."""
    known = {i: (None if anchor is None else _Moves(anchor, centers), centers) for i, (anchor, centers) in fits.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {i: np.zeros(len(centers), np.int64) for i, (_, centers) in known.items()}
        sums = {i: np.zeros((len(centers), centers.shape[1] + 1)) for i, (_, centers) in known.items()}
        measured = dict.fromkeys(known, 0)
        for batch in batches:
            for at in range(batch.num_rows):
                points = _block(batch, at)
                squares = np.einsum("ij,ij->i", points, points)
                extended = np.column_stack([points, squares])
                for i, (moves, centers) in known.items():
                    if moves is None:
                        nearest = compared_distances(points, centers).argmin(axis=1)
                        measured[i] += len(points)
                    else:
                        nearest, upper, lower = (_cell(batch, f"{c}_{i}", at, kind) for c, kind in _STATE.items())
                        open_ = ~moves.settled(nearest, upper, lower)
                        nearest = nearest.copy()
                        nearest[open_] = compared_distances(points[open_], centers).argmin(axis=1)
                        measured[i] += int(open_.sum())
                    order = np.argsort(nearest, kind="stable")
                    found, starts = np.unique(nearest[order], return_index=True)
                    sums[i][found] += np.add.reduceat(extended[order], starts, axis=0)
                    counts[i] += np.bincount(nearest, minlength=len(centers))
        rows = [(i, at) for i in known for at in np.flatnonzero(counts[i])]
        if rows:
            first = {i: at for i, at in reversed(rows)}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows], pa.int32()),
                    pa.array([at for _, at in rows], pa.int32()),
                    pa.array([counts[i][at] for i, at in rows], pa.int64()),
                    pa.array([sums[i][at].tolist() for i, at in rows], pa.list_(pa.float64())),
                    pa.array([measured[i] if first[i] == at else 0 for i, at in rows], pa.int64()),
                ],
                names=["fit", "cluster", "n", "sums", "measured"],
            )

    partial = blocks.mapInArrow(gather, "fit int, cluster int, n long, sums array<double>, measured long")
    table = (
        partial.groupBy("fit", "cluster")
        .agg(
            F.sum("n").alias("n"),
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"),
            F.sum("measured").alias("measured"),
        )
        .toArrow()
    )
    fit_of, clusters = (table.column(c).to_numpy() for c in ("fit", "cluster"))
    n, measured = (table.column(c).to_numpy() for c in ("n", "measured"))
    totals = to_matrix(table.column("sums"))
    out = {}
    for i, (_, centers) in fits.items():
        k, dim = centers.shape
        mine = fit_of == i
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim))
        counts[clusters[mine]] = n[mine]
        sums[clusters[mine]] = totals[mine, :dim]
        out[i] = counts, float(totals[mine, dim].sum()), sums, int(measured[mine].sum())
    return out
