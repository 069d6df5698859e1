"""Training of the cluster classifier by epochs of mini-batches.

Rows are dealt into batches by a hash of their id and stored by batch, so a batch reads its
own files and an epoch reads the rows once. An epoch takes the batches in an order of its
own, also a hash. Tasks add up the gradient of what they read over the features that occur;
the driver holds the weights (features x classes) and moves them by Adam with decoupled
weight decay. After every epoch the validation accuracy is measured, and the weights are
kept if it is strictly better than that of all epochs before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import Workspace, fingerprint
from .neighbours import to_matrix


@dataclass(frozen=True)
class Schedule:
    """``rate`` falls in a straight line to ``end_factor`` of itself over ``decay_steps``
    batches and stays there."""

    epochs: int = 5
    batches: int = 4
    rate: float = 0.05
    end_factor: float = 0.3
    decay_steps: int = 10
    decay: float = 0.01

    def rate_at(self, step: int) -> float:
        done = min(step / self.decay_steps, 1.0)
        return self.rate * (1.0 + (self.end_factor - 1.0) * done)


@dataclass(frozen=True)
class Epoch:
    """``running_loss`` goes on from the start of training, as mean of a batch;
    ``kept`` marks a strictly better ``accuracy``."""

    number: int
    loss: float
    running_loss: float
    accuracy: float
    kept: bool


@dataclass(frozen=True)
class Trained:
    """Weights (one row a feature, the last one the intercept; one column a class)."""

    weights: np.ndarray
    epochs: list[Epoch]

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(e.number, e.loss, e.running_loss, e.accuracy, e.kept) for e in self.epochs]
        return spark.createDataFrame(
            rows, "epoch int, loss double, running_loss double, accuracy double, kept boolean"
        )


def sparse_rows(df: DataFrame) -> DataFrame:
    """``id, label, features`` (an ML vector) as index and value arrays.

    Rows without a label or features take no part.
    """
    parts = F.unwrap_udt("features")
    size = F.when(parts["type"] == 0, parts["size"]).otherwise(F.size(parts["values"]))
    dense = F.sequence(F.lit(0), size - 1)
    return df.where("label is not null and features is not null").select(
        F.col("id").cast("long").alias("id"),
        F.col("label").cast("int").alias("label"),
        F.when(parts["type"] == 0, parts["indices"]).otherwise(dense).alias("indices"),
        parts["values"].alias("values"),
    )


class _Rows:
    """A batch of sparse rows; the intercept is a feature of value 1."""

    def __init__(self, batch: pa.RecordBatch, intercept: int):
        counts = batch.column("indices").value_lengths().to_numpy().astype(np.int64)
        n = len(counts)
        owner = np.repeat(np.arange(n), counts)
        self.owner = np.concatenate([owner, np.arange(n)])
        indices = batch.column("indices").flatten().to_numpy()
        self.indices = np.concatenate([indices, np.full(n, intercept)])
        self.values = np.concatenate([batch.column("values").flatten().to_numpy(), np.ones(n)])
        self.labels = batch.column("label").to_numpy()

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each class (column) for each row."""
        n = len(self.labels)
        logits = np.column_stack(
            [
                np.bincount(self.owner, self.values * weights[self.indices, c], minlength=n)
                for c in range(weights.shape[1])
            ]
        )
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def _gradients(weights: np.ndarray):
    """Per task: summed gradient of each feature that occurs. Loss and number of rows come
    as feature -1."""
    size, classes = weights.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = np.zeros((size, classes))
        loss, seen = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows(batch, size - 1)
            gap = rows.shares(weights)
            each = np.arange(len(rows.labels))
            loss -= np.log(np.maximum(gap[each, rows.labels], 1e-300)).sum()
            seen += len(each)
            gap[each, rows.labels] -= 1.0
            for c in range(classes):
                gradient[:, c] += np.bincount(
                    rows.indices, rows.values * gap[rows.owner, c], minlength=size
                )
        if seen:
            touched = np.flatnonzero(gradient.any(axis=1))
            sums = [[loss, float(seen)] + [0.0] * (classes - 2), *gradient[touched].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[-1, touched], pa.int32()),
                    pa.array(sums, pa.list_(pa.float64())),
                ],
                names=["feature", "sums"],
            )

    return scan


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Mean gradient and mean loss over ``rows``, and their number."""
    partial = rows.select("label", "indices", "values").mapInArrow(
        _gradients(weights), "feature int, sums array<double>"
    )
    found = (
        partial.groupBy("feature")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        .toArrow()
    )
    gradient = np.zeros_like(weights)
    if not found.num_rows:
        return gradient, 0.0, 0
    features = found.column("feature").to_numpy()
    sums = to_matrix(found.column("sums"))
    loss, seen = sums[features == -1][0, :2]
    gradient[features[features >= 0]] = sums[features >= 0]
    return gradient / seen, float(loss / seen), int(round(seen))


def predictions(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``id, label, pred`` of sparse rows; the smaller class on ties."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pred = _Rows(batch, len(weights) - 1).shares(weights).argmax(axis=1)
                yield batch.select(["id", "label"]).append_column("pred", pa.array(pred, pa.int32()))

    return rows.mapInArrow(scan, "id long, label int, pred int")


def batch_order(epoch: int, batches: int) -> list[int]:
    """Batches in the order of a digest of epoch and number."""
    digest = lambda b: hashlib.md5(f"{epoch}:{b}".encode()).hexdigest()
    return sorted(range(batches), key=digest)


def batch_of(batches: int):
    return F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")


def train(
    rows: DataFrame,
    validation: DataFrame,
    n_features: int,
    n_classes: int,
    workspace: Workspace,
    name: str,
    schedule: Schedule = Schedule(),
) -> Trained:
    """Train on sparse ``rows``; labels run from 0 to ``n_classes - 1``, at least two.

    A batch without rows takes no step. Without any row that is predicted rightly in
    validation, the weights of the start (all zero) are the result.
    """
    if n_classes < 2:
        raise ValueError("a classifier needs two classes")
    dealt = rows.withColumn("batch", batch_of(schedule.batches))
    stored = workspace.stage(
        f"{name}_{fingerprint(rows, schedule.batches)}",
        lambda: dealt.repartition("batch", "id"),
        partition_by="batch",
        schema=dealt.schema,
    )
    weights = np.zeros((n_features + 1, n_classes))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    best, best_accuracy = weights.copy(), 0.0
    epochs: list[Epoch] = []
    step, running = 0, 0.0
    for epoch in range(schedule.epochs):
        losses = []
        for number in batch_order(epoch, schedule.batches):
            gradient, loss, seen = _gradient(stored.where(F.col("batch") == number), weights)
            if not seen:
                continue
            losses.append((loss, seen))
            running += loss
            rate = schedule.rate_at(step)
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights = weights * (1.0 - rate * schedule.decay) - rate * move
        total = sum(n for _, n in losses)
        mean = sum(loss * n for loss, n in losses) / total if total else 0.0
        right = F.avg((F.col("label") == F.col("pred")).cast("double"))
        accuracy = predictions(validation, weights).agg(right).first()[0] or 0.0
        kept = accuracy > best_accuracy
        if kept:
            best, best_accuracy = weights.copy(), accuracy
        epochs.append(Epoch(epoch + 1, mean, running / schedule.batches, accuracy, kept))
    return Trained(best, epochs)
