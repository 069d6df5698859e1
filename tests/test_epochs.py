from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from test_silhouette import groups

from rankwell.operators import epochs

FAST = epochs.Schedule(epochs=4, batches=3, rate=0.1)


def sparse(spark, matrix, labels):
    """Even rows as sparse vectors, odd ones as dense."""
    rows = []
    for at, (v, label) in enumerate(zip(matrix, labels)):
        dense = Vectors.dense(v.tolist())
        kept = Vectors.sparse(len(v), np.flatnonzero(v).tolist(), v[v != 0].tolist())
        rows.append((at, float(label), kept if at % 2 == 0 else dense))
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    return epochs.sparse_rows(df.withColumn("label", df.label.cast("int")))


def data(n, seed):
    matrix, labels = groups(n, seed, 0.6, k=4)
    matrix = np.where(np.abs(matrix) < 0.3, 0.0, matrix).astype(np.float64)
    return matrix, labels


def shares(matrix, weights):
    logits = np.column_stack([matrix, np.ones(len(matrix))]) @ weights
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def plain_training(matrix, labels, batch, asked, truth, classes, plan):
    """The same training over whole matrices."""
    weights = np.zeros((matrix.shape[1] + 1, classes))
    m, v, step, running, best, kept, rows = 0, 0, 0, 0.0, 0.0, weights, []
    for epoch in range(plan.epochs):
        losses, sizes = [], []
        for b in epochs.batch_order(epoch, plan.batches):
            x, y = matrix[batch == b], labels[batch == b]
            p = shares(x, weights)
            losses.append(-np.log(p[np.arange(len(y)), y]).mean())
            sizes.append(len(y))
            p[np.arange(len(y)), y] -= 1
            g = np.column_stack([x, np.ones(len(x))]).T @ p / len(y)
            rate = plan.rate * (1 + (plan.end_factor - 1) * min(step / plan.decay_steps, 1))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            weights = weights - rate * plan.decay * weights - rate * move
        running += sum(losses)
        accuracy = (shares(asked, weights).argmax(axis=1) == truth).mean()
        if accuracy > best:
            best, kept = accuracy, weights
        rows.append((np.average(losses, weights=sizes), running / plan.batches, accuracy))
    return kept, rows


def test_training_equals_plain_numpy(spark, workspace):
    matrix, labels = data(180, 1)
    asked, truth = data(60, 2)
    rows = sparse(spark, matrix, labels)
    batch = rows.select("id", epochs.batch_of(FAST.batches).alias("b")).orderBy("id").toPandas()["b"]
    got = epochs.train(rows, sparse(spark, asked, truth), 8, 4, workspace, "fit", FAST)
    weights, history = plain_training(matrix, labels, batch.to_numpy(), asked, truth, 4, FAST)
    assert np.allclose(got.weights, weights, atol=1e-9)
    assert [(e.loss, e.running_loss, e.accuracy) for e in got.epochs] == [
        pytest.approx(h, rel=1e-9) for h in history
    ]
    assert got.epochs[-1].loss < got.epochs[0].loss


def test_weights_are_those_of_the_best_epoch(spark, workspace):
    rows = sparse(spark, *data(120, 3))
    asked = sparse(spark, *data(50, 4))
    got = epochs.train(rows, asked, 8, 4, workspace, "fit", epochs.Schedule(epochs=5, batches=2))
    best = 0.0
    for e in got.epochs:
        assert e.kept == (e.accuracy > best)
        best = max(best, e.accuracy)
    told = epochs.predictions(asked, got.weights).toPandas()
    assert (told["label"] == told["pred"]).mean() == pytest.approx(best)
    assert [r.kept for r in got.history(spark).orderBy("epoch").collect()] == [e.kept for e in got.epochs]


def test_a_batch_reads_its_own_files(spark, workspace):
    rows = sparse(spark, *data(40, 5))
    epochs.train(rows, rows, 8, 4, workspace, "fit", epochs.Schedule(epochs=1, batches=4))
    folder = next(Path(workspace.root).glob("fit_*"))
    stored = spark.read.parquet(str(folder))
    plan = stored.where("batch = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    assert stored.count() == 40


def test_nulls_empty_tables_and_one_class(spark, workspace):
    df = spark.createDataFrame(
        [(1, None, Vectors.dense([1.0])), (2, 0, None), (3, 1, Vectors.dense([2.0]))],
        ["id", "label", "features"],
    )
    rows = epochs.sparse_rows(df)
    assert [r.id for r in rows.collect()] == [3]
    none = rows.where("id < 0")
    got = epochs.train(none, rows, 1, 2, workspace, "none", epochs.Schedule(epochs=2))
    assert [e.loss for e in got.epochs] == [0.0, 0.0] and not got.weights.any()
    unseen = epochs.train(rows, none, 1, 2, workspace, "unseen", epochs.Schedule(epochs=1))
    assert unseen.epochs[0].accuracy == 0.0 and not unseen.epochs[0].kept
    with pytest.raises(ValueError, match="two classes"):
        epochs.train(rows, rows, 1, 1, workspace, "one")
