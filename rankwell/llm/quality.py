"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (``h = tanh(x W + b)``); gated
attention gives it a weight, ``softmax(w . (tanh(h V) * sigmoid(h U)))`` over the document's
passages; the weighted sum of the encodings is scored by a logistic unit. Only documents
are labelled; which passages matter is learned with the rest.

A passage is ``PASSAGE`` words in a row. Its features are shares of byte classes, word
shapes, repeated words and hashed words, and a few values of the whole document.

The model is fitted on the driver from a bounded sample of labelled documents
(``SAMPLE_DOCS``, ``SAMPLE_PASSAGES``); scoring reads every passage of every text.

Rows: a null or empty text has one empty passage and gets the score of that. Without
labels of both kinds the score is the share of label 1, or 0.5. Repeated ids each get a
row; where a document has several labels, each teaches. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .staging import ship

PASSAGE = 64
SAMPLE_DOCS = 6_000
SAMPLE_PASSAGES = 60_000
WORD_BINS = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 3e-3, 1e-4, 11
THRESHOLD = 0.7


def _classes() -> tuple[np.ndarray, int]:
    """Class of each byte: letters, digits and so on; each ASCII symbol its own."""
    table = np.zeros(256, np.int64)
    table[97:123] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[128:] = 4
    table[10] = 5
    table[[9, 11, 12, 13, 32]] = 6
    symbols = [c for c in range(33, 127) if table[c] == 0]
    table[symbols] = 7 + np.arange(len(symbols))
    return table, 7 + len(symbols)


def features(block: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and each document's bounds among them."""
    table, n_classes = _classes()
    start, end, words = tb.words(block)
    counts = np.diff(words)
    passages = np.maximum(-(-counts // PASSAGE), 1)
    bounds = np.concatenate([[0], np.cumsum(passages)])
    n = int(bounds[-1])
    doc_of_word = np.repeat(np.arange(block.n), counts)
    place = np.arange(len(start)) - words[:-1][doc_of_word]
    of_word = bounds[:-1][doc_of_word] + place // PASSAGE
    # A passage's bytes run from its first word to the next passage's first word.
    first = np.repeat(block.offsets[:-1], passages)
    heads = np.flatnonzero(place % PASSAGE == 0)
    first[of_word[heads]] = np.where(place[heads] == 0, block.offsets[:-1][doc_of_word[heads]], start[heads])
    edges = np.append(first, len(block.data))
    of_byte = np.repeat(np.arange(n), np.diff(edges))
    size = np.maximum(np.diff(edges), 1).astype(np.float32)
    shares = np.bincount(of_byte * n_classes + table[block.data], minlength=n * n_classes).reshape(n, n_classes)
    shares = (shares / size[:, None]).astype(np.float32)

    length = (end - start).astype(np.float64)
    held = np.maximum(np.bincount(of_word, minlength=n), 1)
    mean = np.bincount(of_word, length, minlength=n) / held
    spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, minlength=n) / held - mean**2, 0))

    def share_of(kinds: np.ndarray) -> np.ndarray:
        """Share of words with a byte of the classes."""
        sums = np.concatenate([[0], np.cumsum(kinds[table[block.data]])])
        return np.bincount(of_word, sums[end] > sums[start], minlength=n) / held

    kinds = np.arange(n_classes)
    shapes = [share_of(kinds == 2), share_of(kinds >= 7), share_of(kinds == 3)]

    hashes = tb.word_hashes(block, start, end, lower=True)
    order = np.lexsort((hashes, of_word))
    h, p = hashes[order], of_word[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[new], minlength=n) / held
    bins = (hashes >> np.uint64(58)).astype(np.int64) % WORD_BINS
    hashed = np.bincount(of_word * WORD_BINS + bins, minlength=n * WORD_BINS).reshape(n, WORD_BINS) / held[:, None]

    order = np.lexsort((hashes, doc_of_word))
    h, d = hashes[order], doc_of_word[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    whole = np.bincount(d[new], minlength=block.n) / np.maximum(counts, 1)
    lines = np.bincount(np.searchsorted(block.offsets, np.flatnonzero(block.data == 10), side="right") - 1, minlength=block.n)
    own = np.stack([whole, np.log1p(counts), np.log1p(lines), np.log1p(counts / (lines + 1))], axis=1)
    columns = [shares, np.stack([mean, spread, np.log1p(held), *shapes, distinct], axis=1), hashed, np.repeat(own, passages, axis=0)]
    return np.concatenate(columns, axis=1).astype(np.float32), bounds


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict
    prior: float | None  # the score of everything, where nothing could be learned


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, bounds: np.ndarray, w: dict) -> dict:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    at = bounds[:-1]
    sizes = np.diff(bounds)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
    a = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "sizes": sizes}


def _gradients(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, w: dict) -> dict:
    f = _forward(x, bounds, w)
    h, t, g, a, sizes = f["h"], f["t"], f["g"], f["a"], f["sizes"]
    err = (f["p"] - y) / len(y)
    dz = np.repeat(err[:, None] * w["c"], sizes, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), sizes))
    dtg = de[:, None] * w["w"]
    dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
    dh = (dz * a[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
    return {
        "W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
        "w": (t * g).T @ de, "c": f["z"].T @ err, "d": err.sum(),
    }


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fit by Adam on the cross entropy of the document labels."""
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    n = x.shape[1]
    w = {
        "W": rng.normal(0, n**-0.5, (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(()),
    }
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    sizes = np.diff(bounds)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(y), BATCH):
            docs = order[a : a + BATCH]
            own = sizes[docs]
            edges = np.concatenate([[0], np.cumsum(own)])
            rows = np.arange(edges[-1]) + np.repeat(bounds[docs] - edges[:-1], own)
            step += 1
            for k, grad in _gradients(x[rows], edges, y[docs], w).items():
                grad = grad + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, None)


def predict(model: Model, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each document, and its passages' attention weights."""
    if model.prior is not None:
        return np.full(len(bounds) - 1, model.prior), np.repeat(1 / np.diff(bounds), np.diff(bounds))
    f = _forward(np.clip((x - model.mean) / model.scale, -6, 6), bounds, model.weights)
    return f["p"], f["a"]


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> Model:
    """Model of ``labelled (doc_id, text, quality)``, from a bounded sample of its rows.

    Rows are picked evenly by a hash of their ids; of their passages no more than
    ``sample_passages`` reach the driver, documents taken in the order of that hash.
    """
    ship(labelled.sparkSession)
    rows = labelled.where("quality is not null").select("doc_id", "text", F.col("quality").cast("int"))
    n = rows.count()
    if n > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample_docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                x, bounds = features(block)
                columns = [batch.column(c).slice(block.first, block.n) for c in ("doc_id", "quality")]
                cells = tb.binary(x.reshape(-1), bounds * x.shape[1])
                yield pa.record_batch([*columns, cells, pa.array(np.diff(bounds).astype(np.int32))], names=["doc_id", "quality", "x", "n"])

    sample = rows.mapInArrow(work, "doc_id long, quality int, x binary, n int")
    xs, ys, sizes = [], [], [0]
    for row in sample.orderBy(F.xxhash64("doc_id"), "doc_id", "n", "quality").toLocalIterator():
        if sum(sizes[-1:]) + row["n"] > sample_passages:
            continue
        xs.append(np.frombuffer(row["x"], np.float32))
        ys.append(row["quality"])
        sizes.append(sizes[-1] + row["n"])
    if not xs:
        return Model(np.zeros(1), np.ones(1), {}, 0.5)
    x = np.concatenate(xs).reshape(sizes[-1], -1)
    return train(x, np.array(sizes), np.array(ys, np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_passages, top_passage``: the passage with the largest weight."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                x, bounds = features(block)
                p, a = predict(sent.value, x, bounds)
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(block.n), sizes)
                order = np.lexsort((np.arange(len(a)), -a, doc))
                top = order[bounds[:-1]] - bounds[:-1]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(block.first, block.n), pa.array(p), pa.array(sizes.astype(np.int32)), pa.array(top.astype(np.int32))],
                    names=["doc_id", "score", "n_passages", "top_passage"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, score double, n_passages int, top_passage int"
    )
