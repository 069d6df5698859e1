"""Substring dedup: drop words covered by a window that an earlier document also has.

A count-min sketch merged from all partitions overestimates how often the windows around
an anchor occur. A second pass takes only the windows estimated to be repeated and groups
them exactly; since the sketch never underestimates, none is lost.

Rows: a null or short text keeps all its words. Rows repeated with one ``doc_id`` are
treated alike: both texts count as that document's. Rows without ``doc_id`` are dropped.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as rn
from .sketch import BITS
from .staging import staged

WINDOW = 50
GRAM = 20
KEY = ["gram", "key1", "key2"]


def _window_rows(first_of: DataFrame) -> DataFrame:
    """``(gram, hash, low, key1, key2, at)`` of every window of the given classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            content = [np.frombuffer(c.as_buffer(), np.int64) for c in batch.column("content")]
            values = np.concatenate(content) if content else np.zeros(0, np.int64)
            begins = np.cumsum(sizes) - sizes
            at = np.arange(len(values)) - np.repeat(begins, sizes)
            columns = [
                np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)
                for c in ("gram", "key1", "key2", "low")
            ]
            yield pa.record_batch(
                [*map(pa.array, columns), pa.array(values), pa.array(at.astype(np.int32))],
                names=["gram", "key1", "key2", "low", "hash", "at"],
            )

    return first_of.select(*KEY, "low", "n", "content").mapInArrow(
        work, "gram long, key1 long, key2 long, low long, hash long, at int"
    )


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """``doc_id, spans``: the word spans that repeat an earlier document's windows.

    ``gram``: words of an anchor, fewer than ``window``; ``bits``: size of the sketch.
    Neither changes the result.
    """
    unit = rn.Unit("word", window, gram)
    sketch = rn.anchor_sketch(docs, unit, bits)
    found = staged(rn.runs(docs, unit, sketch, "windows"), "word_runs")
    first_of = staged(
        found.groupBy(*KEY).agg(
            F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("content").alias("content")
        ),
        "word_classes",
    )
    # Anchors of several classes: a window may stand in more than one of them.
    several = first_of.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1")
    windows = staged(_window_rows(first_of.join(several, "gram", "left_semi")), "windows")
    lowest = windows.groupBy("gram", "hash").agg(F.min("low").alias("lowest"))
    # A class's own first document keeps a window unless another class had it earlier.
    earlier = (
        windows.join(lowest, ["gram", "hash"])
        .where("lowest < low")
        .groupBy(*KEY)
        .agg(F.collect_list("at").alias("places"))
    )
    told = first_of.select(*KEY, "low").join(earlier, KEY, "left")
    hits = found.select(*KEY, "doc_id", "first", "n").join(told, KEY)
    whole = hits.where("doc_id > low").select(
        "doc_id", F.col("first").alias("a"), (F.col("first") + F.col("n") + (window - 1)).alias("b")
    )
    parts = (
        hits.where("doc_id = low and places is not null")
        .select("doc_id", "first", F.explode("places").alias("at"))
        .select("doc_id", (F.col("first") + F.col("at")).alias("a"), (F.col("first") + F.col("at") + window).alias("b"))
    )
    return rn.spans_of(whole.unionAll(parts), "a", "b")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """Every document with its kept words: ``doc_id, n_words, n_removed, kept``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts, spans = batch.column("text"), batch.column("spans")
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                drop = spans[i].as_py()
                left = words
                if drop:
                    gone = rn.covered(len(words), drop).tolist()
                    left = [w for w, x in zip(words, gone) if not x]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    spans = removed_spans(docs, window, gram, bits)
    joined = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
