"""Repeated windows of units (words or bytes), found from runs of windows with one anchor.

Windows are handled as runs: stretches of consecutive windows with the same anchor (see
``textblocks.Runs``). Equal windows have equal anchors, so

* an anchor that occurs once has no repeated window around it;
* two runs with equal content hold the same windows, so only the first of them is looked
  at and the others follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .staging import ship
from .sketch import Marks, Sketch

RUN_SCHEMA = "gram long, key1 long, key2 long, doc_id long, first int, n int"


class Unit:
    """What a window is made of: 50 words, or 100 bytes; ``gram`` units make an anchor."""

    def __init__(self, kind: str, length: int, gram: int):
        self.kind, self.length, self.gram = kind, length, gram

    def values(self, block: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each unit, and each document's bounds."""
        if self.kind == "byte":
            return tb.byte_values(block.data), block.offsets
        start, end, bounds = tb.words(block)
        return tb.word_hashes(block, start, end), bounds

    def rolling(self, values: np.ndarray, other: bool = False) -> tb.Rolling:
        """Rolling hash over the units, and an independent ``other``."""
        return tb.Rolling(values, (0 if self.kind == "byte" else 2) + other)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def anchor_sketch(docs: DataFrame, unit: Unit, bits: int) -> Sketch:
    """Sketch of the anchor hashes of all runs."""
    ship(docs.sparkSession)

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in tb.blocks(batch.column("text")):
            values, bounds = unit.values(block)
            grams = unit.rolling(values).grams(unit.gram)
            yield grams[tb.Runs(grams, bounds, unit.length, unit.gram).anchor]

    return Sketch.of(docs.select("text"), anchors, bits)


def runs(
    docs: DataFrame, unit: Unit, sketch: Sketch, content: str | None = None, wanted: Marks | None = None
) -> DataFrame:
    """Runs whose anchor the sketch estimates to occur twice or more.

    ``key1, key2``: 128-bit key of the units from the first window's start to the last
    one's end. ``content``: ``windows`` adds the 64-bit hash of every window, ``bytes``
    the text of the run in place of the key. ``wanted``: only runs that start at a marked
    (doc_id, first).
    """
    seen = sketch.broadcast(docs.sparkSession)
    marked = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = [c for c in RUN_SCHEMA.split(", ") if content != "bytes" or not c.startswith("key")]
    schema += ["content binary"] if content else []
    names = [c.split()[0] for c in schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block in tb.blocks(batch.column("text")):
                values, bounds = unit.values(block)
                one = unit.rolling(values)
                grams = one.grams(unit.gram)
                found = tb.Runs(grams, bounds, unit.length, unit.gram)
                anchors = grams[found.anchor]
                keep = seen.value.repeated(anchors)
                if marked.value is not None:
                    at = np.flatnonzero(keep)
                    places = found.first[at] - bounds[found.doc[at]]
                    keep[at] = marked.value.has(ids[block.first + found.doc[at]].astype(np.int64), places)
                first, last, doc = found.first[keep], found.last[keep], found.doc[keep]
                n = last - first + 1
                end = last + unit.length
                columns = {
                    "gram": _signed(anchors[keep]),
                    "doc_id": pa.array(ids[block.first + doc].astype(np.int64)),
                    "first": pa.array((first - bounds[doc]).astype(np.int32)),
                    "n": pa.array(n.astype(np.int32)),
                }
                if content != "bytes":
                    two = unit.rolling(values, other=True)
                    columns |= {"key1": _signed(one(first, end)), "key2": _signed(two(first, end))}
                if content:
                    sizes = n if content == "windows" else end - first
                    edges = np.concatenate([[0], np.cumsum(sizes)])
                    each = np.arange(edges[-1]) + np.repeat(first - edges[:-1], sizes)
                    held = two(each, each + unit.length) if content == "windows" else block.data[each]
                    columns["content"] = tb.binary(held, edges)
                yield pa.record_batch([columns[c] for c in names], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, ", ".join(schema))


def spans_of(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Spans (from ``first`` to before ``last``) of each document, packed."""
    return rows.groupBy("doc_id").agg(
        F.collect_list(F.struct(F.col(first).alias("a"), F.col(last).alias("b"))).alias("spans")
    )


def covered(n: int, spans) -> np.ndarray:
    """Which of ``n`` units lie in some span (a list of ``{a, b}``)."""
    steps = np.zeros(n + 1, np.int64)
    for span in spans or ():
        steps[span["a"]] += 1
        steps[span["b"]] -= 1
    return np.cumsum(steps[:n]) > 0
