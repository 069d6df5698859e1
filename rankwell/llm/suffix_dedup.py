"""Suffix-array dedup: drop bytes covered by a 100-byte string that also starts earlier.

Windows of ``length`` bytes are looked at as runs with a common anchor (``runs``). A run
whose whole content occurs earlier is dropped with its first occurrence as witness. What
remains are anchors with runs of different content, which may still share windows: their
first occurrences are dealt out by anchor, a stretch of some anchors becomes one text, and
its suffixes are ordered by the difference-cover algorithm: sampled triples are sorted,
names recursed on, the remaining suffixes merged in. In suffix order equal windows are
neighbours, so comparing adjacent prefixes finds the groups; all but a group's first start
go. An anchor with more runs than one text may hold is spread over several, whose groups
are then joined by their window's key.

Rows: a null text counts as empty; a text shorter than the window stays. Rows with equal
``doc_id`` are told apart by their text only: equal rows count as one document's copies,
and of texts with equal starts the order is that of the start. Rows without ``doc_id`` are
dropped. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as rn
from . import textblocks as tb
from .sketch import BITS, BITS_EACH, bits_for, marks
from .staging import staged
from .suffix_array import suffix_array

LENGTH = 100
GRAM = 24
TEXT_BYTES = 300_000
HIT, OPEN = 0, 1
FOUND = "kind int, doc_id long, a int, b int, slice int, cells binary"
SLICE_BYTES = 64 << 20
#: An open window: its key, document and start.
WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("a", "<i8")])


def _groups(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Windows of some runs in suffix order, with group starts.

    ``rows``: ``(doc_id, first, n, content)``. Returns for each window, grouped by
    content: doc, place, two key halves, and whether it is the first of its group in
    (doc, place) order.
    """
    contents = [r[3] for r in rows]
    sizes = np.array([len(c) for c in contents], np.int64)
    # Byte + 2, and 1 after each content.
    text = np.ones(int(sizes.sum() + len(rows)), np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"".join(contents), np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(len(rows)), sizes)
    text[at] = data.astype(np.int64) + 2
    n = np.array([r[2] for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window = np.full(len(text), -1, np.int64)  # number of the window that starts here
    window[begins[owner] + offset] = np.arange(len(owner))
    doc = np.array([r[0] for r in rows], np.int64)[owner]
    first = np.array([r[1] for r in rows], np.int64)[owner] + offset
    order = suffix_array(text, length)
    order = order[window[order] >= 0]
    # Adjacent prefixes, compared by 128-bit keys of the window.
    one, two = (tb.Rolling.of_bytes((text - 1).astype(np.uint8), seed)(order, order + length) for seed in (5, 6))
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group = np.cumsum(new)
    doc, first = doc[window[order]], first[window[order]]
    by = np.lexsort((first, doc, group))
    doc, first, one, two, group = doc[by], first[by], one[by], two[by], group[by]
    leads = np.ones(len(by), bool)
    leads[1:] = group[1:] != group[:-1]
    return doc, first, one, two, leads


def _merged(doc: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts as spans: documents, first byte, byte after the last."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(doc) else at
    return doc[at], place[at], place[last] + length


def _compared(content: DataFrame, length: int, limit: int, slice_bits: int) -> DataFrame:
    """Repeated windows among the runs of each anchor.

    ``HIT``: a span of windows that start earlier too. ``OPEN``: windows that are the first
    in their text, where the anchor has more texts; packed, one row for a slice of the keys.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        open_gram: int | None = None  # an anchor that goes on from the text before

        def compare(rows: list[tuple], split: int | None) -> Iterator[pa.RecordBatch]:
            whole = (list(same) for gram, same in groupby(rows, key=lambda r: r[4]) if gram != split)
            # Runs of one content, which the bitmap let through, are settled by their key.
            several = [r for same in whole if any(r[3] != same[0][3] for r in same) for r in same]
            for i, part in enumerate([several, [r for r in rows if r[4] == split]]):
                if not part:
                    continue
                doc, first, one, two, leads = _groups([r[:4] for r in part], length)
                d, a, b = _merged(doc[~leads], first[~leads], length)
                yield _hits(d, a, b)
                if i:
                    windows = np.zeros(int(leads.sum()), WINDOW)
                    for name, x in zip(WINDOW.names, (one, two, doc, first)):
                        windows[name] = x[leads]
                    yield _open(windows, slice_bits)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "content", "gram")]
            for row in zip(*columns):
                gram = row[4]
                if held and size + len(row[3]) > limit:
                    # Cut before this anchor; where it fills a text alone, through it.
                    same = [r for r in held if r[4] == gram]
                    if gram == held[0][4]:
                        yield from compare(held, gram)
                        held, size, open_gram = [], 0, gram
                    else:
                        rest = [r for r in held if r[4] != gram]
                        yield from compare(rest, open_gram)
                        open_gram = None
                        held, size = same, sum(len(r[3]) + 1 for r in same)
                held.append(row)
                size += len(row[3]) + 1
        if held:
            yield from compare(held, open_gram)

    dealt = content.repartition("gram").sortWithinPartitions("gram", "doc_id", "first")
    return dealt.mapInArrow(work, FOUND)


def _hits(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    columns = [pa.array(np.full(n, HIT, np.int32)), pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
    return pa.record_batch(
        [*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=[c.split()[0] for c in FOUND.split(", ")]
    )


def _open(windows: np.ndarray, slice_bits: int) -> pa.RecordBatch:
    part = (windows["one"] >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(windows), np.int64)
    order = np.argsort(part, kind="stable")
    full, first = np.unique(part[order], return_index=True)
    cuts = np.append(first, len(windows))
    cells = [windows[order[x:y]].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
    n = len(full)
    columns = [pa.array(np.full(n, OPEN, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
    return pa.record_batch(
        [*columns, pa.array(full.astype(np.int32)), pa.array(cells, pa.binary())],
        names=[c.split()[0] for c in FOUND.split(", ")],
    )


def _late(opened: DataFrame, length: int) -> DataFrame:
    """Spans of open windows that start earlier in another text. A window comes at most
    once from each text, so a slice holds no group larger than the number of texts."""

    def settle(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        raw = b"".join(c.as_py() for batch in batches for c in batch.column("cells"))
        x = np.frombuffer(raw, WINDOW)
        x = x[np.lexsort((x["a"], x["doc"], x["two"], x["one"]))]
        again = np.zeros(len(x), bool)
        again[1:] = (x["one"][1:] == x["one"][:-1]) & (x["two"][1:] == x["two"][:-1])
        d, a, b = _merged(x["doc"][again], x["a"][again], length)
        yield pa.record_batch([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "a", "b"])

    return opened.select("slice", "cells").groupBy("slice").applyInArrow(settle, "doc_id long, a int, b int")


def removed_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = BITS, text_bytes: int = TEXT_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``doc_id, spans``: byte spans covered by strings that start earlier.

    ``gram``, ``bits``, ``text_bytes`` (of one suffix array) and ``slice_bytes`` don't change
    the result.
    """
    unit = rn.Unit("byte", length, gram)
    sketch = rn.anchor_sketch(docs, unit, bits)
    key = ["gram", "key1"]
    found = staged(rn.runs(docs, unit, sketch).select(*key, "doc_id", "first", "n"), "byte_runs")
    classes = found.groupBy(*key).agg(F.min(F.struct("doc_id", "first")).alias("low"), F.count("*").alias("copies"))
    classes = staged(classes.select(*key, "low.doc_id", "low.first", "copies"), "byte_classes")
    several = classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1").select("gram")

    repeated = classes.where("copies > 1").select(*key, F.struct("doc_id", "first").alias("low"))
    whole = (
        found.join(repeated, key)
        .where(F.struct("doc_id", "first") > F.col("low"))
        .select("doc_id", F.col("first").alias("a"), (F.col("first") + F.col("n") + (length - 1)).alias("b"))
    )

    # The first occurrences, wherever an anchor has several contents, come once more with
    # their text. A bitmap of bounded size picks them; what it lets through besides are
    # later occurrences, or the only content of their anchor, and change nothing.
    picked = classes.join(several, "gram", "left_semi").select("doc_id", "first")
    picked = staged(picked, "picked")
    n_picked = picked.count()
    wanted = marks(picked, ["doc_id", "first"], bits_for(n_picked, BITS_EACH, bits))
    most = n_picked * (length - gram + 1) * WINDOW.itemsize  # of open windows
    slice_bits = (most // slice_bytes).bit_length()
    content = rn.runs(docs, unit, sketch, "bytes", wanted)
    compared = staged(_compared(content.select("gram", "doc_id", "first", "n", "content"), length, text_bytes, slice_bits), "compared")
    hits = compared.where(F.col("kind") == HIT).select("doc_id", "a", "b")
    late = _late(compared.where(F.col("kind") == OPEN), length)
    return rn.spans_of(whole.unionAll(hits).unionAll(late), "a", "b")


def cut(text: str | None, spans) -> tuple[int, int, int, bytes]:
    """Bytes of the text, bytes and maximal runs removed, and what is left."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not spans:
        return len(data), 0, 0, data.tobytes()
    gone = rn.covered(len(data), spans)
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(data), int(gone.sum()), runs, data[~gone].tobytes()


def suffix_dedup(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in tb.text_slices(batch, "text"):
                cells = [cut(t, s) for t, s in zip(texts, rows.column("spans").to_pylist())]
                n, gone, runs, kept = zip(*cells)
                yield pa.record_batch(
                    [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    spans = removed_spans(docs, length, **options)
    joined = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """A character is gone when all its bytes are."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(np.append(heads, len(data)))
    return np.repeat(np.logical_and.reduceat(gone, heads), sizes)


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, where they make whole characters.

    Documents that had text and lose all of it go; a null or empty text stays as it is.
    """
    schema = docs.schema
    spans = removed_spans(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null"), length, **options)
    place = schema.names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            texts = columns[place].to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found and texts[i]:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    gone = _whole_characters(data, rn.covered(len(data), found))
                    texts[i] = data[~gone].tobytes().decode() or False
            keep = pa.array([t is not False for t in texts])
            columns[place] = pa.array([t or "" if t is not None else None for t in texts], pa.string())
            yield pa.record_batch(columns, names=schema.names).filter(keep)

    spans = spans.select(F.col("doc_id").alias("_cut_id"), F.col("spans").alias("_cut"))
    joined = docs.join(spans, F.col("doc_id") == F.col("_cut_id"), "left").drop("_cut_id")
    return joined.mapInArrow(work, schema)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
