"""A count-min sketch over 64-bit hashes, merged from the sketches of all partitions.

A row of ``2**CELL_BITS`` cells, so many that hashes hardly ever share one, is held by the
cells that are touched: a hash adds one to its cell, whose count is its estimate and never
below the true one. Only "once" against "more" is asked, so counts saturate at two and a
partition sends a cell at most twice. Cells are dealt out in slices, whose number follows
the input. Of the merged sketch the cells above one go to the tasks, as a Bloom filter of
``BITS_EACH`` bits for each of them and at most ``2**bits`` (64 MB at the default): beyond
that it lets more hashes through and never loses one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import file_bytes
from . import textblocks as tb
from .staging import discard, staged

CELL_BITS = 40
CELL_BYTES = 5
BITS = 29
BITS_EACH = 16
PROBES = 3
SLICE_BITS = 20
# Slices of cells, as a power of two: at least, and the stored bytes of input for each.
LEAST_SLICES = 6
BYTES_PER_SLICE = 64 << 20


def _cells(hashes: np.ndarray) -> np.ndarray:
    mixed = tb.mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    return mixed >> np.uint64(64 - CELL_BITS)


def _probes(cells: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Places of cells in a stretch of ``2**width`` bits, one array for each probe."""
    mixed = tb.mix(cells + np.uint64(1))
    step = mixed >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((mixed + np.uint64(i) * step) & np.uint64((1 << width) - 1)).astype(np.int64)


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bits_for(n: int, each: int, most: int) -> int:
    """Bits of a bitmap with ``each`` for ``n`` entries, as a power of two up to ``most``."""
    return min(most, max(1 << 10, n * each).bit_length())


def _held(cells: np.ndarray) -> bytes:
    """Sorted cells as the bytes of their differences."""
    return tb.planes(np.diff(cells, prepend=cells.dtype.type(0)))[:CELL_BYTES].tobytes()


def _unheld(raw: bytes) -> np.ndarray:
    n = len(raw) // CELL_BYTES
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :CELL_BYTES] = np.frombuffer(raw, np.uint8).reshape(CELL_BYTES, n).T
    return np.cumsum(whole.view("<u8").reshape(-1), dtype=np.uint64)


class Marks:
    """A Bloom filter of (long, long) pairs: no pair put in is ever missing."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in _pair_cells(a, b, self.bits):
            out &= _has(self.packed, at)
        return out


def _pair_cells(a: np.ndarray, b: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    return _probes(tb.mix(a.astype(np.uint64)) + b.astype(np.uint64), bits)


def marks(rows: DataFrame, pair: list[str], bits: int = BITS) -> Marks:
    """Filter of ``2**bits`` bits of the two columns of ``rows``."""
    one, two = pair
    width = min(SLICE_BITS, bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in pair)
            cell = np.unique(np.concatenate(list(_pair_cells(a, b, bits))))
            yield from _sliced(cell, width)

    return Marks(_packed(rows.select(one, two).mapInArrow(cells, SLICE), bits, width), bits)


SLICE = "slice int, cells binary"


def _sliced(cells: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Sorted cell numbers by slices of ``2**width`` cells.

    A slice's cell holds how many numbers lie in each 65,536 cells, and their low halves.
    """
    if not len(cells):
        return
    low = min(width, 16)
    number = cells >> width
    full = np.unique(number)
    cuts = np.searchsorted(number, np.append(full, full[-1] + 1))
    blobs = []
    for s, a, b in zip(full, cuts[:-1], cuts[1:]):
        own = cells[a:b] & ((1 << width) - 1)
        counts = np.bincount(own >> low, minlength=1 << (width - low)).astype(np.uint32)
        blobs.append(counts.tobytes() + (own & ((1 << low) - 1)).astype(np.uint16).tobytes())
    yield pa.record_batch(
        [pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "cells"]
    )


def _packed(parts: DataFrame, bits: int, width: int) -> np.ndarray:
    """A bitmap, set where a number fell."""
    low = min(width, 16)
    heads = 1 << (width - low)

    def merged(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << width, bool)
        for batch in batches:
            for cell in batch.column("cells"):
                raw = cell.as_buffer()
                held = np.frombuffer(raw, np.uint32, heads)
                lows = np.frombuffer(raw, np.uint16, offset=4 * heads)
                seen[np.repeat(np.arange(heads) << low, held) + lows] = True
        yield _stretch(key[0].as_py(), np.packbits(seen, bitorder="little"))

    return _joined(parts.groupBy("slice").applyInArrow(merged, STRETCH), bits)


STRETCH = "slice int, bits binary"


def _stretch(number: int, packed: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([number], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["slice", "bits"])


def _joined(stretches: DataFrame, bits: int) -> np.ndarray:
    """The bitmap whose stretches the rows hold."""
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in stretches.toLocalIterator():
        packed = np.frombuffer(row["bits"], np.uint8)
        out[row["slice"] * len(packed) : (row["slice"] + 1) * len(packed)] = packed
    return out


class Cells:
    """The cells above one of the merged sketch, each slice in its own stretch of the filter."""

    def __init__(self, packed: np.ndarray, bits: int, slices: int):
        self.packed, self.bits, self.slices = packed, bits, slices

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        cells = _cells(hashes)
        width = self.bits - self.slices
        first = (cells >> np.uint64(CELL_BITS - self.slices)).astype(np.int64) << width
        out = np.ones(len(hashes), bool)
        for at in _probes(cells, width):
            out &= _has(self.packed, first + at)
        return out


class Sketch:
    def __init__(self, cells: Cells):
        self.cells = cells

    def broadcast(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self.cells)

    @classmethod
    def of(
        cls, rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS
    ) -> Sketch:
        """Sketch of all 64-bit hashes that ``hashes`` finds in the batches of ``rows``."""
        wanted = (file_bytes(rows) // BYTES_PER_SLICE).bit_length()
        slices = min(max(LEAST_SLICES, wanted), bits - 3)  # a stretch is a byte at least

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            size = 0

            def out():
                cells = np.sort(_cells(np.concatenate(held) if held else np.zeros(0, np.uint64)))
                third = np.zeros(len(cells), bool)
                third[2:] = (cells[2:] == cells[1:-1]) & (cells[1:-1] == cells[:-2])
                cells = cells[~third]
                number = (cells >> np.uint64(CELL_BITS - slices)).astype(np.int32)
                full, first = np.unique(number, return_index=True)
                blobs = [_held(cells[a:b]) for a, b in zip(first, np.append(first[1:], len(cells)))]
                yield pa.record_batch([pa.array(full), pa.array(blobs, pa.binary())], names=["slice", "cells"])

            for batch in batches:
                for found in hashes(batch):
                    held.append(found)
                    size += len(found)
                    if size > 1_000_000:
                        yield from out()
                        held, size = [], 0
            yield from out()

        def merged(
            key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
        ) -> Iterator[pa.RecordBatch]:
            parts = [_unheld(cell.as_buffer()) for batch in batches for cell in batch.column("cells")]
            cells = np.sort(np.concatenate(parts))
            del parts
            again = np.zeros(len(cells), bool)
            again[1:] = cells[1:] == cells[:-1]
            again[2:] &= cells[2:] != cells[:-2]  # once each
            again = cells[again]
            yield pa.record_batch(
                [pa.array([key[0].as_py()], pa.int32()), pa.array([len(again)], pa.int64()), pa.array([_held(again)], pa.binary())],
                names=["slice", "n", "cells"],
            )

        above = rows.mapInArrow(partial, SLICE).groupBy("slice").applyInArrow(merged, "slice int, n long, cells binary")
        above = staged(above, "sketch")
        bits = max(bits_for(above.agg(F.sum("n")).first()[0] or 0, BITS_EACH, bits), slices + 3)

        def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, cell in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                    seen = np.zeros(1 << (bits - slices), bool)
                    for at in _probes(_unheld(cell.as_buffer()), bits - slices):
                        seen[at] = True
                    yield _stretch(number, np.packbits(seen, bitorder="little"))

        packed = _joined(above.select("slice", "cells").mapInArrow(stretches, STRETCH), bits)
        discard(above)
        return cls(Cells(packed, bits, slices))
