"""Array kernels over the texts of one Arrow batch: words, rolling hashes, window anchors.

A batch is cut into blocks of whole documents of a few MB, so that the work arrays stay
small; only a single longer document makes a larger block.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 256 << 10
U64 = np.uint64
# Runs whose anchors are looked for at once.
SEARCHED = 4096
# Powers that outlive a task, for each seed.
KEPT_POWERS = 4 << 20


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive tasks, stages and jobs."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def given_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, with :func:`give_back` once it has ended and holds nothing any more."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return whole


class Texts:
    """Documents of a block: UTF-8 bytes end to end, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Blocks of whole documents; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)
    bounds = bounds[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = max(last, first + 1)
        part = bounds[first : last + 1]
        yield Texts(data[part[0] : part[-1]], part - part[0], first)
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; every other byte stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def white_space() -> np.ndarray:
    """Which bytes part words: space and 0x09-0x0D."""
    gap = np.zeros(256, bool)
    gap[32] = True
    gap[9:14] = True
    return gap


def words(block: Texts, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the number of its first word.

    Words are maximal runs of bytes that are no ``gap``, inside one document.
    """
    n = len(block.data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(block.n + 1, np.int64)
    inside = ~(white_space() if gap is None else gap)[block.data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = block.offsets[(block.offsets > 0) & (block.offsets < n)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.offsets)


def mix(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    part = x >> U64(30)
    out = np.bitwise_xor(x, part, out=out)
    out *= U64(0xBF58476D1CE4E5B9)
    part = out >> U64(27)
    out ^= part
    out *= U64(0x94D049BB133111EB)
    part = out >> U64(31)
    out ^= part
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of a base and of its inverse; a worker keeps one table a seed."""
    if seed in _POWERS and len(_POWERS[seed][0]) >= size:
        return _POWERS[seed]
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64) | 5
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    if size <= KEPT_POWERS:
        _POWERS[seed] = out[0], out[1]
    return out[0], out[1]


def _sized(n: int) -> int:
    return max(1 << 16, 1 << (n + 1).bit_length())


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed * 977 + 13))


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well spread number for each byte; no byte is out of the table's range to clip."""
    return _byte_values(seed).take(data, mode="clip")


class Rolling:
    """Hashes of any stretch of a sequence, from one running sum.

    Polynomial modulo 2**64 with an odd base over well spread values; the result is
    mixed. ``seed`` picks base and values, so two seeds give a 128-bit key.
    """

    def __init__(self, values: np.ndarray, seed: int = 0):
        ups, self.downs = _powers(seed, _sized(len(values)))
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * ups[: len(values)], out=self.sums[1:])
        self.seed = seed

    @classmethod
    def of_bytes(cls, data: np.ndarray, seed: int = 0) -> Rolling:
        return cls(byte_values(data, seed), seed)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.downs[start]
        return mix(raw + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of ``k`` values."""
        if len(self.sums) <= k:
            return np.zeros(0, U64)
        raw = self.sums[k:] - self.sums[:-k]
        raw *= self.downs[: len(raw)]
        return mix(raw, raw)


def word_hashes(block: Texts, start, end, seed: int = 0, lower: bool = False) -> np.ndarray:
    data = lowered(block.data) if lower else block.data
    return Rolling.of_bytes(data, seed)(start, end)


class Runs:
    """Window starts of a block that share an anchor, as stretches of places.

    A window is ``length`` consecutive units of one document. Its anchor is the gram of
    ``k`` units with the least hash (its high 32 bits) inside it, the leftmost of equals. The
    choice looks at nothing outside the window, so equal windows have equal anchors at equal
    places, wherever they stand. ``first``/``last``: starts of the first and last window of a
    run; ``anchor``: place of its anchor; ``doc``: number of its document.
    """

    def __init__(self, grams: np.ndarray, bounds: np.ndarray, length: int, k: int):
        span = length - k + 1
        n = len(grams) - span + 1
        self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
        # Windows of a document start from its first unit to its last but length - 1.
        docs = np.flatnonzero(np.diff(bounds) >= length)
        if n <= 0 or not len(docs):
            return
        start, stop = bounds[docs], bounds[docs + 1] - length + 1
        hashes = (grams >> U64(32)).astype(np.uint32)
        least = _least(hashes, span)
        # An anchor gives way to a lesser gram that enters, or when the window leaves it behind.
        entered = np.zeros(n, bool)
        np.less(least[1:], least[:-1], out=entered[1:])
        new = entered.copy()
        new[1:] |= hashes[: n - 1] == least[:-1]
        new[start] = True
        new[stop[stop < n]] = True
        cuts = np.append(np.flatnonzero(new), n)
        doc = np.searchsorted(start, cuts[:-1], side="right") - 1
        at = np.flatnonzero((doc >= 0) & (cuts[:-1] < stop[doc]))
        self.first, self.last, self.doc = cuts[at], cuts[at + 1] - 1, docs[doc[at]]
        # The gram that entered, or the one that is left behind next; else it is looked for.
        fresh = entered[self.first]
        self.anchor = np.where(fresh, self.first + (span - 1), self.last)
        rest = np.flatnonzero(~fresh & (hashes[self.last] != least[self.first]))
        for some in np.split(rest, np.arange(SEARCHED, len(rest), SEARCHED)):
            inside = hashes[self.first[some][:, None] + np.arange(span)]
            self.anchor[some] = self.first[some] + inside.argmin(axis=1)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values."""
    held = [np.empty_like(values), np.empty_like(values)]
    width = 1
    while width < span:
        step = min(width, span - width)
        n = len(values) - step
        values = np.minimum(values[:n], values[step:], out=held[0][:n])
        held.reverse()
        width += step
    return values


def binary(values: np.ndarray, bounds: np.ndarray | None = None) -> pa.Array:
    """Arrow binary cells: the bytes of ``values`` cut at ``bounds`` (in elements)."""
    values = np.ascontiguousarray(values)
    bounds = np.array([0, len(values)]) if bounds is None else bounds
    places = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(values.data.cast("B"))]
    ) if len(values) else pa.array([b""] * (len(places) - 1), pa.binary())


def planes(values: np.ndarray) -> np.ndarray:
    """Numbers as bytes: all lowest ones, then all second ones, ... Where numbers are small
    the high ones are runs of zeros, which any compression takes away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def unplanes(raw: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def text_slices(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``limit`` bytes of text each, and their texts (null: "")."""
    column = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first), column.slice(first, last - first).to_pylist()
        first = last
