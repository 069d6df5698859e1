"""Suffix order by the difference-cover algorithm, in array passes.

Positions not divisible by three are the sample: their triples are sorted and named, and
if names repeat, the string of names is ordered the same way first. The other suffixes are
then sorted by their first symbol and the rank of the sampled suffix that follows, and
merged in. Recursion ends when all names differ, or when a name stands for more symbols
than anybody asks about; equal names then keep any order among themselves.
"""

from __future__ import annotations

import numpy as np

NAME_BITS = 21
#: Texts up to this length have names of at most NAME_BITS bits.
MAX_LENGTH = 3_000_000


def _named(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the triples at ``at``, their names from 1, and whether all differ."""
    key = s[at] << (2 * NAME_BITS) | s[at + 1] << NAME_BITS | s[at + 2]
    order = np.argsort(key)  # equal triples get one name, so their order does not count
    ranked = key[order]
    new = np.ones(len(at), np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(new)
    return order, names, bool(new.all())


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``symbols`` (integers from 1 to 2**21 - 1) in ascending order.

    Suffixes that agree on their first ``depth`` symbols may come in any order among
    themselves; they are neighbours.
    """
    n = len(symbols)
    if n > MAX_LENGTH:
        raise ValueError(f"at most {MAX_LENGTH} symbols at a time")
    # Symbols renamed to 1, 2, ... in their order.
    used = np.bincount(symbols) > 0
    small = np.cumsum(used)
    s = np.concatenate([small[symbols], np.zeros(4, np.int64)])
    return _ordered(s, n, depth, int(small[-1]) if n else 0)


def _ordered(s: np.ndarray, n: int, depth: float, top: int) -> np.ndarray:
    """``top``: the largest symbol."""
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:n].tolist()), np.int64)
    # One more place where n leaves rest 1, so that every place divisible by three has a
    # sampled one after it.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    bits = top.bit_length()
    if 3 * bits < NAME_BITS and depth > 3:
        # Few symbols: a triple written as one number is its own name, already in order.
        names = (s[sample] << (2 * bits) | s[sample + 1] << bits | s[sample + 2]) + 1
        order, distinct = sample, False
    else:
        order, names, distinct = _named(s, sample)
    if not distinct and depth > 3:
        # The mod-1 names, a gap that is less than any name, then the mod-2 names.
        string = np.concatenate([names[: len(one)], [0], names[len(one) :], [0, 0, 0, 0]])
        below = _ordered(string, len(names) + 1, depth / 3, int(names.max()))
        below = below[below != len(one)]
        order = below - (below > len(one))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] << 32 | rank[rest + 1])]
    # How many sampled suffixes are less than each of the others.
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    less = np.searchsorted(s[ones] << 32 | rank[ones + 1], s[rest] << 32 | rank[rest + 1])

    def pair(i: np.ndarray) -> np.ndarray:
        return (s[i] << NAME_BITS | s[i + 1]) << NAME_BITS | rank[i + 2]

    less = less + np.searchsorted(pair(twos), pair(rest))
    less = np.maximum.accumulate(less)
    out = np.empty(n, np.int64)
    place = less + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out
