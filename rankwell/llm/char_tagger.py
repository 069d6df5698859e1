"""A character tagger in numpy: a bidirectional LSTM under a linear-chain CRF.

All arrays are time-major; both directions run in one batched product, the second over
the reversed characters. Training is plain Adam on the exact CRF likelihood, its gradient
from the forward and backward sums. The same weights serve short training windows and
windows of any length at decoding.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

HIDDEN = 8
PAD = 0
# Numbers of characters: 0 fills, 1-128 are ASCII, and one each stands for the Latin
# letters, other letters and signs beyond.
SYMBOLS = 132


class Weights(NamedTuple):
    wx: np.ndarray  # direction, character, gates
    wh: np.ndarray  # direction, hidden, gates
    out: np.ndarray  # both hidden states, tag
    bias: np.ndarray
    step: np.ndarray  # from tag, to tag
    first: np.ndarray
    last: np.ndarray


def symbols(code_points: np.ndarray) -> np.ndarray:
    """Numbers of characters, from their code points."""
    out = np.where(code_points < 128, code_points + 1, 130)
    out[(code_points >= 0xC0) & (code_points < 0x250)] = 129
    out[code_points >= 0x2000] = 131
    return out.astype(np.uint8)


def start_weights(tags: int, hidden: int = HIDDEN, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    wx = rng.normal(0, 0.3, (2, SYMBOLS, 4 * hidden))
    wx[:, :, hidden : 2 * hidden] += 1.0  # remember at first
    wh = rng.normal(0, 0.7 / np.sqrt(hidden), (2, hidden, 4 * hidden))
    out = rng.normal(0, 0.3, (2 * hidden, tags))
    return Weights(wx, wh, out, np.zeros(tags), np.zeros((tags, tags)), np.zeros(tags), np.zeros(tags))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


_BOTH = np.arange(2)[:, None]


def _states(w: Weights, x: np.ndarray):
    """Hidden states ``(time, direction, window, hidden)`` of ``x (time, window)``, and what
    the way back needs."""
    steps, n = x.shape
    size = w.wh.shape[1]
    ways = np.stack([x, x[::-1]], axis=1)
    h = np.zeros((2, n, size))
    c = h
    kept = []
    for t in range(steps):
        gates = w.wx[_BOTH, ways[t]] + h @ w.wh
        ifo = _sigmoid(gates[..., : 3 * size])
        new = np.tanh(gates[..., 3 * size :])
        before = c
        c = ifo[..., size : 2 * size] * c + ifo[..., :size] * new
        top = np.tanh(c)
        kept.append((h, before, ifo, new, top))
        h = ifo[..., 2 * size :] * top
    hidden = np.stack([k[0] for k in kept[1:]] + [h])
    return ways, kept, hidden


def _both_ways(hidden: np.ndarray) -> np.ndarray:
    """States of both directions side by side at each place."""
    return np.concatenate([hidden[:, 0], hidden[::-1, 1]], axis=-1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean negative log likelihood of the tags ``y`` of a window, and its gradient."""
    steps, n = x.shape
    tags = len(w.bias)
    ways, kept, hidden = _states(w, x)
    wide = _both_ways(hidden)
    scores = wide @ w.out + w.bias
    at = np.arange(n)

    forward = np.empty_like(scores)
    forward[0] = w.first + scores[0]
    for t in range(1, steps):
        forward[t] = _log_sum(forward[t - 1][:, :, None] + w.step, 1) + scores[t]
    total = _log_sum(forward[-1] + w.last, 1)
    backward = np.empty_like(scores)
    backward[-1] = w.last
    for t in range(steps - 2, -1, -1):
        backward[t] = _log_sum(w.step + (scores[t + 1] + backward[t + 1])[:, None, :], 2)

    gold = w.first[y[0]] + w.last[y[-1]] + scores[0, at, y[0]]
    for t in range(1, steps):
        gold = gold + w.step[y[t - 1], y[t]] + scores[t, at, y[t]]
    loss = float((total - gold).mean())

    d_scores = np.exp(forward + backward - total[:, None])
    pairs = np.exp(
        forward[:-1, :, :, None] + w.step + (scores[1:] + backward[1:])[:, :, None, :] - total[None, :, None, None]
    ).sum(axis=(0, 1))
    d_first, d_last = d_scores[0].sum(axis=0), d_scores[-1].sum(axis=0)
    np.subtract.at(d_first, y[0], 1)
    np.subtract.at(d_last, y[-1], 1)
    np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
    d_scores[np.arange(steps)[:, None], at, y] -= 1

    d_out = np.einsum("tnh,tnk->hk", wide, d_scores)
    d_wide = d_scores @ w.out.T
    size = w.wh.shape[1]
    d_hidden = np.stack([d_wide[..., :size], d_wide[::-1, :, size:]], axis=1)
    d_wx, d_wh = np.zeros_like(w.wx), np.zeros_like(w.wh)
    dh = np.zeros((2, n, size))
    dc = np.zeros((2, n, size))
    for t in range(steps - 1, -1, -1):
        h, before, ifo, new, top = kept[t]
        i, f, o = ifo[..., :size], ifo[..., size : 2 * size], ifo[..., 2 * size :]
        dh = dh + d_hidden[t]
        dc = dc + dh * o * (1 - top * top)
        d_gates = np.concatenate(
            [dc * new * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - new * new)], axis=-1
        )
        np.add.at(d_wx, (_BOTH, ways[t]), d_gates)
        d_wh += h.transpose(0, 2, 1) @ d_gates
        dh = d_gates @ w.wh.transpose(0, 2, 1)
        dc = dc * f
    gradient = Weights(d_wx, d_wh, d_out, d_scores.sum(axis=(0, 1)), pairs, d_first, d_last)
    return loss, Weights(*(g / n for g in gradient))


def train(x: np.ndarray, y: np.ndarray, tags: int, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Weights:
    """Weights fitted to windows ``x (window, time)`` with tags ``y``."""
    w = start_weights(tags, seed=seed)
    rng = np.random.default_rng(seed)
    mean = [np.zeros_like(a) for a in w]
    square = [np.zeros_like(a) for a in w]
    for turn in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        _, gradient = loss_and_gradient(w, x[rows].T, y[rows].T)
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient))
        speed = rate * (1 - 0.9 * turn / steps)
        new = []
        for k, (a, g) in enumerate(zip(w, gradient)):
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            ahead = mean[k] / (1 - 0.9**turn)
            new.append(a - speed * ahead / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-8))
        w = Weights(*new)
    return w


class Decoder:
    """Weights prepared for many windows at once: single precision, one sigmoid a step."""

    def __init__(self, w: Weights):
        size = w.wh.shape[1]
        scale = np.ones(4 * size)
        scale[3 * size :] = 2  # tanh(a) = 2 sigmoid(2 a) - 1
        self.size = size
        # Signs are turned here, so that a step takes exp() as it is.
        self.wx = np.ascontiguousarray(-w.wx * scale, np.float32)
        self.wh = np.ascontiguousarray(-w.wh * scale, np.float32)
        self.out, self.bias = w.out.astype(np.float32), w.bias.astype(np.float32)
        self.step, self.first, self.last = (a.astype(np.float32) for a in (w.step, w.first, w.last))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores ``(time, window, tag)`` of ``x (time, window)``."""
        steps, n = x.shape
        size = self.size
        out = np.broadcast_to(self.bias, (steps, n, len(self.bias))).copy()
        for way in range(2):
            table, wh = self.wx[way], self.wh[way]
            mine = self.out[way * size : (way + 1) * size]
            h = np.zeros((n, size), np.float32)
            c = np.zeros((n, size), np.float32)
            gates = np.empty((n, 4 * size), np.float32)
            back = np.empty_like(gates)
            with np.errstate(over="ignore"):
                for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                    np.take(table, x[t], axis=0, out=gates, mode="clip")
                    np.matmul(h, wh, out=back)
                    gates += back
                    np.exp(gates, out=gates)
                    gates += 1
                    np.reciprocal(gates, out=gates)
                    new = gates[:, 3 * size :]
                    new *= 2
                    new -= 1
                    c *= gates[:, size : 2 * size]
                    new *= gates[:, :size]
                    c += new
                    top = np.exp(-2 * c)
                    top += 1
                    np.divide(2, top, out=top)
                    top -= 1
                    h = gates[:, 2 * size : 3 * size] * top
                    out[t] += h @ mine
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags ``(time, window)`` by Viterbi."""
        scores = self.scores(x)
        steps, n, tags = scores.shape
        back = np.empty((steps, n, tags), np.uint8)
        value = scores[0] + self.first
        for t in range(1, steps):
            best = value[:, :1] + self.step[0]
            where = back[t]
            where[:] = 0
            for a in range(1, tags):
                other = value[:, a : a + 1] + self.step[a]
                better = other > best
                where[better] = a
                np.maximum(best, other, out=best)
            value = best + scores[t]
        tag = (value + self.last).argmax(axis=1).astype(np.uint8)
        out = np.empty((steps, n), np.uint8)
        at = np.arange(n)
        for t in range(steps - 1, -1, -1):
            out[t] = tag
            if t:
                tag = back[t][at, tag]
        return out
