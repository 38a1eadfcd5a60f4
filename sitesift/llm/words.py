"""Vectorised 64-bit hashes of words and of runs of words, over many texts at once."""

from __future__ import annotations

import numpy as np

GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least ``n`` of them."""
    global _power
    if len(_power) < n:
        out = np.full(max(n, 1024), _BASE, np.uint64)
        out[0] = 1
        _power = np.cumprod(out)
    return _power


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts in a row.

    ``hashes``, ``starts`` and ``ends`` (byte positions in ``raw``) by word; text i has the words
    ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        self.raw = joined
        gap = GAP[raw]
        step = np.diff(np.concatenate([[True], gap]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        if len(self.ends) > len(self.starts):
            self.ends = self.ends[-len(self.starts) :] if len(self.starts) else self.ends[:0]
        if lower:
            raw = LOWER[raw]
        n = self.ends - self.starts
        self.hashes = np.zeros(len(n), np.uint64)
        if len(n):
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            inside = np.flatnonzero(~gap)
            place = np.arange(len(inside)) - np.repeat(at, n)
            self.hashes = mix(np.add.reduceat(_BYTE[raw[inside]] * powers(int(n.max()) + 1)[place], at) + n.astype(np.uint64))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.starts, text_ends)]).astype(np.int64)

    def runs(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on; runs that leave their text mean nothing."""
        return run_hashes(self.hashes, size)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    p = powers(size + 1)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    if size <= 12:
        for k in range(size):
            out += hashes[k : k + len(out)] * p[k]
        return mix(out)
    # a run is made of runs of half the length
    half = run_hashes(hashes, size // 2)
    out += half[: len(out)] + half[size // 2 : size // 2 + len(out)] * _BASE
    if size % 2:
        out += hashes[size - 1 :] * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased; fewer words than ``size`` are one shingle."""
    w = Words(texts, lower=True)
    all_runs = w.runs(size)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(all_runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.add.reduce(w.hashes[a:b] * powers(size + 1)[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
