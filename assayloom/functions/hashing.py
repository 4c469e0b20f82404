"""Vectorised hashing of words and of runs of words, in numpy."""

from __future__ import annotations

import re

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _33)
    x = x * _M1
    x = x ^ (x >> _33)
    x = x * _M2
    return x ^ (x >> _33)


_BASE = np.uint64(0x100000001B3 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_powers: list[np.ndarray] = []


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 17, 2 * n)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, inverse)]
    return _powers[0], _powers[1]


def hash_words(text: bytes, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of a text's words, the same in every process: mixed polynomials of the bytes.

    A text is taken in blocks that end at white space, so memory follows the block, not the text.
    """
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > block:
            gap = _GAP.search(text, at + block)
            end = gap.start() if gap else end
        b = np.frombuffer(text, np.uint8, end - at, at)
        power, inverse = _powers_of_base(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
        edge = np.ones(len(b) + 2, bool)
        edge[1:-1] = _SPACE[b]
        turn = np.flatnonzero(edge[1:] != edge[:-1])
        start, stop = turn[::2], turn[1::2]
        out.append(mix64((total[stop] - total[start]) * inverse[start] ^ (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` word hashes; of the whole sequence where there are fewer than ``k``."""
    if len(h) == 0:
        return h
    k_now = min(k, len(h))
    n = len(h) - k_now + 1
    out = np.full(n, np.uint64(k_now), dtype=np.uint64)
    for i in range(k_now):
        out *= _STEP
        out += h[i : i + n]
    return mix64(out)
