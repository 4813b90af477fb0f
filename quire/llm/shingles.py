"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed on byte buffers."""

from __future__ import annotations

import numpy as np

from quire.llm.common import SpanHash, mix

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data; a row's start also begins a word."""
    solid = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | begins[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shingle_sets(off: np.ndarray, data: np.ndarray, n: int):
    """Yields the sorted distinct hashes of the n-word shingles of each row, A-Z in lower case. A row of
    fewer words has one shingle, the whole sequence; a row without words has none."""
    base = off[0]
    data, off = _LOWER[data[base : off[-1]]], off - base
    if not len(data):
        for _ in range(len(off) - 1):
            yield np.zeros(0, _U)
        return
    s, e = word_spans(data, off[:-1][off[:-1] < len(data)])
    w = SpanHash(data).of(s, e)
    cut = np.searchsorted(s, off)
    h = np.zeros(max(0, len(w) - n + 1), _U)
    for j in range(n):
        h *= _U(0x9E3779B97F4A7C15)
        h += w[j : j + len(h)]
    h = mix(h)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= n:
            x = np.sort(h[a : b - n + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            acc = np.full(1, b - a, _U)
            for v in w[a:b]:
                acc = acc * _U(0xC2B2AE3D27D4EB4F) + v
            yield mix(acc)
        else:
            yield np.zeros(0, _U)


def set_hash(x: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set; 0 for the empty one."""
    if not len(x):
        return 0
    h = np.bitwise_xor.reduce(mix(x + _U(0x632BE59BD9B4E019)), keepdims=True)
    h += x.sum(dtype=_U, keepdims=True)
    return int(mix(h).view(np.int64)[0])
