"""Vectorised word features shared by the linear text models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHAPE = np.array([ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57
                   else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array."""
    strings = strings.cast(pa.large_binary())
    data = strings.buffers()[2]
    offset = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset:strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offset[0]:offset[-1]], offset - offset[0]


def _polynomial(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece data[offset[i]:offset[i + 1]] (none empty)."""
    size = np.diff(offset)
    if len(size) == 0:
        return np.zeros(0, dtype=np.uint64)
    power = np.cumprod(np.full(int(size.max()), _ODD, dtype=np.uint64))
    place = np.arange(len(data)) - np.repeat(offset[:-1], size)
    return mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], offset[:-1]))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each (non-empty) word."""
    return _polynomial(*buffers(words))


def shape_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word's shape: letters, capitals and digits as one
    character per run, other characters as themselves, runs collapsed."""
    data, offset = buffers(words)
    kind = _SHAPE[data]
    start = np.zeros(len(kind), dtype=bool)
    start[offset[:-1]] = True
    keep = start.copy()
    keep[1:] |= kind[1:] != kind[:-1]
    count = np.concatenate([[0], np.cumsum(keep)])
    return _polynomial(kind[keep], count[offset])


def sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, value, n)
