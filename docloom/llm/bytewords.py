"""Words of many texts at once, found and hashed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: ASCII white space: the characters that end a word.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 modulo 2**64, and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, _U)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a run of texts; ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def slices(texts: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds) of successive runs of whole texts of about ``most_bytes``; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, bounds: np.ndarray, stop: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Words:
    """Maximal runs of bytes outside ``stop`` in each text, hashed after ``fold``."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~stop[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    ends = inside[:n] & ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]  # a word never crosses from one text into the next
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[fold[data]] * up[:n], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start])
    return Words(data, bounds, start, end, np.searchsorted(start, bounds), hashes)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` successive words."""
    n = max(0, len(hashes) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, width, _U)
        for k in range(width):
            out += hashes[k : k + n] * (mix(np.array([1000 + k], _U))[0] | _U(1))
        return mix(out)
