"""Vectorised 64-bit hashes of words and word sequences over Arrow text columns, for use inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over its bytes modulo 2**64, mixed.
Sequences hash the word hashes in the same way. Every result is the same on each executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads each bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[32, 9, 10, 11, 12, 13]] = True
_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        n = max(n, 2 * SLICE_BYTES)
        _TABLES["up"], _TABLES["down"] = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
    return _TABLES["up"], _TABLES["down"]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the texts in them); a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[ends[0]:ends[-1]], ends - ends[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES of text each (a longer text alone), which bounds the memory of what follows."""
    _, ends = as_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word; texts do not run into each other."""
    inside = ~_SEPARATES[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    stops[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
    """One hash per word, computed over stretches of SLICE_BYTES so that very long texts need no more memory than short ones."""
    values, out = _LOWER if lower else _VALUES, np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + SLICE_BYTES, "right")))
        base, piece = starts[i], data[starts[i]:stops[j - 1]]
        up, down = _tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[:len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, stops[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def sequence_hashes(words: np.ndarray, k: int, step: int = _STEP) -> np.ndarray:
    """Hash of each run of k consecutive words; none if there are fewer."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(len(words) - k + 1, np.uint64), 1
    if k <= 8:
        for j in range(k):
            out += words[j:len(words) - k + 1 + j] * U(factor)
            factor = factor * step % (1 << 64)
    else:
        up, down = powers(step, len(words)), powers(pow(step, -1, 1 << 64), len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up, out=sums[1:])
        out = (sums[k:] - sums[:-k]) * down[:len(out)]
    return mix(out + U(k))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, a text without words has none."""
    return np.unique(sequence_hashes(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def slice_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each row's words begin and the last one's end) for each slice of a column."""
    for first, last in slices(texts):
        data, ends = as_bytes(texts.slice(first, last - first))
        starts, stops = word_spans(data, ends)
        yield first, word_hashes(data, starts, stops, lower), np.searchsorted(starts, ends)


def documents_words(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) for each text of a column, in order."""
    for first, hashes, at in slice_words(texts, lower):
        for i in range(len(at) - 1):
            yield first + i, hashes[at[i]:at[i + 1]]
