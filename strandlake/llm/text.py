"""Whole columns of text as numpy arrays: words, shingles and their hashes.

An Arrow string column holds its texts as one run of UTF-8 bytes, so words of
thousands of documents are found and hashed at once.  Texts go in runs of
about RUN bytes, which keeps the arrays in the processor's cache; a longer
text makes a run of its own, and no text is ever cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN = 1 << 18
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        _powers = tuple(np.multiply.accumulate(np.r_[U(1), np.full(m - 1, b, U)]) for b in (_BASE, _BASE_INV))
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds.astype(np.int64)


def runs(bounds: np.ndarray, size: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = b


def released(batches: Iterator) -> Iterator:
    """``batches``; after the last one the worker, which stays for later tasks, gives free memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@dataclass
class Words:
    """Words of some texts: their hashes, the text of each, how many each text has, and where each begins and ends in the run."""

    hashes: np.ndarray
    text: np.ndarray
    count: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True, gap: np.ndarray = _WHITE) -> Words:
    """Maximal runs of bytes other than ``gap`` (space and 0x09-0x0D), A-Z lower-cased unless told otherwise, of texts at ``bounds`` in ``data``."""
    n_texts, lo, hi = len(bounds) - 1, int(bounds[0]), int(bounds[-1])
    raw, starts = data[lo:hi], bounds[:-1] - lo
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, np.zeros(n_texts, np.int64), none, none)
    black = ~gap[raw]
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    cut[n] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | cut[1:n]
    last = black.copy()
    last[:-1] &= ~black[1:] | cut[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _power_tables(n)
    terms = (_LOWER[raw] if lower else raw).astype(U)
    terms += U(1)
    terms *= power[:n]
    sums = np.cumsum(terms, out=terms)
    before = np.where(a > 0, sums[a - 1], U(0))
    hashes = mix((sums[b] - before) * inverse[a])
    text = np.repeat(np.arange(n_texts), np.diff(np.searchsorted(a, np.r_[starts, n])))
    return Words(hashes, text, np.bincount(text, minlength=n_texts), a, b + 1)


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), U)
    for p in parts:
        h = (h ^ p) * _BASE
        h ^= h >> U(32)
    return mix(h)


def shingles(found: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``width`` words, in text order; a text with fewer words has its whole sequence as one."""
    h, text, count = found.hashes, found.text, found.count
    n = len(h) - width + 1
    full = np.flatnonzero(text[: max(n, 0)] == text[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
    hashes, of = [_chain([h[full + k] for k in range(width)])], [text[full]]
    ends = np.cumsum(count)
    for m in range(1, width):
        short = np.flatnonzero(count == m)
        if len(short):
            at = ends[short] - m
            hashes.append(_chain([h[at + k] for k in range(m)]))
            of.append(short)
    s, d = np.concatenate(hashes), np.concatenate(of)
    if len(of) > 1:
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return s, d


def distinct(s: np.ndarray, of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text one after another, and how many each text has."""
    bounds = np.searchsorted(of, np.arange(n_texts + 1))
    s = s.copy()
    keep = np.ones(len(s), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    keep[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[keep], np.bincount(of[keep], minlength=n_texts)
