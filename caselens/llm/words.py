"""Words of a run of texts as hashes: what the quality rules and the near-duplicate search read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bytesets import BYTE_VALUES, LOWER, SPACE, mixed, prefix_hash, row_of, span_hash, spans

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: 64-bit hash of each word's bytes.
    value: np.ndarray
    row: np.ndarray
    #: Words of each row, and where they begin.
    count: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D; with ``lower`` A-Z count as a-z."""
    start, end = spans(~SPACE[data], offsets)
    value = span_hash(prefix_hash(BYTE_VALUES[LOWER[data] if lower else data]), start, end)
    row = row_of(offsets, start)
    count = np.bincount(row, minlength=len(offsets) - 1)
    return Words(start, end, value, row, count, np.cumsum(count) - count)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``n`` words within a row, and the window's hash."""
    m = len(words.value) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    h = np.full(len(at), n, np.uint64)
    for i in range(n):
        h = mixed(h * _STEP + words.value[at + i])
    return at, h
