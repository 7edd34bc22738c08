"""Vectorised word handling over Arrow binary columns (numpy over the column's own buffer).

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 that equals the same rule on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Documents are handled in groups of about so many bytes; a longer document is a group of its own.
GROUP_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    """The words of a group of documents: ``buf[starts[i]:ends[i]]``; words of document d are ``first[d]:first[d + 1]``."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """``offsets`` start at 0 and end at ``len(buf)``."""
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(buf) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(buf) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def words_in(column: pa.Array, lower: bool = False, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, end document, their words) for groups of a binary column."""
    data, offsets = binary_parts(column)
    for at, to in groups(offsets, limit):
        buf = data[offsets[at] : offsets[to]]
        yield at, to, split_words(lower_ascii(buf) if lower else buf, offsets[at : to + 1] - offsets[at])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def hash_words(words: list[bytes | str]) -> np.ndarray:
    """The same hash for single words."""
    raw = [w.encode() if isinstance(w, str) else w for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in raw], np.int64) if raw else ends
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


def doc_of(first: np.ndarray, n: int) -> np.ndarray:
    """For each word, its document's number in the group."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a code point."""
    return (buf & 0xC0) != 0x80
