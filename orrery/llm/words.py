"""Words of Arrow text columns as NumPy arrays: no Python object is made per word.

A text column is read as its UTF-8 buffer and cut into chunks of whole rows of about
``CHUNK_BYTES``, so temporaries stay in cache and memory stays bounded whatever the batch
holds; one text longer than that is a chunk of its own.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
KEPT_POWERS = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Words are the runs of bytes that are not ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words are the runs of ASCII digits, ASCII letters and bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each row begins (one more entry ends the last)."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, lower: bool, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column; ``lower`` maps A-Z to a-z."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    values = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        data = values[offsets[first] : offsets[last]]
        yield Chunk(first, last, _LOWER[data] if lower else data, offsets[first : last + 1] - offsets[first])
        first = last


def spans(chunk: Chunk, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each row (one more entry ends the last)."""
    inside = table[chunk.data]
    n = len(inside)
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    edges = chunk.bounds
    begins[0] = True
    begins[1:n] = ~inside[: n - 1]
    begins[edges] = True
    begins[:n] &= inside
    begins[n] = False
    ends[1:n] = ~inside[1:]
    ends[edges] = True
    ends[1:] &= inside
    ends[0] = False
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, edges)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, n at least; kept for up to KEPT_POWERS."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_MULTIPLIER, _INVERSE):
        full = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        full[0] = 1
        made.append(np.multiply.accumulate(full))
    if n <= KEPT_POWERS:
        _POWERS[:] = made
    return made[0], made[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the bytes stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes() of single words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in words], np.int64)
    return hashes(data, starts, ends)


def grams(values: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each row, and each row's first n-gram (one more entry ends the last).

    firsts: as of spans().  A row of fewer than n words has none.
    """
    counts = np.maximum(np.diff(firsts) - (n - 1), 0)
    out_firsts = np.concatenate([[0], np.cumsum(counts)])
    total = len(values) - n + 1
    if total <= 0 or not out_firsts[-1]:
        return np.zeros(0, np.uint64), out_firsts
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + values[k : k + total]
    at = np.arange(out_firsts[-1]) - np.repeat(out_firsts[:-1], counts) + np.repeat(firsts[:-1], counts)
    return mix(acc[at]), out_firsts
