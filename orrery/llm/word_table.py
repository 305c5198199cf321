"""Texts as arrays of characters with their classes, and a table of words' ids: what the two encoders share."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Texts with characters from here on, or unassigned ones, are not divided here.
FAR = 0x530
BLANK, SPACE, LETTER, NUMBER, OTHER, FOREIGN = range(6)


def _class_of(c: str) -> int:
    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return BLANK if c == " " else SPACE
    kind = unicodedata.category(c)
    return FOREIGN if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


CLASS = np.array([*[_class_of(chr(k)) for k in range(FAR)], FOREIGN], np.uint8)
_AFTER_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
_AFTER_TWO = ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))


def codes_of(text: str) -> np.ndarray:
    """The code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def contractions(codes: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Changes ``start`` where an apostrophe that begins a word makes one with s, t, m, d, re, ve or ll behind it in the same text.

    first: where texts begin, with one more entry for the end.
    """
    n = len(codes)
    quote = np.flatnonzero(start & (codes == 39))
    quote = quote[~first[quote + 1]]
    short = quote[np.isin(codes[quote + 1], _AFTER_ONE)]
    rest = quote[~first[np.minimum(quote + 2, n)]]
    long = rest[np.any([(codes[rest + 1] == x) & (codes[rest + 2] == y) for x, y in _AFTER_TWO], axis=0)]
    for found, length in ((short, 2), (long, 3)):
        start[found + 1] = False
        behind = found + length
        start[behind[behind < n]] = True


class Table:
    """Packed ids by a word's 64-bit hash (two of a million words share one with probability 3e-8); open addressing in arrays."""

    def __init__(self, kind: str, most: int) -> None:
        self.bits = max(4, int(most - 1).bit_length() + 1)
        self.most, self.size = most, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << self.bits, np.int32)
        self.pool, self.filled = np.zeros(1 << 12, kind), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            here = self.keys[slot]
            hit = here == keys[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New keys, each once, and their packed ids."""
        flat = np.frombuffer(b"".join(ids), self.pool.dtype)
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        count = np.array([len(one) for one in ids], np.int64) // self.pool.itemsize
        at = self.filled + np.cumsum(count) - count
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.size += len(keys)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, mine = np.unique(slot[free], return_index=True)
            done = free[mine]
            self.keys[taken], self.at[taken], self.count[taken] = keys[left[done]], at[left[done]], count[left[done]]
            on = np.ones(len(left), bool)
            on[done] = False
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots one after another, and how many before each (one more entry ends the last)."""
        count = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return self.pool[np.arange(ends[-1]) + np.repeat(self.at[slots] - ends[:-1], count)], ends
