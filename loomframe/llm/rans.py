"""Static range asymmetric numeral coding of token ids in numpy, many interleaved lanes at once.

Lane j of a block codes its ids j, j + LANES, j + 2 * LANES, ... as one 64-bit state that gives out 32-bit words. All lanes share one
frequency table and one stream of words. A block is coded from its end, so it decodes from its begin; the states at the begin
of each section are kept as checkpoints, from which the sections decode by themselves.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Bits of the frequencies' sum, lanes of a block, ids of a section and sections of a block (fixed values of the format).
BITS, LANES, SECTION, SECTIONS = 20, 4096, 1 << 20, 2
LOW, WORD = U(1 << 31), U(32)


class Table:
    """Frequencies of ids that sum to 2**BITS; every id that occurs has one of 1 at least."""

    def __init__(self, freq: np.ndarray):
        if freq.sum() not in (0, 1 << BITS):
            raise ValueError(f"frequencies sum to {freq.sum()}, not to {1 << BITS}")
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([np.zeros(1, U), np.cumsum(self.freq)[:-1]]) if len(freq) else np.zeros(0, U)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """The table of ids that occur counts times. What rounding gives too much is taken from the most frequent, what is left goes to the first of them."""
        counts = counts.astype(np.int64)
        if np.count_nonzero(counts) > 1 << (BITS - 1):
            raise ValueError(f"more than {1 << (BITS - 1):,} different ids")
        if not counts.any():
            return cls(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / counts.sum() * (1 << BITS)).astype(np.int64)), 0)
        over = int(freq.sum()) - (1 << BITS)
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        while over > 0:
            room = freq[order] // 2
            take = np.minimum(room, np.maximum(0, over - (np.cumsum(room) - room)))
            freq[order] -= take
            over -= int(take.sum())
        return cls(freq)

    @property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The id of each of the 2**BITS slots, and the slot's place among its id's; made when something is decoded."""
        if self._slots is None:
            n = self.freq.astype(np.int64)
            ids = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            self._slots = ids, np.arange(len(ids), dtype=np.uint64) - np.repeat(self.first, n)
        return self._slots


@dataclass
class Section:
    """Part of a block that decodes by itself: how many ids, the lanes' states before the first, its words, and a checksum of the ids."""

    n: int
    states: np.ndarray
    words: np.ndarray
    crc: int


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, section: int = SECTION) -> list[Section]:
    """The sections of a block of ids; section must be a multiple of lanes."""
    if len(ids) and (int(ids.max()) >= len(table.freq) or not table.freq[ids].all()):
        raise ValueError("an id without a frequency")
    lanes_used = min(lanes, len(ids))
    x, shift = np.full(lanes_used, LOW, U), U(BITS)
    limit = U(63 - BITS)
    out: list[Section] = []
    words: list[np.ndarray] = []
    for lo in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        part = ids[lo : lo + lanes]
        y = x[: len(part)]
        f = table.freq[part]
        over = y >= f << limit
        if over.any():
            words.append(y[over].astype(np.uint32))
            y[over] >>= WORD
        q = y // f
        y += q * (U(1 << BITS) - f) + table.first[part]  # q * 2**BITS + (y - q * f) + first
        if lo % section == 0:
            mine = ids[lo : lo + section]
            out.append(Section(len(mine), x.copy(), np.concatenate(words[::-1] or [np.zeros(0, np.uint32)]), crc(mine)))
            words = []
    return out[::-1]


def decode(part: Section, table: Table, lanes: int = LANES) -> np.ndarray:
    """The ids of a section; an error if they don't have its checksum."""
    x, at = part.states.copy(), 0
    out = np.empty(part.n, np.uint32)
    (slots, places), mask = table.slots, U((1 << BITS) - 1)
    for lo in range(0, part.n, lanes):
        y = x[: min(lanes, part.n - lo)]
        slot = y & mask
        found = slots[slot]
        out[lo : lo + len(y)] = found
        y >>= U(BITS)
        y *= table.freq[found]
        y += places[slot]
        low = np.flatnonzero(y < LOW)
        if len(low):
            more = part.words[at : at + len(low)]
            if len(more) < len(low):
                raise ValueError("a section ends too early")
            y[low] = y[low] << WORD | more
            at += len(low)
    if at != len(part.words) or crc(out) != part.crc:
        raise ValueError("a section does not have its checksum")
    return out
