"""Count-min sketch of 64-bit keys, built per partition, merged by slices and kept as one bit a cell.

A cell's bit says "counted twice or more". A key is estimated repeated if its cells in all hash rows are (the least of its
counts is two or more): cells only ever overestimate, so a key with a clear bit occurs once. The size follows the expected number
of keys up to MAX_BITS bits in all (32 MB), which bounds what is broadcast at any input size; a fuller sketch lets more
keys through to the exact pass that follows, and loses none. One more, short row holds whole counts: it tells the few keys that occur
very often.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import mix, small

U = np.uint64
#: Cells are a power of two between these.
MIN_BITS, MAX_BITS = 16, 28
SLICES = 64
#: Cells of the row of counts (a power of two).
COUNTS = 1 << 18
#: Keys that a task holds before it emits its partial sketch.
HELD = 1 << 20
#: Bytes of partial sketches of a slice that one task merges; with more, they are merged in two steps.
MERGED = 1 << 26
SCHEMA = "slice int, salt int, once binary, twice binary, counts binary"
#: Odd multipliers that set the hash rows apart (fixed values).
ROW_SALTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


class Sketch(NamedTuple):
    """One bit for each of 2**width cells of each row, and counts of the cells of the row of counts (none if empty)."""

    width: int
    bits: np.ndarray
    counts: np.ndarray

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are estimated to occur twice or more."""
        out = np.ones(len(keys), bool)
        for row, bits in enumerate(self.bits):
            c = cells(keys, self.width, row)
            out &= (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return out

    def frequent(self, keys: np.ndarray, least: int) -> np.ndarray:
        """Which keys are estimated to occur that often; in a full row of counts that may be many more than do."""
        return self.counts[cells(keys, COUNTS.bit_length() - 1, -1)] >= least


def cells(keys: np.ndarray, width: int, row: int) -> np.ndarray:
    """Cell of each key in a hash row. Keys are mixed first: those chosen as smallest hashes of several crowd at the low end."""
    return (mix(keys * U(ROW_SALTS[row])) >> U(64 - width)).astype(np.uint32)


def width_for(keys: float, cells_each: float, rows: int = 1) -> int:
    """Bits of a cell's number for so many expected keys, with cells_each in all rows together."""
    return min(MAX_BITS - (rows - 1).bit_length(), max(MIN_BITS, math.ceil(math.log2(max(1.0, keys * cells_each / rows)))))


def _partial(held: list[np.ndarray], salt: int, width: int, rows: int, counted: bool) -> pa.RecordBatch:
    """The sketch of the held keys: per slice (of a row) the sorted cells seen, those seen twice, and the slice's counts."""
    keys, each, out = np.concatenate(held), (1 << width) // SLICES, []
    counts = np.bincount(cells(keys, COUNTS.bit_length() - 1, -1), minlength=COUNTS).reshape(SLICES, -1) if counted else [None] * SLICES
    for row in range(rows):
        found = np.sort(cells(keys, width, row))
        same = found[1:] == found[:-1]
        once, twice = found[np.concatenate([[True], ~same])], np.unique(found[1:][same])
        a, b = (np.split(x % each, np.searchsorted(x, np.arange(1, SLICES, dtype=np.int64) * each)) for x in (once, twice))
        out += [(row * SLICES + i, salt, a[i].astype(np.uint32).tobytes(), b[i].astype(np.uint32).tobytes(), counts[i].tobytes() if counted and not row else None) for i in range(SLICES) if len(a[i]) or (counted and not row)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["slice", "salt", "once", "twice", "counts"])


def _merge(batches: Iterator[pa.RecordBatch], width: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Add up the partial sketches of each (slice, salt); rows come sorted by them, one pair is held at a time.

    The last step gives (slice, bits of the cells seen twice, counts); in one function, since a second one behind it would hold a
    second Python worker in each task.
    """
    now, ones, twos, sums, each = None, None, None, None, (1 << width) // SLICES

    def out():
        own = [pa.array([now[0]], pa.int32()), pa.array([None if sums is None else sums.tobytes()], pa.binary())]
        if last:
            return pa.RecordBatch.from_arrays([own[0], pa.array([np.packbits(twos, bitorder="little").tobytes()], pa.binary()), own[1]], names=["slice", "bits", "counts"])
        once, twice = (np.flatnonzero(x).astype(np.uint32).tobytes() for x in (ones, twos))
        return pa.RecordBatch.from_arrays([own[0], pa.array([now[1]], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary()), own[1]], names=["slice", "salt", "once", "twice", "counts"])

    for batch in batches:
        for s, salt, once, twice, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if now != (s, salt):
                if now:
                    yield out()
                now, ones, twos, sums = (s, salt), np.zeros(each, bool), np.zeros(each, bool), None
            once, twice = np.frombuffer(once, np.uint32), np.frombuffer(twice, np.uint32)
            twos[once[ones[once]]] = True
            twos[twice] = True
            ones[once] = True
            if counts is not None:
                sums = np.frombuffer(counts, np.int64) + (0 if sums is None else sums)
    if now:
        yield out()


def build(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keys: float, cells_each: float, hash_rows: int = 1, counted: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """The merged sketch over all keys that keys_of makes of the batches of rows, as the plain parts of a Sketch.

    keys is about their number, and cells_each how many cells each should have in all hash rows; counted adds the row of counts.
    """
    width, salts = width_for(keys, cells_each, hash_rows), max(1, math.ceil(4 * keys / SLICES / MERGED))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        emit = lambda: _partial(held, int(held[0][0]) % salts, width, hash_rows, counted)
        for batch in small(batches):
            for found in keys_of(batch):
                if not len(found):
                    continue
                held.append(found)
                n += len(found)
                if n >= HELD:
                    yield emit()
                    held, n = [], 0
        if n:
            yield emit()

    merged = rows.mapInArrow(partial, SCHEMA)
    for last in (False, True) if salts > 1 else (True,):
        salt = F.lit(0) if last else F.col("salt")
        merged = merged.withColumn("salt", salt.cast("int")).repartition(SLICES * hash_rows, "slice", "salt").sortWithinPartitions("slice", "salt")
        merged = merged.mapInArrow(lambda batches, last=last: _merge(batches, width, last), "slice int, bits binary, counts binary" if last else SCHEMA)
    bits, each = np.zeros((hash_rows, 1 << width >> 3), np.uint8), (1 << width) // SLICES >> 3
    counts = np.zeros((SLICES, COUNTS // SLICES if counted else 0), np.int64)
    # At most SLICES rows for each hash row, 32 MB in all, at any input size.
    for s, part, sums in merged.toLocalIterator():
        row, s = divmod(s, SLICES)
        bits[row, s * each : (s + 1) * each] = np.frombuffer(part, np.uint8)
        if sums is not None:
            counts[s] = np.frombuffer(sums, np.int64)
    return width, bits, counts.ravel()
