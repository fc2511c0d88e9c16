"""Fill-in-the-middle rewriting of documents, whole Arrow batches at a time.

A kernel reads the UTF-8 buffer of a batch: a table gives each byte its class, the classes of two neighbouring bytes tell whether
a unit begins between them, running sums that begin anew at each document number the units, and one searchsorted finds the bytes at
which all documents are cut. The parts are slices of the same buffer, joined by Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import SEPARATORS, STEP_BYTES, free_of, fresh, light, small, with_fields

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 90, 20, 1


def _units(inner: bytes, begins: list[list[bool]]) -> tuple[np.ndarray, np.ndarray]:
    classes = np.zeros(256, np.uint8)
    classes[list(inner)] = 1
    return classes, np.array(begins)


#: By unit, the class of each byte, and whether a unit begins between classes (left, right). Code points begin at bytes that continue none;
#: words begin where white space ends, so a word carries the white space behind it.
UNITS = {
    "chars": _units(bytes(range(0x80, 0xC0)), [[True, False], [True, False]]),
    "words": _units(SEPARATORS, [[False, False], [True, False]]),
}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """Offsets and bytes of a string column without nulls, and the buffer that holds them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int32)
    data = data if data is not None else pa.py_buffer(b"")
    return at.astype(np.int64), np.frombuffer(data, np.uint8), data


class Cutter:
    """Units of the documents data[at[i]:at[i+1]]; taken in stretches, so that a long document needs no large arrays."""

    def __init__(self, at: np.ndarray, data: np.ndarray, unit: str = "chars"):
        self.at, self.data = at, data
        self.classes, self.begins = UNITS[unit]
        before = np.zeros(len(at), np.int64)  # units before each document
        for lo, total, upto in self._stretches():
            k = slice(*np.searchsorted(at, [lo + 1, lo + len(upto) + 1]))
            before[k] = total + upto[at[k] - lo - 1]
        self.before = before

    def _stretches(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first byte, units before it, running number of units in the stretch)."""
        total, last = 0, int(self.at[-1])
        for lo in range(int(self.at[0]), last, STEP_BYTES):
            hi = min(lo + STEP_BYTES, last)
            kind = self.classes[self.data[lo:hi]]
            left = np.empty_like(kind)
            left[0] = self.classes[self.data[lo - 1]] if lo else 0
            left[1:] = kind[:-1]
            mask = self.begins[left, kind]
            # A document that is not empty begins with a unit.
            heads = self.at[slice(*np.searchsorted(self.at, [lo, hi]))]
            mask[heads - lo] = True
            upto = np.cumsum(mask, dtype=np.int32)
            yield lo, total, upto
            total += int(upto[-1])

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """The byte behind the first units[i] units of document i, for all documents and several cuts each (units is documents x cuts)."""
        n = self.counts()[:, None]
        out = np.broadcast_to(self.at[1:, None], units.shape).copy()
        wanted = np.where(units < n, self.before[:-1, None] + units, -1)
        for lo, total, upto in self._stretches():
            here = (wanted >= total) & (wanted < total + int(upto[-1]))
            out[here] = lo + np.searchsorted(upto, wanted[here] - total + 1)
        return out


def slices(data: pa.Buffer, edges: np.ndarray) -> list[pa.Array]:
    """Columns of the parts data[edges[i, j]:edges[i, j+1]], j by j, without a copy of the bytes before they are picked."""
    rows, k = len(edges), edges.shape[1] - 1
    flat = pa.Array.from_buffers(pa.binary(), rows * (k + 1) - 1 if rows else 0, [None, pa.py_buffer(edges.astype(np.int32).ravel()), data])
    return [flat.take(pa.array(np.arange(rows) * (k + 1) + j)) for j in range(k)]


def rewrite(column: pa.Array, hashes: np.ndarray, unit: str, rate: int, spm_rate: int) -> tuple[pa.Array, ...]:
    """(units, form, prefix units, middle units, output) of a batch of texts; hashes is documents x 4."""
    texts = column.fill_null("") if column.null_count else column
    at, data, buffer = buffers(texts)
    cutter = Cutter(at, data, unit)
    n = cutter.counts()
    marked = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (np.diff(at) == 0) | marked | (hashes[:, 2] % 100 >= rate)
    spm = hashes[:, 3] % 100 < spm_rate
    pair = np.sort(hashes[:, :2] % (n[:, None] + 1), axis=1) * ~plain[:, None]
    edges = np.concatenate([at[:-1, None], cutter.cuts(pair), at[1:, None]], 1)
    before, middle, after = slices(buffer, edges)
    marks = [pa.scalar(m.encode(), pa.binary()) for m in (PREFIX, SUFFIX, MIDDLE, "")]
    swap = pa.array(spm)
    first = [pc.if_else(swap, b, a) for a, b in ((marks[0], marks[1]), (before, after))]
    second = [pc.if_else(swap, b, a) for a, b in ((marks[1], marks[0]), (after, before))]
    joined = pc.binary_join_element_wise(*first, *second, marks[2], middle, marks[3])
    output = pc.if_else(pa.array(plain), texts.cast(pa.binary()), joined).view(pa.string())
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    parts = [pa.array(x, pa.int64(), mask=plain) for x in (pair[:, 0], pair[:, 1] - pair[:, 0])]
    return pa.array(n, pa.int64()), pa.array(form, pa.string()), *parts, output


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix_units, middle_units and output.

    A text is cut behind two numbers of units (code points, or words with the white space behind them) drawn by a hash of seed and id; psm is
    prefix, suffix, middle behind their marks, spm is suffix, prefix, middle. rate of 100 documents are rewritten, spm_rate of
    100 of these as spm. A null text counts as empty; empty texts, and those that hold a mark, stay plain, with null parts. Both cuts
    may fall together, at an end too (a tie): the parts are then empty. Rows that repeat an id are cut by the same draws, a null id
    draws like an empty one. Very long texts are measured in stretches. An empty table gives an empty one. Columns of docs
    with the names of the added ones are replaced.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    docs = free_of(docs, "n_units", "form", "prefix_units", "middle_units", "output")
    digest, *names = fresh(docs, "_lf_digest", *(f"_lf_h{i}" for i in range(4)))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    keyed = docs.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(names)]
    light(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            drawn = np.stack([c.to_numpy() for c in batch.columns[-4:]], 1)
            added = rewrite(batch.column(at), drawn, unit, rate, spm_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *added], names=out.names)

    out = with_fields(docs, n_units="long", form="string", prefix_units="long", middle_units="long", output="string")
    return keyed.select(*docs.columns, *hashes).mapInArrow(run, out)


def restore(rewritten: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """rewritten with restored, the text that each output was made from; it replaces a column of that name.

    No part holds a mark, nor do a part's end and the next mark together, so the marks split the output into its parts. A null
    output (there is none from fill_in_middle) gives null.
    """
    rewritten = free_of(rewritten, "restored")
    part = lambda i: F.element_at(F.split(output_col, "<[PSM]>"), i)
    back = F.when(F.col(form_col) == "psm", F.concat(part(2), part(4), part(3))).when(F.col(form_col) == "spm", F.concat(part(3), part(4), part(2)))
    return rewritten.withColumn("restored", back.otherwise(F.col(output_col)))
