"""Exact removal of repeated word windows behind a count-min prefilter.

Pass 1 sketches the windows: each window is counted under its anchor, the smallest hash among its K_ANCHOR-word
subsequences. Equal windows have equal anchors, so an anchor's count is never below its windows' counts, and
neighbouring windows share an anchor, so there are about ten times fewer of them. Pass 2 takes only windows
whose anchor is estimated repeated, shuffles them by anchor as runs, and groups them exactly; the windows of a very frequent
anchor, such as a common phrase with other words around it, are shuffled one by one. Pass 3 joins the repeated ranges back to
the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm import sketch
from loomframe.llm.common import Hasher, U, as_bytes, binaries, free_of, fresh, light, mix, row_key, signed, small, steps, with_fields

WINDOW = 35
#: Cells of the sketch for each anchor, in all, and its hash rows.
CELLS, HASH_ROWS = 16, 2
#: An anchor that occurs as often as this has each of its windows shuffled by its own hash. The limit is the same at any size of the input.
FREQUENT = 10_000
#: Rows that a task holds while it groups runs of equal anchors.
HELD_ROWS = 20_000
#: Distinct runs that a task remembers to thin out copies before the shuffle (thinning changes no result).
SEEN = 200_000
RUNS = "anchor long, k1 long, k2 long, start int, n int, hashes binary"


def anchors(word_hashes: np.ndarray, hasher: Hasher, bounds: np.ndarray, window: int):
    """Runs of windows with one anchor each: (anchor, first window, windows), and the text of each run."""
    k = window // 2 - 1
    span = window - k + 1  # subsequences of k words in a window
    grams = hasher.windows([word_hashes], k)[0]
    n = len(word_hashes) - window + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # Position of the leftmost smallest gram of each window, by doubling the span compared.
    best = np.arange(len(grams))
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    best = best[:n]
    text = np.searchsorted(bounds, np.arange(n), side="right") - 1
    inside = np.arange(n) + window <= bounds[text + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.concatenate([[True], (best[at][1:] != best[at][:-1]) | (text[at][1:] != text[at][:-1])])
    first = np.flatnonzero(fresh)
    return grams[best[at[first]]], at[first], np.diff(np.append(first, len(at))), text[at[first]]


def frequent_anchors(texts: DataFrame, bits, counts: np.ndarray, window: int, size: int):
    """A sketch whose repeated() holds for all anchors that occur FREQUENT times, and for few others; None if there is none.

    Only anchors whose cell in the row of counts has reached the limit are counted, exactly, in each task first. Those that have reached it
    themselves, at most one in FREQUENT of all, are kept as bits, so that what is broadcast is bounded at any size.
    """
    if not len(counts) or counts.max() < FREQUENT:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sk = Hasher(), sketch.Sketch(*bits.value)
        for batch in small(batches):
            data = as_bytes(batch.column(0))
            for a, b in steps(data):
                (h,), bounds = hasher.words(data[a:b])
                keys = anchors(h, hasher, bounds, window)[0]
                keys, n = np.unique(keys[sk.frequent(keys, FREQUENT)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], names=["anchor", "n"])

    sums = texts.select("t").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = sums.filter(F.col("n") >= FREQUENT).select("anchor")

    def twice(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.repeat(batch.column(0).to_numpy().view(U), 2)

    # A cell is set if it is met twice: each anchor is given two times.
    return sketch.build(often, twice, 2 * size / 60 / FREQUENT, CELLS, 1)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text: words of no window that also starts anywhere else.

    A window is `window` consecutive words of one text; one that starts twice, in the same text or in another, loses
    all its words. Windows are judged on the input. Words are runs of anything but ASCII white space, unchanged.
    A null text has no words and gives an empty kept_text; texts shorter than a window are kept whole; equal rows
    are separate documents, so both lose what they share. Columns of docs with the names of the added ones are
    replaced; rows with a null id are documents like any other; an empty table gives an empty one. Very long texts are hashed in
    stretches and are rows like any other. Hashes of 128 bits stand for windows.
    """
    spark = light(docs.sparkSession)
    docs = free_of(docs, "n_words", "n_removed", "kept_text")
    key1, key2, own1, own2, spans = fresh(docs, "_lf_k1", "_lf_k2", "_lf_r1", "_lf_r2", "_lf_ranges")
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(row_key(F.col(id_col), F.col(text_col)), (key1, key2))))
    texts = keyed.select(F.col(key1).alias("k1"), F.col(key2).alias("k2"), F.col(text_col).alias("t"))

    def sketch_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, hasher = as_bytes(batch.column(0)), Hasher()
        for a, b in steps(data):
            (h,), bounds = hasher.words(data[a:b])
            yield anchors(h, hasher, bounds, window)[0]

    # About 6 bytes a word, and an anchor for ten words.
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    found = sketch.build(texts.select("t"), sketch_keys, size / 60, CELLS, HASH_ROWS, counted=True)
    bits = spark.sparkContext.broadcast(found)
    hot = spark.sparkContext.broadcast(frequent_anchors(texts, bits, found[2], window, size))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, sk, often_at = Hasher(bases=2), {}, sketch.Sketch(*bits.value), hot.value and sketch.Sketch(*hot.value)
        for batch in small(batches):
            data = as_bytes(batch.column(2))
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in steps(data):
                hashes, bounds = hasher.words(data[a:b])
                anchor, first, n, text = anchors(hashes[0], hasher, bounds, window)
                hit = sk.repeated(anchor)
                anchor, first, n, text = anchor[hit], first[hit], n[hit], text[hit]
                if not len(anchor):
                    continue
                # The second base's hashes identify windows; the anchor holds 64 bits of the first base's.
                w = hasher.windows(hashes, window)[1]
                ends = np.cumsum(n)
                take = np.repeat(first - np.concatenate([[0], ends[:-1]]), n) + np.arange(ends[-1])
                w = w[take]
                often = often_at.repeated(anchor) if often_at else np.zeros(len(anchor), bool)
                if often.any():  # runs of one window each, under an anchor of their own
                    alone = np.repeat(often, n)
                    opens = np.ones(len(take), bool)
                    opens[1:] = alone[1:] | (np.repeat(np.arange(len(n)), n)[1:] != np.repeat(np.arange(len(n)), n)[:-1])
                    anchor = np.where(alone, mix(np.repeat(anchor, n) + w), np.repeat(anchor, n))[opens]
                    text, first = np.repeat(text, n)[opens], take[opens]
                    ends = np.append(np.flatnonzero(opens)[1:], len(take))
                    n = np.diff(ends, prepend=0)
                edges = np.concatenate([[0], ends])
                total = np.add.reduceat(w, edges[:-1]) + anchor * U(3)
                known = np.zeros(len(anchor), bool)
                for i, key in enumerate(total.tolist()):
                    times = seen.get(key, 0)
                    if times >= 2:
                        known[i] = True
                    elif times or len(seen) < SEEN:
                        seen[key] = times + 1
                ask, tell = np.flatnonzero(~known), np.flatnonzero(known)
                for rows, keep in ((ask, np.repeat(~known, n)), (tell, None)):
                    if len(rows):
                        key = signed(anchor[rows]) if keep is not None else k1[a:b][text[rows]]
                        body = binaries(w[keep], np.concatenate([[0], np.cumsum(n[rows])])) if keep is not None else pa.array([None] * len(rows), pa.binary())
                        start = (first[rows] - bounds[text[rows]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k1[a:b][text[rows]]), pa.array(k2[a:b][text[rows]]), pa.array(start), pa.array(n[rows].astype(np.int32)), body], names=["anchor", "k1", "k2", "start", "n", "hashes"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def judged(table: pa.RecordBatch) -> pa.RecordBatch:
            anchor, k1, k2, start, n = (table.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            body = table.column(5)
            asked = ~body.is_null().to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(x for x in body.to_pylist() if x is not None), U)
            owner = np.repeat(np.flatnonzero(asked), n[asked])
            order = np.lexsort((flat, anchor[owner]))
            same = (flat[order][1:] == flat[order][:-1]) & (anchor[owner][order][1:] == anchor[owner][order][:-1])
            twice = np.zeros(len(flat), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            # All windows as one line of flags, row after row; each stretch of set flags within a row is a range.
            flag = np.ones(int(n.sum()), bool)
            row = np.repeat(np.arange(len(n)), n)
            flag[asked[row]] = twice
            opens = flag & np.concatenate([[True], ~flag[:-1] | (row[1:] != row[:-1])]) if len(flag) else flag
            closes = flag & np.concatenate([~flag[1:] | (row[1:] != row[:-1]), [True]]) if len(flag) else flag
            offset = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.empty(0, np.int64)
            r = row[opens]
            lo, hi = np.flatnonzero(opens) - offset[r] + start[r], np.flatnonzero(closes) - offset[r] + start[r] + 1
            return pa.RecordBatch.from_arrays([pa.array(k1[r]), pa.array(k2[r]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["k1", "k2", "lo", "hi"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on in the next batch
                if cut:
                    yield judged(table.slice(0, cut).combine_chunks().to_batches()[0])
                held = table.slice(cut).combine_chunks().to_batches()
                rows = 0 if cut else rows - HELD_ROWS  # an anchor with many rows is looked at again only after as many more
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    runs = texts.mapInArrow(candidates, RUNS).repartition("anchor").sortWithinPartitions("anchor")
    ranges = runs.mapInArrow(group, "k1 long, k2 long, lo int, hi int")
    ranges = ranges.groupBy(F.col("k1").alias(own1), F.col("k2").alias(own2)).agg(F.collect_list(F.struct("lo", "hi")).alias(spans))
    joined = keyed.join(ranges, (F.col(key1) == F.col(own1)) & (F.col(key2) == F.col(own2)), "left").drop(key1, key2, own1, own2)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            data, found = as_bytes(batch.column(t_at)), batch.column(batch.num_columns - 1)
            n_words, n_removed, kept = [], [], []
            for raw, own in zip(data, found):
                words = raw.split()
                n_words.append(len(words))
                if own.is_valid and len(own.values):
                    lo, hi = (own.values.field(i).to_numpy() for i in (0, 1))
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi + window - 1, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            out = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], "n_words", "n_removed", "kept_text"])

    t_at = [c.lower() for c in joined.columns].index(text_col.lower())
    return joined.mapInArrow(strip, with_fields(joined.drop(spans), n_words="long", n_removed="long", kept_text="string"))
