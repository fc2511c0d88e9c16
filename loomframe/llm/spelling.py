"""Spelling variants: words of a corpus, their near words (one code point inserted, deleted or replaced), and the forms they lead to.

Near words are found by merging light subtrees of the words' trie (an errata trie for one error). The trie's nodes are rows, one for
each prefix with two children or more; its heavy child is the one above most words, and all others are light, so a word takes
at most log2(words) light edges. Where a word leaves a node P by a light edge c, with the rest q, two words that part there
coincide in one of four ways:

    the edge is skipped          P q      is a word, or
    replaced by the heavy one    P h q    is a word, or
    put behind the heavy one     P h c q  is a word, or
    skipped in light siblings    P * q    is shared by words of several light edges.

The end of a word counts as an edge too. Each pair of near words parts at one node, and is found there once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import HUBS, discard, light, small, written
from loomframe.llm.fim import buffers, slices

#: A run whose hash this divides loses a code point; words have so many code points and occurrences at least.
DIVISOR, LENGTH, TIMES = 97, 5, 3
#: Bytes of text that one numpy step takes; runs of more bytes are hashed one by one.
STEP, LONG = 1 << 20, 48
#: Fixed value: the polynomial of crc32.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(POLYNOMIAL), x >> 1)
    return x


class Runs:
    """Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF (in UTF-8, C3 and one byte more), lower-cased within A-Z."""

    def __init__(self):
        b = np.arange(256)
        self.ascii = (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122)
        self.lower = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        self.crc = _crc_table()

    def letters(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        b = data[lo:hi]
        lead = b == 0xC3
        follows = np.zeros(len(b), bool)
        follows[1:] = lead[:-1]
        follows[:1] = lo > 0 and data[lo - 1] == 0xC3
        return self.ascii[b] | lead | follows

    def stretches(self, at: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of the buffer that end where a document does, or between two bytes that are no letters of one run."""
        lo, last = int(at[0]), int(at[-1])
        while lo < last:
            hi = min(lo + STEP, last)
            while hi < last:
                ends = at[slice(*np.searchsorted(at, [lo + 1, hi + 1]))]
                gaps = np.flatnonzero(~self.letters(data, lo, hi))
                found = max([int(x[-1]) for x in (ends, gaps + lo + 1) if len(x)], default=0)
                if found > lo:
                    hi = found
                    break
                hi = min(hi + STEP, last)
            yield lo, hi
            lo = hi

    def words(self, column: pa.Array, ids: list, divisor: int, length: int) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Words of at least length code points and their counts, stretch by stretch; the texts must not be null."""
        at, data, _ = buffers(column)
        seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        for lo, hi in self.stretches(at, data):
            letter = self.letters(data, lo, hi)
            text = self.lower[data[lo:hi]]
            parted = np.zeros(hi - lo + 1, bool)
            parted[at[slice(*np.searchsorted(at, [lo, hi + 1]))] - lo] = True
            inside = np.concatenate([[False], letter, [False]])
            begins = np.flatnonzero(letter & (~inside[:-2] | parted[:-1]))
            ends = np.flatnonzero(letter & (~inside[2:] | parted[1:])) + 1
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80, dtype=np.int64)])
            n = points[ends] - points[begins]
            long = n >= length
            begins, ends, n = begins[long], ends[long], n[long]
            if not len(n):
                continue
            doc = np.searchsorted(at, begins + lo, side="right") - 1
            h = self.hashes(text, begins, ends, seeds[doc])
            hit = h % divisor == 0
            edges = np.stack([begins[~hit], ends[~hit]], 1)
            (found,) = slices(pa.py_buffer(text), edges) if len(edges) else (pa.array([], pa.binary()),)
            shorter = []
            for b, e, size, x in zip(begins[hit].tolist(), ends[hit].tolist(), n[hit].tolist(), h[hit].tolist()):
                if size > length:
                    word = text[b:e].tobytes().decode()
                    shorter.append((word[: x % size] + word[x % size + 1 :]).encode())
            both = pa.chunked_array([found, pa.array(shorter, pa.binary())]).value_counts()
            yield both.field(0).view(pa.string()), both.field(1)

    def hashes(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """crc32 of each run behind what its seed is the crc32 of; byte by byte for all runs at once, longest first."""
        size = ends - begins
        order = np.argsort(-size, kind="stable")
        first, state, size = begins[order], ~seeds[order], size[order]
        many = int(np.searchsorted(-size, -LONG))
        for j in range(int(size[many]) if many < len(size) else 0):
            k = int(np.searchsorted(-size, -j))
            part = state[many:k]
            state[many:k] = self.crc[(part ^ text[first[many:k] + j]) & 0xFF] ^ part >> 8
        out = np.empty(len(order), np.int64)
        out[order] = ~state
        for i in order[:many].tolist():
            out[i] = zlib.crc32(text[begins[i] : ends[i]].tobytes(), int(seeds[i]))
        return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): words of at least length code points that occur at least times times in all texts.

    A word is a maximal run of the letters of Runs; if divisor divides the crc32 of <doc_id>:<run>, it loses the code point at that
    crc32 modulo its length. Null texts have no words, a null id counts as an empty one, rows that repeat are counted as often, and very
    long texts are read in stretches. Words are counted in each stretch and again in each task before the shuffle. An empty table
    gives an empty one; other columns are not read.
    """
    light(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in small(batches):
            for words, n in runs.words(batch.column(1), batch.column(0).to_pylist(), divisor, length):
                yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    found = docs.select(F.col(id_col).cast("string"), F.coalesce(text_col, F.lit(""))).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def edges(words: DataFrame) -> DataFrame:
    """(word, n, node, edge, rest) for each prefix (node) of each word, with the next code point (empty at the end) and what follows it."""
    part = lambda d: F.struct(F.substring("word", F.lit(1), d).alias("node"), F.substring("word", d + 1, F.lit(1)).alias("edge"), F.substring("word", d + 2, F.length("word")).alias("rest"))
    return words.select("word", "n", F.inline(F.transform(F.sequence(F.lit(0), F.length("word")), part)))


def heavy_edges(words: DataFrame) -> DataFrame:
    """(node, heavy, size) of all nodes with two edges or more; ties go to the largest code point, the end of a word to the last."""
    by_edge = edges(words).groupBy("node", "edge").agg(F.count("*").alias("c"))
    return by_edge.groupBy("node").agg(F.max_by("edge", F.struct("c", "edge")).alias("heavy"), F.sum("c").alias("size"), F.count("*").alias("k")).filter("k > 1").drop("k")


def light_edges(words: DataFrame, heavy: DataFrame) -> DataFrame:
    """edges() of words that are light, with the heavy edge of their node.

    Nodes near the root have many words below them. Those with more than one in HUBS of all edges, so fewer than HUBS, are broadcast;
    their edges stay where they are. All others meet their node by a shuffle.
    """
    limit = (words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) / HUBS
    hubs = F.broadcast(heavy.filter(F.col("size") > limit).select(F.col("node").alias("hub"), F.col("heavy").alias("own")))
    marked = edges(words).join(hubs, F.col("node") == F.col("hub"), "left")
    near = marked.filter("hub is not null").select("word", "n", "node", "edge", "rest", F.col("own").alias("heavy"))
    far = marked.filter("hub is null").select("word", "n", "node", "edge", "rest").join(heavy.filter(F.col("size") <= limit).select("node", "heavy"), "node")
    return near.unionByName(far).filter("edge <> heavy")


def links(words: DataFrame, parted: DataFrame) -> DataFrame:
    """(word, k, best): k near words of a word, the best of which is a struct of its count, negated, and itself. A word may have several rows."""
    skipped = F.when((F.col("edge") != "") & (F.substring("rest", 1, 1) != F.col("edge")), F.concat("node", "rest"))
    replaced = F.when(F.col("edge") != "", F.concat("node", "heavy", "rest"))
    behind = F.concat("node", "heavy", "edge", "rest")
    tried = parted.select("word", "n", F.explode(F.array(skipped, replaced, behind)).alias("other")).filter("other is not null")
    met = tried.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = lambda n, w: F.struct((-F.col(n)).alias("n"), F.col(w).alias("w")).alias("best")
    one = F.lit(1).cast("long").alias("k")
    pairs = met.select("word", one, best("other_n", "other")).union(met.select("other", one, best("n", "word")))
    # Siblings: at most one word for each letter of the alphabet, so a group is small; it gives a row a word, not pairs.
    groups = parted.filter("edge <> ''").groupBy("node", "rest").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")))).alias("g")).filter(F.size("g") > 1)
    each = groups.select("g", F.posexplode("g").alias("i", "x"))
    siblings = each.select(F.col("x.w").alias("word"), (F.size("g") - 1).cast("long").alias("k"), F.when(F.col("i") == 0, F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))
    return pairs.union(siblings)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of each word's forms, by doubling how far a word sees. A form occurs twice as often as its word, so a
    chain is short (log2 of the largest count) and the rounds are fewer still."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.filter("moved").limit(1).count():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(now.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(now)
        now = nxt
    return now.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of different words and their counts (word, n).

    Near words differ by one code point inserted, deleted or replaced. A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that occurs at least twice as often; its root is the last of the forms that follow from it, or the word
    itself. Words without near words have n_near 0 and no form. An empty table gives an empty one; null words are left out.
    """
    words = written(words.filter("word is not null").select("word", "n"))
    heavy = written(heavy_edges(words))
    parted = written(light_edges(words, heavy))
    near = links(words, parted).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    is_form: Column = -F.col("best.n") >= 2 * F.col("n")
    form = lambda c: F.when(is_form, c)
    out = written(words.join(near, "word", "left").select("word", form(F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(-F.col("best.n")).alias("form_n")))
    discard(words, heavy, parted)
    return out.join(roots(out.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
