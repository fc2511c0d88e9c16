"""Exact Jaccard self-join of shingle sets by signature trees, and its connected components.

Documents with equal sets form a class, and classes are what is joined. A set shares three quarters of its tokens with any that it
links to, so a count-min sketch of all sets drops documents with fewer repeated tokens. Linked sets share one of their
first tokens (in an order that puts common tokens last); classes that share one form a group. Each group is a signature tree whose nodes hold
OR-combined token bitmaps and size ranges: a dual traversal prunes node pairs by their maximum possible overlap, and what remains
of the group's pairs is emitted as a spanning forest. Its components over all groups are families, outside of
which nothing can link. Each family, or each pair of blocks of a large one, is traversed in the same way with the whole sets at
hand, and only links that join what was apart are emitted: they span the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import sketch
from loomframe.llm.common import U, as_bytes, components, discard, free_of, fresh, grouped, light, small, with_fields, written
from loomframe.llm.shingles import sets_of, signature

#: Links need 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Documents whose shingles are counted to find common tokens (a share of all beyond SAMPLE_SHARE of the rows), and
#: how many of these tokens are kept. They only set the order of tokens: no link depends on them.
SAMPLE_DOCS, SAMPLE_SHARE, COMMON = 4_000, 0.001, 1_000_000
#: Bytes of sets in a block; a family above it is compared block by block.
BLOCK_BYTES = 4 << 20
#: Classes in a block of a group.
BLOCK = 4096
LEAF = 16
#: Classes that a task remembers, to write the set of each only once (a later copy would change nothing).
SEEN = 200_000


def needed(a, b):
    """Smallest intersection of sets of a and b members that makes a link."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Tokens with the common ones last, each part by hash."""
    if not len(common):
        return tokens
    at = np.searchsorted(common, tokens)
    hot = common[np.minimum(at, len(common) - 1)] == tokens
    return np.concatenate([tokens[~hot], tokens[hot]])


def bitmap(tokens: np.ndarray) -> bytes:
    """Token bitmap of a width that fits the set: a power of two, twice the members at least."""
    width = 1 << max(8, int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(tokens & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def stacked(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the narrowest (folding keeps every bound valid)."""
    width = min(map(len, maps)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), 0) for m in maps])


def bound(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Largest possible intersection of sets with bitmaps a and b: members whose bit the other lacks are not shared."""
    lost_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    lost_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(na - lost_a, nb - lost_b)


class Tree:
    """Signature tree over rows sorted by size: node k of a level covers LEAF * 2**level rows."""

    def __init__(self, rows: np.ndarray, bits: np.ndarray, size: np.ndarray):
        self.rows, self.bits, self.size = rows, bits, size
        extra = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        at = np.arange(0, len(size), LEAF)
        level = (np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(extra, at))
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), 2)
            level = tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level))
            self.levels.append(level)


def survives(p: tuple, q: tuple) -> bool:
    """Whether two nodes (bitmap, smallest and largest size, most members beyond bits) may hold a linked pair."""
    if DEN * min(p[2], q[2]) < NUM * max(p[1], q[1]):
        return False
    shared = int(np.bitwise_count(p[0] & q[0]).sum()) + min(p[3], q[3])
    return shared >= needed(int(p[1]), int(q[1]))


def dual(s: Tree, t: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (one row of each tree; each pair once if s is t) that the bounds leave, by node pairs from the roots on."""
    stack = [(len(s.levels) - 1, 0, len(t.levels) - 1, 0)]
    while stack:
        a, i, b, j = stack.pop()
        if (s is t and a == b and j < i) or not survives(tuple(x[i] for x in s.levels[a]), tuple(x[j] for x in t.levels[b])):
            continue
        if a or b:
            kids_a = [(a - 1, k) for k in (2 * i, 2 * i + 1) if k < len(s.levels[a - 1][0])] if a and a >= b else [(a, i)]
            kids_b = [(b - 1, k) for k in (2 * j, 2 * j + 1) if k < len(t.levels[b - 1][0])] if b and b >= a else [(b, j)]
            stack += [(*x, *y) for x in kids_a for y in kids_b]
            continue
        x, y = np.arange(i * LEAF, min((i + 1) * LEAF, len(s.size))), np.arange(j * LEAF, min((j + 1) * LEAF, len(t.size)))
        x, y = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
        if s is t:
            x, y = x[x < y], y[x < y]
        if len(x):
            keep = bound(s.bits[x], s.size[x], t.bits[y], t.size[y]) >= needed(s.size[x], t.size[y])
            yield s.rows[x[keep]], t.rows[y[keep]]


def forest(size: np.ndarray, bits: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], exact=None) -> list[tuple[int, int]]:
    """Row pairs that join what was apart: of those that the bounds (and exact, if given) allow, within or between lists of rows."""
    root, out, trees = np.arange(len(size)), [], {}
    for left, right in pairs:
        for rows in (left, right):
            if id(rows) not in trees:
                order = rows[np.argsort(size[rows], kind="stable")]
                trees[id(rows)] = Tree(order, bits[order], size[order])
        for x, y in dual(trees[id(left)], trees[id(right)]):
            apart = root[x] != root[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist()):
                if root[i] != root[j] and (exact is None or exact(i, j)):
                    root[root == root[j]] = root[i]
                    out.append((i, j))
    return out


def _sides(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a block meet: home rows (part 0) each other unless the block is a pair, and those of part 1."""
    part = table.column("part").to_numpy()
    own, other = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    pairs = [(own, own)] if len(own) > 1 and table.column("pair")[0].as_py() in ("all", "self") else []
    return pairs + ([(own, other)] if len(own) and len(other) else [])


def _edges(table: pa.Table, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        c = table.column("c").to_numpy()
        x, y = np.array(found).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[x], c[y])), pa.array(np.maximum(c[x], c[y]))], names=["a", "b"])


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs that bitmaps allow, for each block of (token, scale, at, pair)."""
    for table in grouped(batches, 4):
        pairs = _sides(table)
        if pairs:
            yield from _edges(table, forest(table.column("n").to_numpy(), stacked(table.column("bits").to_pylist()), pairs))


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links, for each block of (family, scale, at, pair)."""
    for table in grouped(batches, 4):
        pairs = _sides(table)
        if pairs:
            sets = [np.frombuffer(b, U) for b in table.column("tokens").to_pylist()]

            def link(i: int, j: int, sets: list[np.ndarray] = sets) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return DEN * both >= NUM * (len(sets[i]) + len(sets[j]) - both)

            yield from _edges(table, forest(np.array([len(x) for x in sets]), stacked([bitmap(x) for x in sets]), pairs, link))


def places(n: Column, parts: Column, by_scale: Column) -> Column:
    """Blocks of a row as structs (scale, at, pair, part).

    Linked sets differ in size by a third at most: with by_scale they meet in the block of the smaller one's size class, as
    home rows both, or as a home row and a visitor from the next class. A group of several parts is compared part by part.
    """
    scale, salt = F.floor(F.log2(n)).cast("int") + 1, F.pmod(F.xxhash64(F.lit(23), "c"), parts).cast("int")
    row = lambda scale, at, pair, part: F.struct(scale.cast("int").alias("scale"), at.cast("long").alias("at"), F.lit(pair).alias("pair"), part.cast("int").alias("part"))
    of = lambda i, j: i.cast("long") * 1_000_000 + j
    others = F.sequence(F.lit(0), parts - 1)
    one = F.when(by_scale, F.array(row(scale, F.lit(0), "all", F.lit(0)), row(scale - 1, F.lit(0), "all", F.lit(1)))).otherwise(F.array(row(F.lit(0), F.lit(0), "all", F.lit(0))))
    home = F.transform(others, lambda o: F.when(salt == o, row(scale, of(o, o), "self", F.lit(0))).otherwise(row(scale, of(F.least(salt, o), F.greatest(salt, o)), "home", (salt > o))))
    host = F.transform(others, lambda o: row(scale, of(salt, o), "visit", F.lit(0)))
    visit = F.transform(others, lambda o: row(scale - 1, of(o, salt), "visit", F.lit(1)))
    return F.when(parts == 1, one).otherwise(F.concat(home, host, visit))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles and component_id, the smallest id reachable over links of at least 0.75.

    Null, empty and blank texts have no shingles and stay alone. A row with a null id gets its n_shingles and a null
    component_id, and links nothing. Rows that repeat an id count as one document: what one of them links, all do. An empty
    table gives an empty one. A very long text is hashed in stretches, and its set is one row.
    Columns of docs with the names of the added ones are replaced. Shingles are
    compared as 64-bit hashes, and equal sets are told by another.
    """
    sc = light(docs.sparkSession).sparkContext
    docs = free_of(docs, "n_shingles", "component_id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("id is not null")

    n_texts, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    share = min(1.0, max(SAMPLE_DOCS / max(1, n_texts), SAMPLE_SHARE))
    some = texts.filter(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1_000_000)) < share * 1_000_000).select("t")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens in sets_of(as_bytes(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    counts = written(some.mapInArrow(tokens_of, "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3"))
    # The count from which at most COMMON tokens are left, by the few different counts: no sort of tokens.
    least, held = 1 << 62, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).toLocalIterator():
        held += row["tokens"]
        if held > COMMON:
            break
        least = row["n"]
    top = counts.filter(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(np.int64)
    discard(counts)
    common = sc.broadcast(np.sort(top.view(U)))

    def sketch_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held = []
        for tokens in sets_of(as_bytes(batch.column(0))):
            held.append(tokens)
            if len(held) == 200:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    # About 6 bytes a word; two cells for each.
    bits = sc.broadcast(sketch.build(texts.select("t"), sketch_keys, size / 6, 2))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that may have a partner: their class and, for the first of a class in a task, its set."""
        seen, sk = set(), sketch.Sketch(*bits.value)
        for batch in small(batches):
            rows, c, body, size = [], [], [], 0
            for i, tokens in enumerate(sets_of(as_bytes(batch.column(1)))):
                if len(tokens) and DEN * int(sk.repeated(tokens).sum()) >= NUM * len(tokens):
                    rows.append(i)
                    c.append(signature(tokens))
                    body.append(None if c[-1] in seen else tokens.tobytes())
                    size += len(body[-1] or b"")
                    if len(seen) < SEEN:
                        seen.add(c[-1])
                if rows and (size > 4 << 20 or i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(c, pa.int64()), pa.array(body, pa.binary())], names=["id", "c", "tokens"])
                    rows, c, body, size = [], [], [], 0

    found = written(texts.mapInArrow(sets, "id long, c long, tokens binary"))
    with_set = found.filter("tokens is not null").select("c", "tokens")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = sketch.Sketch(*bits.value)
        for batch in small(batches):
            for c, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(body, U)
                head = ordered(tokens, common.value)[: len(tokens) - -(-NUM * len(tokens) // DEN) + 1]
                head = head[sk.repeated(head)]
                yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(np.full(len(head), c))], names=["token", "c"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [np.frombuffer(b, U) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets_], pa.int64()), pa.array([bitmap(x) for x in sets_], pa.binary())], names=["c", "n", "bits"])

    postings = with_set.mapInArrow(heads, "token long, c long")
    who = F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("who")
    groups = postings.groupBy("token").agg(F.count("*").alias("size"), F.min("c").alias("first"), F.max("c").alias("last"), who).filter("first <> last")
    # Tokens with the same members make the same pairs: one of them is enough.
    groups = groups.groupBy("size", "first", "last", "who").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    members = postings.join(groups, "token").groupBy("token", "c").agg(F.first("parts").alias("parts"))
    shapes = with_set.mapInArrow(maps, "c long, n long, bits binary").groupBy("c").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    placed = members.join(shapes, "c").withColumn("b", F.explode(places(F.col("n"), F.col("parts"), F.lit(True))))
    placed = placed.select("token", "b.scale", "b.at", "b.pair", "b.part", "c", "n", "bits").repartition("token", "scale", "at").sortWithinPartitions("token", "scale", "at", "pair")
    pairs = written(placed.mapInArrow(possible, "a long, b long"))
    family = components(pairs, "a", "b").select(F.col("id").alias("c"), F.col("component").alias("family"))
    discard(pairs)

    sizes = with_set.select("c", F.length("tokens").alias("bytes")).groupBy("c").agg(F.max("bytes").alias("bytes"))
    family = written(family.join(sizes, "c"))
    family = family.join(family.groupBy("family").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("parts")), "family")
    tokens = with_set.groupBy("c").agg(F.first("tokens").alias("tokens"))
    placed = tokens.join(family.select("c", "family", places(F.col("bytes") / 8, F.col("parts"), F.lit(False)).alias("b")), "c").withColumn("b", F.explode("b"))
    placed = placed.select("family", "b.scale", "b.at", "b.pair", "b.part", "c", "tokens").repartition("family", "scale", "at").sortWithinPartitions("family", "scale", "at", "pair")
    pairs = written(placed.mapInArrow(linked, "a long, b long"))
    comp = components(pairs, "a", "b")
    discard(pairs)

    # The lists of the sets are of no use from here on: one small row for each class is.
    mark, own, root = fresh(docs, "_lf_s1", "_lf_r1", "_lf_root")
    ids = found.groupBy("c").agg(F.min("id").alias("low")).join(comp.withColumnRenamed("id", "c"), "c", "left").select("c", "low", F.coalesce("component", "c").alias("component"))
    roots = ids.join(ids.groupBy("component").agg(F.min("low").alias("root")), "component").select(F.col("c").alias(own), F.col("root").alias(root))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets_ = list(sets_of(as_bytes(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in sets_], pa.int64()), pa.array([signature(x) for x in sets_], pa.int64())], names=[*batch.schema.names, "n_shingles", mark])

    out = docs.mapInArrow(measured, with_fields(docs, n_shingles="long", **{mark: "long"}))
    out = out.join(roots, F.col(mark) == F.col(own), "left")
    alone = F.col(id_col).cast("long")
    component = F.when(alone.isNotNull() & (F.col("n_shingles") > 0), F.coalesce(root, alone)).otherwise(alone)
    return out.select(*docs.columns, "n_shingles", component.alias("component_id"))
