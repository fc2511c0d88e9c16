"""Near-duplicate vectors: spherical k-means cells on stored shelves, exact cosines of the vectors that cells leave in reach, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomframe.llm.common import binaries, components, discard, free_of, fresh, light, place_of, row_key, written

THRESHOLD = 0.93
#: Rows that cells and shelves are planned by, in all, by a hash of the vector; every vector is then assigned.
FIT_VECTORS = 20_000
ROUNDS = 8
#: Different vectors aimed at in a cell, and most cells of a label.
CELL, MAX_CELLS = 2_000, 1_024
#: Different vectors aimed at on a shelf: one in SHELVES of all, but BLOCK at least, and SHELF_BYTES of them at most.
BLOCK, SHELVES, SHELF_BYTES = 2_048, 64, 8 << 20
#: Vectors by vectors of one product, pairs that wait to be joined, and most tasks that compare shelves.
ROWS, COLUMNS, WAITING, TASKS = 128, 2_048, 1 << 17, 2_000
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Unit vectors as doubles; no square of a component overflows."""
    raw = raw.astype(np.float64)
    return unit(raw / np.abs(raw).max(1, keepdims=True))


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced starting rows; a cell that empties keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        cell = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        size = np.sqrt((sums * sums).sum(1))
        c = np.where((size > 1e-12)[:, None], sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def shelved(sizes: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray, int]:
    """First shelf and number of shelves of each cell, and shelves in all: cells share a shelf as far as there is room, larger ones are dealt over several."""
    parts = np.maximum(1, np.ceil(sizes / room)).astype(np.int64)
    first, at, held = np.zeros(len(sizes), np.int64), 0, 0.0
    for i, (size, n) in enumerate(zip(sizes.tolist(), parts.tolist())):
        if held and held + size > room:
            at, held = at + 1, 0.0
        first[i] = at
        at, held = (at + n, 0.0) if n > 1 else (at, held + size)
    return first, parts, at + (held > 0)


class Shelf:
    """The vectors of a shelf, in order of label and cell; span has the rows of each label."""

    def __init__(self, files: pa.fs.FileSystem, folder: str):
        found = files.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
        tables = []
        for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
            with files.open_input_file(path) as file:
                tables.append(pq.ParquetFile(file).read())
        self.span: dict[int, tuple[int, int]] = {}
        self.n = sum(t.num_rows for t in tables)
        if self.n:
            table = pa.concat_tables(tables)
            order = np.lexsort((table["h"], table["cell"], table["g"]))
            table = table.take(pa.array(order)).combine_chunks()
            g, self.cell, self.h, self.h2, self.copies, self.rep = (table[c].to_numpy() for c in ("g", "cell", "h", "h2", "copies", "rep"))
            cuts = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist(), self.n]
            self.span = {int(g[lo]): (lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])}
            self.v = table["v"].combine_chunks()

    def raw(self, g: int, kind: str) -> np.ndarray:
        lo, hi = self.span[g]
        offsets = np.frombuffer(self.v.buffers()[1], np.int32)[self.v.offset + lo : self.v.offset + hi + 1]
        return np.frombuffer(self.v.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(hi - lo, -1)


class Met:
    """Links and components of vectors that meet; copies are counted as often as they occur."""

    def __init__(self, copies: np.ndarray, rep: np.ndarray):
        self.copies, self.rep, self.order = copies.astype(np.float64), rep, np.argsort(rep, kind="stable")
        self.links = np.zeros(len(rep), np.int64)
        self.rank = np.empty(len(rep), np.int64)
        self.rank[self.order] = np.arange(len(rep))
        #: By rank, a smaller rank of the same component, or itself.
        self.up = np.arange(len(rep))
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        """i[p[k]] and j[q[k]] are linked, for each k."""
        self.links[i] += np.bincount(p, self.copies[j][q], len(i)).astype(np.int64)
        self.links[j] += np.bincount(q, self.copies[i][p], len(j)).astype(np.int64)
        a, b = self.up[self.rank[i]][p], self.up[self.rank[j]][q]
        if (apart := a != b).any():
            self.pairs.append((a[apart], b[apart]))
            self.waiting += len(self.pairs[-1][0])
        if self.waiting > WAITING:
            self.join()

    def join(self) -> None:
        """Joins the components of the waiting pairs."""
        if self.waiting:
            p, q = (np.concatenate(x) for x in zip(*self.pairs))
            while len(p):
                a, b = self.up[p], self.up[q]
                p, q, a, b = (x[a != b] for x in (p, q, a, b))
                np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
                while ((higher := self.up[self.up]) != self.up).any():
                    self.up = higher
        self.pairs, self.waiting = [], 0

    def roots(self) -> np.ndarray:
        """The smallest representative of each vector's component."""
        self.join()
        return self.rep[self.order[self.up[self.rank]]]


class Side:
    """The vectors of one label on a shelf: place among all that meet, raw and unit rows, cells."""

    def __init__(self, at: int, raw: np.ndarray, cell: np.ndarray):
        self.at, self.raw = at, raw
        self.x = scaled(raw).astype(np.float32)
        self.starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.ends = np.r_[self.starts[1:], len(cell)]
        self.cells, self.cell = cell[self.starts], cell

    def gaps(self, c: np.ndarray, others: np.ndarray) -> np.ndarray:
        """By cell of others and row: how much nearer the row is to its own centroid, as a difference of products."""
        return (self.x * c[self.cell]).sum(1) - c[others] @ self.x.T


def reach(raw: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosines of rows reach the threshold, by doubles."""
    dots = (scaled(raw) * scaled(other)).sum(1)
    ok = dots >= threshold - SLACK
    for k in np.flatnonzero(np.abs(dots - threshold) <= SLACK).tolist():  # as plain sums of the raw components say
        s, t = raw[k].tolist(), other[k].tolist()
        ok[k] = sum(u * v for u, v in zip(s, t)) / (sum(u * u for u in s) ** 0.5 * sum(v * v for v in t) ** 0.5) >= threshold
    return ok


def meet(met: Met, left: Side, right: Side, c: np.ndarray | None, threshold: float) -> None:
    """Adds all links between left and right, or within left if that is right too.

    Where x is at home in cell a and y in cell b, (x - y) . (a - b) is x's gap to b and y's gap to a together, and
    at most |x - y| * |a - b|. So only vectors whose gaps sum to d * |a - b| or less can be neighbours, d = sqrt(2 - 2 * threshold).
    Products are of floats; what is within twice their error of the threshold is decided by doubles.
    """
    width = left.x.shape[1]
    error = (width + 8) * 2.0**-23
    step = max(1, (1 << 20) // width)

    def product(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, once: bool) -> None:
        s = x @ y.T
        if s.max() < threshold - error:
            return
        near = s >= threshold - error
        if once:
            near &= i[:, None] < j[None, :]
        p, q = np.nonzero(near)
        sure = s[p, q] >= threshold + error
        unsure = np.flatnonzero(~sure)
        for k in range(0, len(unsure), step):
            some = unsure[k : k + step]
            sure[some] = reach(left.raw[i[p[some]]], right.raw[j[q[some]]], threshold)
        p, q = p[sure], q[sure]
        if len(p):
            met.add(i + left.at, j + right.at, p, q)

    def rows(i: np.ndarray, j: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, once: bool = False) -> None:
        x, y = left.x[i], right.x[j]
        for a in range(0, len(i), ROWS):
            # Gaps ascend: no row from here on can have more neighbours than the first.
            last = len(j) if low is None else int(np.searchsorted(high, -low[a], side="right"))
            for b in range(a // COLUMNS * COLUMNS if once else 0, last, COLUMNS):
                to = min(b + COLUMNS, last)
                product(i[a : a + ROWS], x[a : a + ROWS], j[b:to], y[b:to], once)

    if c is None:
        rows(np.arange(len(left.x)), np.arange(len(right.x)), once=left is right)
        return
    d = np.sqrt(max(0.0, 2 - 2 * threshold + 4 * SLACK))
    limit = d * np.sqrt(np.maximum(0, 2 - 2 * (c[left.cells] @ c[right.cells].T))) + 8 * error
    single = c.astype(np.float32)
    to_right, to_left = left.gaps(single, right.cells), right.gaps(single, left.cells)
    least_left, least_right = np.minimum.reduceat(to_right, left.starts, axis=1).T, np.minimum.reduceat(to_left, right.starts, axis=1)
    touching = least_left + least_right <= limit
    if left is right:
        touching = np.triu(touching)
    for u, w in np.argwhere(touching | (left.cells[:, None] == right.cells[None, :])).tolist():
        i, j = np.arange(left.starts[u], left.ends[u]), np.arange(right.starts[w], right.ends[w])
        if left.cells[u] == right.cells[w]:
            rows(i, j, once=left is right)
            continue
        low, high = to_right[w, i] - limit[u, w], to_left[u, j]
        i, low = i[keep := low <= -least_right[u, w]], low[keep]
        j, high = j[keep := high <= limit[u, w] - least_left[u, w]], high[keep]
        by, to = np.argsort(low), np.argsort(high)
        rows(i[by], j[to], low[by], high[to])


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vectors with n_links, component_id and kept: links join equal labels at a cosine of at least threshold.

    Different vectors are stored once, on shelves in the shared folder (a scheme that Arrow can read, as in op13): small labels
    share shelves, a large one has its own, by cells. Each two shelves of a label are read and compared by one task, cell by cell, so a pair meets in
    exactly one place, and no vector is shipped or stored again for a cell that it may have neighbours in; see meet for what cells leave out.
    Equal vectors of a label (by 128 bits of hashes where rows get their results) are compared once and counted as often as they occur.
    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing, nor do
    vectors of different lengths. Rows with a null id link with nothing and have a null component. Rows that repeat an id and
    a vector are separate vectors. An empty table gives an empty one. Columns of vectors with the names of the added ones are
    replaced. Cosines are compared as doubles; equal ones are alike, and a vector that is as near to two centroids is at home with the first.
    """
    spark = light(vectors.sparkSession)
    vectors = free_of(vectors, "n_links", "component_id", "kept")
    key, key2, of_key, of_key2, links, group = fresh(vectors, "_lf_h", "_lf_h2", "_lf_g", "_lf_g2", "_lf_n", "_lf_c")
    e = F.col(vector_col)
    finite = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(e, lambda v: v != 0), F.lit(False))
    kind, item = ("float", "<f4") if isinstance(vectors.select(e).schema[0].dataType.elementType, FloatType) else ("double", "<f8")
    # -0.0 and 0.0 are one value.
    exact = F.transform(e, lambda v: v.cast(kind) + F.lit(0.0).cast(kind))
    h, h2 = row_key(exact, F.col(label_col))
    good = vectors.filter(usable).select(F.xxhash64(label_col, F.size(e)).alias("g"), h.alias("h"), h2.alias("h2"), F.col(id_col).cast("long").alias("id"), exact.alias("v"))

    # Cells and shelves are planned by a sample of bounded size; labels that it does not show are small.
    share = min(1.0, FIT_VECTORS / max(1, vectors.count()))
    sample = good.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("g", "h", "v").distinct().toArrow().combine_chunks()
    sample = sample.take(np.lexsort((sample["h"], sample["g"])))
    g, v = sample["g"].to_numpy(), sample["v"].combine_chunks() if len(sample) else None
    room = max(BLOCK, len(g) / share / SHELVES)
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.zeros(1, np.int64)
    plan, places, others = {}, 0, 0.0
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n, x = (hi - lo) / share, v[lo:hi].flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
        fits = min(room, max(1, SHELF_BYTES // (x.shape[1] * x.itemsize)))
        k = max(1, min(MAX_CELLS, hi - lo, round(n / CELL)))
        if n <= fits:
            others += n / fits
        if k > 1 or n > fits:
            c = centroids(scaled(x), k)
            plan[int(g[lo])] = (c, None, None)
            if n > fits:
                first, parts, count = shelved(np.bincount((scaled(x) @ c.T).argmax(1), minlength=k) / share, fits)
                plan[int(g[lo])] = (c, first + places, parts)
                places += count
    shared = spark.sparkContext.broadcast(plan)
    common = max(1, int(np.ceil(others)))  # shelves of the labels without their own, behind the others

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Equal vectors of a batch go on as one, so that few rows of a very common one are shuffled.
            _, at, which = np.unique(np.stack([batch.column(i).to_numpy() for i in (1, 2)], 1), axis=0, return_index=True, return_inverse=True)
            rep = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(rep, which, batch.column(3).to_numpy())
            batch = batch.take(pa.array(at))
            g, h2 = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy(zero_copy_only=False)
            cell, shelf = np.zeros(len(g), np.int32), (places + g % common).astype(np.int32)
            for one in np.unique(g).tolist():
                if one in shared.value:
                    c, first, parts = shared.value[one]
                    own = np.flatnonzero(g == one)
                    cell[own] = (scaled(values[offsets[own][:, None] + np.arange(c.shape[1])]) @ c.T).argmax(1)
                    if first is not None:
                        shelf[own] = first[cell[own]] + h2[own] % parts[cell[own]]
            columns = [pa.array(shelf), batch.column(0), pa.array(cell), batch.column(1), batch.column(2), pa.array(np.bincount(which)), pa.array(rep), binaries(values, offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=["shelf", "g", "cell", "h", "h2", "copies", "rep", "v"])

    placed = good.mapInArrow(assign, "shelf int, g long, cell int, h long, h2 long, copies long, rep long, v binary").repartition("shelf")
    distinct = placed.groupBy("shelf", "g", "cell", "h", "h2", "v").agg(F.sum("copies").alias("copies"), F.min("rep").alias("rep"))
    shelves = written(distinct, "shelf")
    path = shelves._lf_path
    last = np.arange(places + common)
    for _, first, parts in plan.values():
        if first is not None:
            last[first[0] : (first + parts).max()] = (first + parts).max() - 1
    todo = spark.createDataFrame(list(enumerate(last.tolist())), "a int, last int").select("a", F.explode(F.sequence("a", "last")).alias("b"))
    todo = todo.repartition(min(TASKS, int((last - np.arange(len(last)) + 1).sum())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = place_of(path)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = Shelf(files, f"{folder}/shelf={a}")
                right = left if a == b else Shelf(files, f"{folder}/shelf={b}")
                if not left.n or not right.n:
                    continue
                both = [left] if a == b else [left, right]
                h, h2, copies, rep = (np.concatenate([getattr(s, name) for s in both]) for name in ("h", "h2", "copies", "rep"))
                met = Met(copies, rep)
                for g in left.span.keys() & right.span.keys():
                    one, two = left.span[g], right.span[g]
                    x = Side(one[0], left.raw(g, item), left.cell[slice(*one)])
                    y = x if a == b else Side(two[0] + left.n, right.raw(g, item), right.cell[slice(*two)])
                    meet(met, x, y, shared.value[g][0] if g in shared.value else None, threshold)
                root = met.roots()
                links = met.links + (copies - 1 if a == b else 0)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(col[some]) for col in (h, h2, links, rep, root)], names=["h", "h2", "links", "rep", "root"])

    # One edge for each vector with links and pair of shelves, to the first of its component there.
    found = written(todo.mapInArrow(compare, "h long, h2 long, links long, rep long, root long"))
    discard(shelves)
    comp = components(found.select("rep", "root"), "rep", "root")
    per = found.groupBy("h", "h2").agg(F.sum("links").alias("links"), F.min("rep").alias("rep")).join(comp, F.col("rep") == F.col("id"), "left")
    per = per.select(F.col("h").alias(of_key), F.col("h2").alias(of_key2), F.col("links").alias(links), F.coalesce("component", "rep").alias(group))
    rows = vectors.select("*", F.when(usable, h).alias(key), F.when(usable, h2).alias(key2))
    out = rows.join(per, (F.col(key) == F.col(of_key)) & (F.col(key2) == F.col(of_key2)), "left")
    own = F.col(id_col).cast("long")
    out = out.withColumns({"n_links": F.coalesce(links, F.lit(0).cast("long")), "component_id": F.when(own.isNotNull(), F.coalesce(group, own))})
    return out.withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(True))).select(*vectors.columns, "n_links", "component_id", "kept")
