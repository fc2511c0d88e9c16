"""Shared pieces: shared-folder tables, byte-level word hashing in numpy, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = b" \t\n\x0b\x0c\r"
U = np.uint64
#: Odd multipliers of the two independent polynomial hashes over bytes and over words (fixed values).
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text that one numpy step takes; a longer single text makes its own step.
STEP_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local session uses one beside its tables; on a cluster it must be set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return path.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def place_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it of a URI or a local path."""
    path = path.replace("s3a://", "s3://", 1)
    return pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), path)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders by the columns named: cuts the lineage and survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomframe-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by))
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        folder, files = _folder(table.sparkSession, table._lf_path)
        files.delete(folder, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """base**i and its inverse modulo 2**64 for i up to STEP_BYTES and a bit more, made once."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        size = max(n, STEP_BYTES + (1 << 16))
        up, down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (self.base, pow(self.base, -1, 1 << 64)))
        if size < 2 * STEP_BYTES:  # those of a longer word are not kept
            self.up, self.down = up, down
        return up[:n], down[:n]


_POWERS: dict[int, Powers] = {}


class Hasher:
    """Words and k-word windows of many texts at once, as 64-bit hashes (one array per base)."""

    def __init__(self, lower: bool = False, bases: int = 1):
        self.bytes_ = [_POWERS.setdefault(b, Powers(b)) for b in BYTE_BASES[:bases]]
        self.words_ = [_POWERS.setdefault(b, Powers(b)) for b in WORD_BASES[:bases]]
        self.is_sep = np.zeros(256, bool)
        self.is_sep[list(SEPARATORS)] = True
        self.map = np.arange(1, 257, dtype=U)
        if lower:
            self.map[65:91] += U(32)

    def words(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Hashes of all words in order, and the index of the first word of each text (one more at the end).

        A word's hash does not depend on its place, so a long text is taken in stretches that end with a separator.
        """
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        found: list[list[np.ndarray]] = [[] for _ in self.bytes_]
        starts: list[np.ndarray] = []
        lo = 0
        while lo < len(buf):
            hi = len(buf)
            if hi - lo > 2 * STEP_BYTES:
                hi = lo + STEP_BYTES
                while not (cut := np.flatnonzero(self.is_sep[buf[hi : hi + STEP_BYTES]])).size:
                    hi += STEP_BYTES
                hi += int(cut[0]) + 1
            at, hashes = self._words(buf[lo:hi])
            starts.append(at + lo)
            for held, h in zip(found, hashes):
                held.append(h)
            lo = hi
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        return [np.concatenate(h) for h in found], np.searchsorted(np.concatenate(starts), first)

    def _words(self, buf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        sep = self.is_sep[buf]
        word = ~sep
        first = word.copy()
        first[1:] &= sep[:-1]
        starts = np.flatnonzero(first)
        last = sep.copy()
        last[1:] &= word[:-1]
        last[0] = False
        ends = np.flatnonzero(last)
        vals = self.map[buf]
        hashes = []
        for powers in self.bytes_:
            up, down = powers.get(len(buf) + 1)
            total = np.zeros(len(buf) + 1, U)
            np.cumsum(vals * up[: len(buf)], out=total[1:])
            hashes.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)))
        return starts, hashes

    def windows(self, hashes: list[np.ndarray], k: int) -> list[np.ndarray]:
        """Hash of the k words from each position on (also across texts; mask those with inside())."""
        out = []
        for all_, powers in zip(hashes, self.words_):
            parts = [np.zeros(0, U)]
            for lo in range(0, max(0, len(all_) - k + 1), STEP_BYTES):
                h = all_[lo : lo + STEP_BYTES + k - 1]
                n = len(h) - k + 1
                up, down = powers.get(len(h) + 1)
                total = np.zeros(len(h) + 1, U)
                np.cumsum(h * up[: len(h)], out=total[1:])
                parts.append(mix((total[k : k + n] - total[:n]) * down[:n]))
            out.append(parts[1] if len(parts) == 2 else np.concatenate(parts))
        return out


def steps(texts: list[bytes | None]):
    """(first, last) index ranges of texts that together hold about STEP_BYTES; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if begin < i and len(t or b"") >= STEP_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t or b"") + 1
        if size >= STEP_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


#: Sizes of the batches that go to Python workers: a few MB instead of 64.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def light(spark: SparkSession) -> SparkSession:
    """The session, with small batches for Python workers where it has no sizes of its own: batches are held in the JVM and in each worker."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def small(batches, rows: int = 512):
    """The batches in slices of few rows, so that little of a batch is held twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose item i is data[bounds[i]:bounds[i+1]]."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def free_of(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (compared as Spark compares names)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_key(*columns: Column) -> list[Column]:
    """Two long columns that stand for a row's identity, nulls included."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with more columns."""
    return StructType([*df.schema.fields, *(StructField(name, _parse_datatype_string(kind)) for name, kind in kinds.items())])


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal first columns of sorted batches, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for i in range(keys):
            col = batch.column(i).to_numpy(zero_copy_only=False)
            same[1:] &= col[1:] == col[:-1]
            same[0] &= last is not None and last[i] == col[0]
        cuts = np.flatnonzero(~same).tolist()
        edges = [0, *[c for c in cuts if c], batch.num_rows]
        for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if held and (n or not same[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(keys)]
    if held:
        yield pa.Table.from_batches(held)


#: An id with more edges than this, and more than one in HUBS of all edges, is joined by broadcast; there are at most 2 * HUBS.
HUB, HUBS = 1_000, 10_000


def with_lowest(edges: DataFrame, low: DataFrame, limit: float, most: int) -> DataFrame:
    """edges (u, v) with the m of their u in low (u, m, n); most is the largest n or above it.

    The edges of a hub, an id whose n is above the limit, stay where they are: the hubs, few by the limit, are
    broadcast. All others meet their m by a shuffle.
    """
    if most <= limit:
        return edges.join(low.select("u", "m"), "u").select("u", "v", "m")
    hubs = F.broadcast(low.filter(F.col("n") > limit).select(F.col("u").alias("h"), F.col("m").alias("hm")))
    marked = edges.join(hubs, F.col("u") == F.col("h"), "left")
    others = marked.filter("h is null").select("u", "v").join(low.filter(F.col("n") <= limit).select("u", "m"), "u")
    return others.select("u", "v", "m").union(marked.filter("h is not null").select("u", "v", F.col("hm").alias("m")))


def shape(edges: DataFrame) -> tuple[int, bool, int]:
    """Number of edges, whether they are more than stars (some id is a leaf and something else too), and the most edges of an id."""
    ends = edges.select(F.col("u").alias("i"), F.lit(1).alias("leaf")).union(edges.select(F.col("v").alias("i"), F.lit(0).alias("leaf")))
    ends = ends.groupBy("i").agg(F.sum("leaf").alias("leaf"), F.count("*").alias("n"))
    found = ends.agg(F.coalesce(F.sum("leaf"), F.lit(0)), F.max((F.col("leaf") > 0) & (F.col("n") > 1)), F.max("n")).first()
    return found[0], bool(found[1]), found[2] or 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable from each id of the edges.

    Alternating large-star and small-star rounds, until only stars are left; each round is written to the shared folder, and the one
    before removed. Both steps are minima by id, summed before the shuffle, joined back to the edges; see with_lowest for
    ids with very many edges.
    """
    lowest = lambda df: df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    n, tangled, most = shape(now)
    while tangled:
        limit = max(HUB, n / HUBS)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"), "n")
        large = with_lowest(both.filter("v > u"), low, limit, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct())
        # An id has as many edges here as it had to smaller ids, at most.
        small = with_lowest(large, lowest(large), limit, most)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        nxt = written(small.filter("u <> v").distinct())
        discard(now, large)
        now = nxt
        n, tangled, most = shape(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
