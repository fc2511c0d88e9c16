"""Token ids of documents in binary files: a Spark data source ("rans_tokens"), and jobs that fill and read it.

A folder holds `_table` (the shared frequencies), one file of blocks for each stretch of documents that a task wrote, and `_manifest`
(written last: what it does not name does not count). A file's blocks are cut into sections; each has the documents that overlap it, the
lanes' states before it (a checkpoint), its words and checksums, so tasks decode any run of sections alone. All numbers are little-endian.

    file     = MAGIC, table crc (u32), lanes (u32), sections, index, offset of the index (u64), sections (u32), MAGIC
    section  = crc of the rest (u32), ids (u32), documents (u32), states (u32), words (u32), crc of the ids (u32),
               document ids (i64 each), whether they are null (u8 each), starts (i64 each), sizes (i64 each), states (u64 each), words (u32 each)
    index    = for each section, its offset and the place of its first id (i64 each)
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomframe.llm import rans
from loomframe.llm.common import binaries, discard, light, place_of, shared_dir, small, written
from loomframe.llm.fim import buffers

MAGIC = b"LFRANS01"
HEAD, SECTION_HEAD, TAIL = "<8sII", "<IIIIII", "<QI8s"
END_ID = 2
#: Bytes of text that one step of tokenizing takes, different pieces that a task remembers, ids of a file (it ends with a document) and of a reading task.
STEP, REMEMBERED, FILE_IDS, TASK_IDS = 1 << 23, 1_000_000, 1 << 26, 1 << 23
#: Kinds of ASCII characters; others are 0.
SPACE, LINE_END, PUNCTUATION, LETTER, DIGIT = 1, 2, 3, 4, 5
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class Pieces:
    """Ids of texts by the tokenizer. Texts are cut where the tokenizer's own pattern cuts whatever stands around: before a space or line end that follows
    a character which is certainly none, between a letter and punctuation, and behind a single line end. So equal pieces have equal ids, and each
    is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        settings = json.loads(self.model.to_str())
        kind = settings["pre_tokenizer"] or {}
        if settings["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            raise ValueError("the tokenizer must be byte-level, without a normalizer or a space put first")
        self.size = self.model.get_vocab_size()
        # A byte-level piece has a character for each byte.
        self.bytes_of = np.array([len(self.model.id_to_token(i) or "") for i in range(self.size)])
        b = np.arange(256)
        self.inner, self.latin = (b >= 0x80) & (b < 0xC0), (b >= 0xC3) & (b < 0xE0)  # C3 to DF begin characters of two bytes, none of them white space
        letter = (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122)
        self.kind = np.zeros(256, np.uint8)
        self.kind[(b > 32) & (b < 127)] = PUNCTUATION
        self.kind[letter], self.kind[(b >= 48) & (b <= 57)] = LETTER, DIGIT
        self.kind[32], self.kind[10] = SPACE, LINE_END
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.upto = np.zeros(1 << 14, np.int64)

    def cuts(self, data: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Places in [lo, hi) before which a piece ends, by the bytes around them."""
        begin = max(lo - 3, 0)
        b = np.concatenate([np.zeros(3 - (lo - begin), np.uint8), data[begin:hi]])
        kind = self.kind[b]
        two = np.zeros(len(b), bool)  # last bytes of characters C3 80 to DF BF
        two[1:] = self.inner[b[1:]] & self.latin[b[:-1]]
        accented = two.copy()  # last bytes of letters C3 80 to C3 BF
        accented[1:] &= (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)
        solid = (kind >= PUNCTUATION) | two
        here, before, second = kind[3:], slice(2, -1), slice(1, -2)
        cut = ((here == SPACE) | (here == LINE_END)) & solid[before]
        cut |= (here == PUNCTUATION) & ((kind[before] == LETTER) | accented[before])
        cut |= ((here >= PUNCTUATION) | self.latin[b[3:]]) & (kind[before] == LINE_END) & solid[second]
        return cut

    def stretches(self, at: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
        """Edges of pieces, a stretch at a time; documents' edges are among them."""
        lo, last = int(at[0]), int(at[-1])
        while lo < last:
            step = STEP
            while True:
                hi = min(lo + step, last)
                cut = np.zeros(hi - lo + 1, bool)
                cut[1:-1] = self.cuts(data, lo + 1, hi)
                cut[at[slice(*np.searchsorted(at, [lo, hi + 1]))] - lo] = True
                cut[0] = False
                if cut.any():
                    break
                step *= 2
            found = lo + np.flatnonzero(cut)
            yield np.concatenate([[lo], found])
            lo = int(found[-1])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text's; the texts must not be null."""
        at, data, buffer = buffers(column)
        ids, pieces, lens = [], [], []
        for edges in self.stretches(at, data):
            texts = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), buffer])
            coded = texts.dictionary_encode()
            numbers = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            n = self.upto[numbers + 1] - self.upto[numbers]
            ids.append(self.flat[np.repeat(self.upto[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            pieces.append(edges[:-1])
            lens.append(n)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
        return np.concatenate(ids), np.diff(total[np.searchsorted(np.concatenate(pieces), at)])

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The place of each text's ids in flat, between upto[i] and upto[i + 1]; texts not met before are encoded."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(found < 0)
        new = [texts[i] for i in missing.tolist()]
        # A word behind a space, put behind a character that is none, is cut off again: such pieces are encoded as one text.
        at, data, _ = buffers(pa.array(new, pa.string()))
        plain = np.diff(at) > 1
        begins, ends = at[:-1][plain], at[1:][plain]
        plain[plain] = (self.kind[data[begins]] == SPACE) & ((self.kind[data[begins + 1]] >= LETTER) | (data[begins + 1] == 0xC3)) & (self.kind[data[ends - 1]] >= LETTER)
        one, rest = [list(compress(new, flags.tolist())) for flags in (plain, ~plain)]
        found[missing[plain]] = len(self.known) + np.arange(len(one))
        found[missing[~plain]] = len(self.known) + len(one) + np.arange(len(rest))
        sizes = np.diff(at)[plain]
        for lo in range(0, len(one), 10_000):
            part = one[lo : lo + 10_000]
            ids = np.array(self.model.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            self.learn(part, ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[lo : lo + 10_000])) + 1)
        for lo in range(0, len(rest), 10_000):
            part = rest[lo : lo + 10_000]
            coded = [e.ids for e in self.model.encode_batch_fast(part, add_special_tokens=False)]
            n = np.cumsum([len(x) for x in coded])
            self.learn(part, np.fromiter(chain.from_iterable(coded), np.uint32, int(n[-1])), n)
        return found

    def learn(self, texts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first, begin = len(self.known), int(self.upto[len(self.known)])
        self.flat, self.upto = larger(self.flat, begin + len(ids)), larger(self.upto, first + len(texts) + 1)
        self.flat[begin : begin + len(ids)] = ids
        self.upto[first + 1 : first + len(texts) + 1] = begin + ends
        self.known.update(zip(texts, range(first, first + len(texts))))


def larger(x: np.ndarray, size: int) -> np.ndarray:
    """x, with room for size items at least."""
    return x if len(x) >= size else np.concatenate([x, np.zeros(max(len(x), size - len(x)), x.dtype)])


def tokenized(docs: DataFrame, tokenizer: str, size: int, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids, counts) in ascending order of ids in parts, width bytes an id. before: ids of the part before the document.

    Behind a part's documents there is a row without ids; its counts say how often each id below size occurs in the part. Documents
    are dealt out by ranges of id, and of a hash of the text among equal ids, so that one id does not fill a part.
    """
    spark = light(docs.sparkSession)
    # A worker keeps the tokenizer in its copy of the broadcast, so it is loaded once.
    shared, kind = spark.sparkContext.broadcast({"path": tokenizer}), f"<u{width}"
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["part", "before", "doc_id", "n_tokens", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        coder = mine["coder"] = mine.get("coder") or Pieces(mine["path"])
        part, before, counts = TaskContext.get().partitionId(), 0, np.zeros(size, np.int64)
        for batch in small(batches, 4_000):
            rows = batch.num_rows
            flat, n = coder.encode(batch.column(1))
            ends = np.cumsum(n + 1)
            out = np.full(int(ends[-1]), end_id, kind)
            text = np.ones(len(out), bool)
            text[ends - 1] = False
            out[text] = flat
            counts += np.bincount(out, minlength=size)
            starts = before + np.concatenate([[0], ends])
            columns = [pa.array(np.full(rows, part, np.int32)), pa.array(starts[:-1]), batch.column(0), pa.array(n + 1), binaries(out, np.concatenate([[0], ends])), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            before = int(starts[-1])
        last = (pa.int32(), part), (pa.int64(), before), (pa.int64(), None), (pa.int64(), 0), (pa.binary(), None), (pa.binary(), counts.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([value], kind) for kind, value in last], names=names)

    ranged = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ranged.mapInArrow(run, "part int, before long, doc_id long, n_tokens long, ids binary, counts binary")


def counted(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id below size occurs, from the parts' counts; tasks sum theirs, and the driver gets a number for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                n += np.frombuffer(counts.as_buffer(), "<i8")
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])

    found = tokens.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def put(files: pa.fs.FileSystem, path: str, data: bytes) -> None:
    """The file at once and whole: under another name first."""
    name = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(name, compression=None) as out:
        out.write(data)
    files.move(name, path)


def get(files: pa.fs.FileSystem, path: str) -> bytes:
    with files.open_input_file(path) as f:
        return f.read()


def read_table(files: pa.fs.FileSystem, path: str) -> rans.Table:
    data = get(files, f"{path}/_table")
    table = rans.Table(np.frombuffer(data[:-4], "<u4").astype(np.int64))
    if struct.unpack("<I", data[-4:])[0] != table.crc:
        raise ValueError("the table does not have its checksum")
    return table


@dataclass
class Files(WriterCommitMessage):
    """What a task has written: name, place of the first id, ids and sections of each file."""

    names: list[tuple[str, int, int, int]]


class _File:
    """A file under way: documents come in ascending order, blocks go out when they are full."""

    def __init__(self, files: pa.fs.FileSystem, folder: str, first: int, table: rans.Table, lanes: int, section: int):
        self.files, self.folder, self.first, self.table, self.lanes, self.section = files, folder, first, table, lanes, section
        self.temporary = f"{folder}/{first:020d}.{uuid.uuid4().hex}.tmp"
        self.out = files.open_output_stream(self.temporary, compression=None)
        self.out.write(struct.pack(HEAD, MAGIC, table.crc, lanes))
        self.offset, self.index, self.at, self.end = struct.calcsize(HEAD), [], first, first
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int, bool, int, int]] = []  # not all of which is written

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.end, len(ids)))
        self.ids.append(ids)
        self.end += len(ids)
        block = self.section * rans.SECTIONS
        if self.end - self.at >= block:
            flat = np.concatenate(self.ids)
            full = len(flat) // block * block
            for lo in range(0, full, block):
                self.write(flat[lo : lo + block])
            self.ids = [flat[full:].copy()]

    def write(self, block: np.ndarray) -> None:
        for part in rans.encode(block.astype(np.int64), self.table, self.lanes, self.section):
            docs = np.array([d for d in self.docs if d[2] < self.at + part.n], np.int64).reshape(-1, 4)
            columns = (docs[:, 0], docs[:, 1].astype(np.uint8), docs[:, 2], docs[:, 3], part.states, part.words)
            body = struct.pack(SECTION_HEAD, 0, part.n, len(docs), len(part.states), len(part.words), part.crc)[4:] + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
            self.out.write(struct.pack("<I", zlib.crc32(body)) + body)
            self.index.append((self.offset, self.at))
            self.offset += 4 + len(body)
            self.at += part.n
            self.docs = [d for d in self.docs if d[2] + d[3] > self.at]

    def close(self) -> tuple[str, int, int, int]:
        if self.end > self.at:
            self.write(np.concatenate(self.ids))
        self.out.write(np.array(self.index, "<i8").tobytes() + struct.pack(TAIL, self.offset, len(self.index), MAGIC))
        self.out.close()
        name = f"{self.first:020d}.rans"
        self.files.move(self.temporary, f"{self.folder}/{name}")
        return name, self.first, self.end - self.first, len(self.index)


class RansTokensWriter(DataSourceArrowWriter):
    """Takes (first, doc_id, ids), first the place of the document's first id among all ids. A task run again writes the same files."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])
        self.lanes, self.section, self.most = int(options["lanes"]), int(options["section"]), int(options["fileIds"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        files, folder = place_of(self.path)
        table = read_table(files, folder)
        out: list[tuple[str, int, int, int]] = []
        now: _File | None = None
        for batch in iterator:
            at, data, _ = buffers(batch.column(2))
            for i, (first, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if now and (first != now.end or now.end - now.first >= self.most):
                    out.append(now.close())
                    now = None
                now = now or _File(files, folder, first, table, self.lanes, self.section)
                now.add(doc_id, data[at[i] : at[i + 1]].view(f"<u{self.width}"))
        if now:
            out.append(now.close())
        return Files(out)

    def commit(self, messages: list[Files | None]) -> None:
        files, folder = place_of(self.path)
        names = sorted(n for m in messages if m for n in m.names)
        put(files, f"{folder}/_manifest", json.dumps({"files": names, "lanes": self.lanes, "section": self.section}).encode())
        kept = {n[0] for n in names}
        for info in files.get_file_info(pa.fs.FileSelector(folder)):
            if not info.base_name.startswith("_") and info.base_name not in kept:
                files.delete_file(info.path)


@dataclass
class Run(InputPartition):
    """Sections [first, last) of a file."""

    name: str
    first: int
    last: int


class RansTokensReader(DataSourceReader):
    """A task reads a run of sections and gives the documents that begin there, whole: it reads on to the end of its last one."""

    def __init__(self, options: dict):
        self.path, self.task_ids = options["path"], int(options.get("taskids", TASK_IDS))

    def partitions(self) -> list[Run]:
        files, folder = place_of(self.path)
        known = json.loads(get(files, f"{folder}/_manifest"))
        each = max(1, self.task_ids // known["section"])
        return [Run(name, i, min(n, i + each)) for name, _, _, n in known["files"] for i in range(0, n, each)] or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, folder = place_of(self.path)
        table = read_table(files, folder)
        with files.open_input_file(f"{folder}/{partition.name}") as f:
            magic, crc, lanes = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
            f.seek(f.size() - struct.calcsize(TAIL))
            offset, sections, end = struct.unpack(TAIL, f.read(struct.calcsize(TAIL)))
            if magic != MAGIC or end != MAGIC or crc != table.crc:
                raise ValueError(f"{partition.name} is no whole file of this table")
            f.seek(offset)
            index = np.frombuffer(f.read(16 * sections), "<i8").reshape(-1, 2)
            edges = [*index[:, 0].tolist(), offset]
            doc: tuple | None = None  # begun, but not read to its end
            held: list[np.ndarray] = []
            for i in range(partition.first, sections):
                if i >= partition.last and doc is None:
                    break
                f.seek(edges[i])
                docs, part = parsed(f.read(edges[i + 1] - edges[i]), partition.name)
                at = int(index[i, 1])
                if doc is None and not any(d[1] >= at for d in docs):
                    continue  # all of a document that begins before
                ids = rans.decode(part, table, lanes)
                rows = []
                for d in docs:
                    lo, hi = max(0, d[1] - at), min(len(ids), d[1] + d[2] - at)
                    if doc and d[1] == doc[1] or i < partition.last and d[1] >= at:
                        held.append(ids[lo:hi])
                        doc = d
                        if d[1] + d[2] <= at + part.n:
                            rows.append((*d, np.concatenate(held)))
                            doc, held = None, []
                if rows:
                    yield rows_of(rows)


def parsed(data: bytes, name: str) -> tuple[list[tuple], rans.Section]:
    """(doc_id, start, size) of the documents that overlap a section, and the section."""
    check, n, docs, states, words, crc = struct.unpack(SECTION_HEAD, data[: struct.calcsize(SECTION_HEAD)])
    if zlib.crc32(data[4:]) != check:
        raise ValueError(f"a section of {name} does not have its checksum")
    out, at = [], struct.calcsize(SECTION_HEAD)
    for kind, size in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", docs), ("<u8", states), ("<u4", words)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    ids = [None if null else i for i, null in zip(out[0].tolist(), out[1].tolist())]
    return list(zip(ids, out[2].tolist(), out[3].tolist())), rans.Section(n, out[4].astype(np.uint64), out[5].astype(np.uint32), crc)


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    flat, sizes = np.concatenate([r[3] for r in rows]).astype("<u4"), [len(r[3]) for r in rows]
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, binaries(flat, np.concatenate([[0], np.cumsum(sizes)]))], names=["doc_id", "start", "n_tokens", "ids"])


class RansTokens(DataSource):
    """Folders of token files as a format of Spark."""

    @classmethod
    def name(cls) -> str:
        return "rans_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RansTokensReader:
        return RansTokensReader(self.options)

    def writer(self, schema, overwrite: bool) -> RansTokensWriter:
        return RansTokensWriter(self.options)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", lanes: int = rans.LANES, section: int = rans.SECTION, file_ids: int = FILE_IDS) -> None:
    """Encodes the texts, ends each document with end_id, and writes the ids in ascending order of document ids into a new folder.

    The texts are tokenized once; frequencies are counted over all ids. A null text has only the end id, as an empty one.
    Rows with a null id come first; rows that repeat an id are documents of their own, in the order of a hash of their text (ties:
    equal texts, hence equal ids). Very long texts are tokenized in stretches and coded in blocks; an empty table gives a folder
    without files. Other columns are not read, whatever their names. A folder that holds token files is an error.
    """
    spark = docs.sparkSession
    if section % lanes:
        raise ValueError("section must be a multiple of lanes")
    files, folder = place_of(path)
    files.create_dir(folder, recursive=True)
    if files.get_file_info(f"{folder}/_manifest").type != pa.fs.FileType.NotFound:
        raise ValueError(f"{path} holds token files already")
    size = max(Pieces(tokenizer).size, end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    tokens = written(tokenized(docs, tokenizer, size, end_id, width, id_col, text_col))
    table = rans.Table.of(counted(tokens, size))
    put(files, f"{folder}/_table", table.freq.astype("<u4").tobytes() + struct.pack("<I", table.crc))
    # One row for each part, of which there are as many as shuffle partitions.
    parts = sorted(map(tuple, tokens.groupBy("part").agg(F.sum("n_tokens")).collect()))
    before = np.concatenate([[0], np.cumsum([n for _, n in parts])])[:-1].tolist()
    offsets = F.broadcast(spark.createDataFrame([(p, b) for (p, _), b in zip(parts, before)], "part int, offset long"))
    spark.dataSource.register(RansTokens)
    out = tokens.filter("ids is not null").join(offsets, "part").select((F.col("offset") + F.col("before")).alias("first"), "doc_id", "ids")
    out.write.format("rans_tokens").options(width=width, lanes=lanes, section=section, fileIds=file_ids).mode("append").save(path)
    discard(tokens)


def read_tokens(spark: SparkSession, path: str, task_ids: int = TASK_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder's documents; ids as little-endian unsigned 32-bit integers, start the number of ids before.

    A task decodes about task_ids ids. Checksums of table, sections and ids are compared: a damaged file is an error.
    """
    spark.dataSource.register(RansTokens)
    return spark.read.format("rans_tokens").option("taskIds", task_ids).load(path)


def new_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/loomframe-tokens-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path
