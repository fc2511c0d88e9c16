import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomframe.llm import rans, registry, token_files

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "Hello", ".", ",", "'", "×", "÷.", "é.", "\x0b", "\x0c", "\n", "\n", "-", "²", "é", "漢", "🙂", " ", "  ", "\n", "\t ", "\r\n", " ", " ", "　", "\u0085", "ß", "'s", "don't", "12", "$$", "<|endoftext|>", "\x00", "x" * 50, "École ", "ǅ", "߿"]


@pytest.fixture(scope="module")
def model():
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return model


def odd_texts(n, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, 30))) for _ in range(n)]


def test_pieces_equal_whole_texts(model, monkeypatch):
    texts = odd_texts(1500)
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    for step, remembered in ((1 << 21, 300_000), (1, 300_000), (50, 20)):
        monkeypatch.setattr(token_files, "STEP", step)
        monkeypatch.setattr(token_files, "REMEMBERED", remembered)
        coder = token_files.Pieces(PATH)
        for lo in range(0, len(texts), 300):
            flat, n = coder.encode(pa.array(["left out", *texts[lo : lo + 300]]).slice(1))
            ends = np.cumsum(n)
            assert [flat[e - k : e].tolist() for e, k in zip(ends, n)] == want[lo : lo + 300]
    assert [len(x) for x in token_files.Pieces(PATH).encode(pa.array([], pa.string()))] == [0, 0]


def test_coder_round_trip_and_size():
    r = np.random.default_rng(1)
    for n, width in ((1, 1), (5, 3), (100, 1), (4096, 50_000), (70_000, 300), (300_000, 50_258)):
        ids = np.minimum(r.zipf(1.3, n) - 1, width - 1)
        table = rans.Table.of(np.bincount(ids, minlength=width + 2))
        assert int(table.freq.sum()) == 1 << rans.BITS and (table.freq[np.unique(ids)] > 0).all()
        for lanes, section in ((rans.LANES, rans.SECTION), (8, 64), (1, 7), (1024, 4096)):
            if n > 5_000 and lanes < 8:
                continue
            parts = rans.encode(ids, table, lanes, section)
            assert len(parts) == -(-n // section)
            assert [rans.decode(p, table, lanes).tolist() for p in parts[::-1]][::-1] == [ids[i : i + section].tolist() for i in range(0, n, section)]
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n
        parts = rans.encode(ids, table)
        assert sum(len(x.words) * 32 for x in parts) <= entropy * 1.01 + 64 * rans.LANES


def test_coder_finds_damage():
    ids = np.arange(200_000) * 7919 % 1009 % 77
    table = rans.Table.of(np.bincount(ids))
    for field in ("words", "states"):
        (part,) = rans.encode(ids, table)
        getattr(part, field)[3] ^= 1
        with pytest.raises(ValueError):
            rans.decode(part, table)
    (part,) = rans.encode(ids, table)
    part.words = part.words[:-1]
    with pytest.raises(ValueError):
        rans.decode(part, table)
    with pytest.raises(ValueError):
        rans.encode(np.array([77]), table)
    with pytest.raises(ValueError):
        rans.Table(np.array([5]))


def plain(rows, model):
    """(doc_id, start, ids) in ascending order of ids, by whole texts; rows that repeat an id in any order, so as sets of each id's texts."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_files_give_back_what_was_written(spark, model, tmp_path):
    texts = odd_texts(300, 9) + [None, "", "word " * 30_000, "é漢" * 20_000]
    rows = [(3 * i % 304 * 10 - 500, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, Ids int, part string").repartition(5)
    want = plain(rows, model)
    for k, (lanes, section, file_ids, task_ids) in enumerate([(1024, 1 << 18, 1 << 26, 1 << 22), (8, 64, 5_000, 64), (4, 32, 1, 1_000), (16, 4096, 40_000, 4096)]):
        path = str(tmp_path / f"t{k}")
        token_files.write_tokens(df, path, PATH, lanes=lanes, section=section, file_ids=file_ids)
        got = token_files.read_tokens(spark, path, task_ids).collect()
        assert sorted(((x.doc_id, x.start, np.frombuffer(x.ids, "<u4").tolist()) for x in got), key=lambda x: x[1]) == want
        assert all(4 * x.n_tokens == len(x.ids) for x in got)
        names = [n for n in os.listdir(path) if n.endswith(".rans")]
        assert sorted(names) == [f[0] for f in json.load(open(f"{path}/_manifest"))["files"]] and not [n for n in os.listdir(path) if n.endswith(".tmp")]
    assert len(names) >= 3
    with pytest.raises(ValueError):
        token_files.write_tokens(df, path, PATH)


def test_repeated_ids_and_empty_tables(spark, model, tmp_path):
    rows = [(1, "one"), (1, "one"), (1, "another one"), (0, "zero"), (None, "a"), (None, None)] + [(7, f"text {i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.write_tokens(df, str(tmp_path / "a"), PATH)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda x: x.start)
    key = lambda x: (x[0] is not None, x[0], x[1])
    assert sorted(((x.doc_id, np.frombuffer(x.ids, "<u4").tolist()) for x in got), key=key) == sorted(((i, ids) for i, _, ids in plain(rows, model)), key=key)
    assert [x.start for x in got] == np.cumsum([0] + [x.n_tokens for x in got])[:-1].tolist() and [x.doc_id for x in got] == sorted((x.doc_id for x in got), key=lambda i: (i is not None, i))
    token_files.write_tokens(df.limit(0), str(tmp_path / "b"), PATH)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_damaged_files_are_found(spark, tmp_path):
    path = str(tmp_path / "a")
    token_files.write_tokens(spark.createDataFrame([(i, f"some text {i}") for i in range(500)], "doc_id long, text string"), path, PATH)
    name = max((n for n in os.listdir(path) if n.endswith(".rans")), key=lambda n: os.path.getsize(f"{path}/{n}"))
    data = bytearray(open(f"{path}/{name}", "rb").read())
    for at in (3, len(data) // 2, len(data) - 3):
        broken = data.copy()
        broken[at] ^= 4
        open(f"{path}/{name}", "wb").write(broken)
        with pytest.raises(Exception, match="checksum|no whole file"):
            token_files.read_tokens(spark, path).collect()


def test_query_equals_whole_texts(spark, model):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, registry.QUERIES["op13_rans_tokens"](spark, SF).collect()), key=lambda x: x[1])
    assert got == [(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, start, ids in plain(docs, model)]
