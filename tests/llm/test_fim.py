import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomframe.llm import fim, registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def brute(doc_id, text, rate=90, spm_rate=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_rate else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def rows():
    r = random.Random(3)
    bits = ["a", "é", "漢", "🙂", "<", "S", ">", "M>", "\n", " ", "́", "<P", "xyz"]
    out = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 40)))) for i in range(400)]
    return out + [(500, None), (501, ""), (502, "<P>"), (503, "a <M> b"), (504, "🙂"), (505, "é漢" * 300_000), (None, "no id at all"), (3, out[3][1]), (3, "another text of the same id")]


def test_equals_slicing_by_code_points(spark):
    want = sorted(((i, *brute(i, t), t or "") for i, t in rows()), key=repr)
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows()], "doc_id long, text string, Form string, _lf_h0 int")
    got = fim.restore(fim.fill_in_middle(df))
    assert got.columns == ["doc_id", "text", "_lf_h0", "n_units", "form", "prefix_units", "middle_units", "output", "restored"]
    have = sorted((tuple(x) for x in got.select("doc_id", "n_units", "form", "prefix_units", "middle_units", "output", "restored").collect()), key=repr)
    assert have == want
    assert {x[2] for x in have} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_rates(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    forms = lambda **k: {x.form for x in fim.fill_in_middle(df, **k).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm_rate=0) == {"psm"} and forms(rate=100, spm_rate=100) == {"spm"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="lines")


def test_words_are_cut_before_words(spark):
    texts = ["one  two\nthree ", " lead é漢 b", "x", "  ", ""]
    at, data, _ = fim.buffers(pa.array(texts))
    cutter = fim.Cutter(at, data, "words")
    assert cutter.counts().tolist() == [3, 4, 1, 1, 0]
    cuts = cutter.cuts(np.array([[0, 1, 2, 3]] * 5)) - at[:-1, None]
    assert cuts.tolist() == [[0, 5, 9, 15], [0, 1, 6, 12], [0, 1, 1, 1], [0, 2, 2, 2], [0, 0, 0, 0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(x.restored == x.text for x in fim.restore(fim.fill_in_middle(df, unit="words", rate=100)).collect())


def test_stretches_do_not_change_cuts(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("aé漢🙂 ") for _ in range(r.randrange(0, 60))) for _ in range(80)]
    column = pa.array(["skipped", *texts]).slice(1)
    hashes = np.array([[r.randrange(2**32) for _ in range(4)] for _ in texts])
    for unit in fim.UNITS:
        monkeypatch.setattr(fim, "STEP_BYTES", 1 << 18)
        whole = [x.to_pylist() for x in fim.rewrite(column, hashes, unit, 90, 20)]
        for step in (1, 2, 7, 64):
            monkeypatch.setattr(fim, "STEP_BYTES", step)
            assert [x.to_pylist() for x in fim.rewrite(column, hashes, unit, 90, 20)] == whole


def test_query_equals_sql(spark):
    compare(spark, "op12_fill_in_middle", SF, registry.QUERIES, registry.ORACLES)
