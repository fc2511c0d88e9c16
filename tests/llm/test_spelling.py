import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomframe.llm import registry, spelling
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, divisor=97, length=5, times=3):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % divisor == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= length
    return {w: k for w, k in n.items() if k >= times}


def brute_variants(n):
    cut = {}
    for w in n:
        for i in range(len(w)):
            cut.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (_, k), ws in cut.items():
        for w in ws:
            near[w] |= ws - {w}
            if k in n:
                near[w].add(k)
                near[k].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def collected(df):
    return sorted((x.word, x.form or "", x.root, x.n, x.n_near, x.form_n or 0) for x in df.collect())


def some_texts(count, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abé×ÀxyZ") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    gaps = [" ", ", ", "\n", "1", "漢", "Ā", "ã", "", "\xbf", "-"]
    return ["".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(0, 40))) for _ in range(count)]


def test_runs_equal_plain_ones(monkeypatch):
    texts = [*some_texts(60, 1), "", "é" * 300, "À" * 5, "x" * 200 + "é" + "y" * 60, "abcde", "abcdeé", "Ãƒabc漢defgh", "ijklmn"]
    ids = [None if i == 7 else i * 37 for i in range(len(texts))]
    for divisor in (97, 3, 1):
        want = brute_counts(zip(ids, texts), divisor, times=1)
        for step in (1 << 20, 1, 5, 64):
            monkeypatch.setattr(spelling, "STEP", step)
            got = Counter()
            for words, n in spelling.Runs().words(pa.array(["left", *texts]).slice(1), ids, divisor, 5):
                got.update(dict(zip(words.to_pylist(), n.to_pylist())))
            assert got == want


def test_hash_of_long_runs_is_that_of_short_ones(monkeypatch):
    text = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    begins, ends, seeds = np.array([0, 3, 50, 9]), np.array([5, 200, 51, 57]), np.array([1, 2, 3, 4], np.uint32)
    want = [zlib.crc32(text[b:e].tobytes(), int(s)) for b, e, s in zip(begins, ends, seeds)]
    for most in (48, 1, 1000):
        monkeypatch.setattr(spelling, "LONG", most)
        assert spelling.Runs().hashes(text, begins, ends, seeds).tolist() == want


@pytest.mark.parametrize("alphabet,longest,count", [("ab", 9, 200), ("abé", 7, 300), ("abcdefghijklmnopqrstuvwxyzàéü", 4, 400), ("a", 40, 30)])
def test_variants_equal_all_pairs(spark, alphabet, longest, count):
    r = random.Random(count)
    n = {"".join(r.choice(alphabet) for _ in range(r.randrange(1, longest))): r.choice([1, 2, 3, 4, 6, 8, 16, 40, 100]) for _ in range(count)}
    df = spark.createDataFrame([*n.items(), (None, 5)], "word string, n long")
    assert collected(spelling.variants(df)) == brute_variants(n)


def test_hubs_change_nothing(spark, monkeypatch):
    r = random.Random(8)
    n = {"".join(r.choice("abc") for _ in range(r.randrange(3, 8))): r.randrange(1, 50) for _ in range(300)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    for hubs in (1, 40):
        monkeypatch.setattr(spelling, "HUBS", hubs)
        assert collected(spelling.variants(df)) == brute_variants(n)


def test_a_word_takes_few_light_edges(spark):
    r = random.Random(2)
    n = {"".join(r.choice("abcd") for _ in range(12)): 3 for _ in range(2000)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").cache()
    parted = spelling.light_edges(df, spelling.heavy_edges(df)).groupBy("word").count().collect()
    assert max(x["count"] for x in parted) <= np.log2(len(n))


def test_documents_with_odd_rows(spark):
    texts = some_texts(300, 5)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2]), (90, None), (91, ""), (92, "kesto arime duvel " * 30_000 + "kestö")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute_counts(rows)
    assert len(want) > 40
    assert collected(spelling.variants(spelling.word_counts(df))) == brute_variants(want)
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_query_equals_sql(spark):
    assert compare(spark, "op11_errata_tries", SF, registry.QUERIES, registry.ORACLES) > 1000
