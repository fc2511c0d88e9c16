import random
import re
from collections import Counter

import pytest

from loomframe.llm import common, substring_dedup
from loomframe.llm.substring_dedup import remove_repeated


def brute(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - k + 1):
            if count[tuple(w[p : p + k])] > 1:
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    passage = [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(50)]
    rows = []
    for i in range(60):
        w = [r.choice("abcdefgh") + str(r.randrange(400)) for _ in range(r.randrange(0, 150))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[r.randrange(10) :]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100, None), (101, ""), (102, "x " * 90), (103, "p q r s t " * 8), (104, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (None, rows[6][1]), (105, "é ü " * 36), (106, "long " + "z" * 50000)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got.collect()], key=str)
    assert got == brute(rows, 35)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "k")], "doc_id long, text string, n_words long, _lf_k1 string").selectExpr("*", "1 as _LF_r1", "2 as _lf_ranges")
    row = remove_repeated(odd).first()
    assert (row.n_words, row.n_removed, row.kept_text) == (2, 0, "a b")
    assert (row["_lf_k1"], row["_LF_r1"], row["_lf_ranges"]) == ("k", 1, 2)


def test_windows_of_frequent_anchors(spark, monkeypatch):
    """A phrase with other words around it in many documents, and one whole passage."""
    monkeypatch.setattr(substring_dedup, "FREQUENT", 20)
    r = random.Random(5)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(4000))
    phrase, passage = [word() for _ in range(20)], [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(30)] + (passage if i % 4 == 0 else phrase) + [word() for _ in range(30)])) for i in range(120)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got.collect()], key=str) == brute(rows, 35)


def test_stretches_of_long_texts_change_nothing(monkeypatch):
    texts = [b"aa bb  cc\n" * 40, b"", b" ", b"z" * 300, b"dd " * 200]
    plain = common.Hasher(bases=2).words(texts)
    windows = common.Hasher(bases=2).windows(plain[0], 5)
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    cut = common.Hasher(bases=2).words(texts)
    assert all((a == b).all() for a, b in zip(plain[0], cut[0])) and (plain[1] == cut[1]).all()
    assert all((a == b).all() for a, b in zip(windows, common.Hasher(bases=2).windows(cut[0], 5)))


def test_a_full_row_of_counts_makes_no_anchor_hot(spark, monkeypatch):
    """With very few cells all anchors are estimated frequent; those that are, are counted, and the result is the same."""
    from loomframe.llm import sketch

    monkeypatch.setattr(substring_dedup, "FREQUENT", 15)
    monkeypatch.setattr(sketch, "COUNTS", sketch.SLICES)
    r = random.Random(6)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(4000))
    phrase, passage = [word() for _ in range(20)], [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(30)] + (passage if i % 4 == 0 else phrase) + [word() for _ in range(30)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = remove_repeated(df)
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got.collect()], key=str) == brute(rows, 35)
    texts = df.selectExpr("doc_id k1", "doc_id k2", "text t")
    every = sketch.Sketch(16, sketch.np.full((2, 1 << 13), 255, "u1"), sketch.np.full(sketch.COUNTS, 1000))
    width, bits, _ = substring_dedup.frequent_anchors(texts, spark.sparkContext.broadcast(tuple(every)), every.counts, 35, 10**6)
    hasher, n = common.Hasher(), Counter()
    for _, t in rows:
        (h,), bounds = hasher.words([t.encode()])
        n.update(substring_dedup.anchors(h, hasher, bounds, 35)[0].tolist())
    keys = sketch.np.array(list(n), sketch.np.uint64)
    hot = sketch.Sketch(width, bits, sketch.np.zeros(0)).repeated(keys)
    assert all(h for h, k in zip(hot, n.values()) if k >= 15) and any(k >= 15 for k in n.values()) and hot.mean() < 0.2
