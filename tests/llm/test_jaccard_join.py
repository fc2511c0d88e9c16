import random
import re
from itertools import combinations

import pytest

from loomframe.llm import common, jaccard_join
from loomframe.llm.jaccard_join import jaccard_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("seed,block", [(1, 4 << 20), (2, 2000), (3, 9000)])
def test_equals_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(jaccard_join, "BLOCK", min(4096, block // 500))
    r = random.Random(seed)
    word = lambda: r.choice("abcdef") + str(r.randrange(900))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(14):
        base = [word() for _ in range(r.choice([3, 6, 30, 80, 200]))]
        if g % 3 == 0:
            base = passage + base[:8]
        for _ in range(r.choice([1, 2, 3, 14])):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((0, " ".join(w).title() if r.random() < 0.2 else " ".join(w)))
    r.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, (_, t) in enumerate(rows)] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "x " * 4000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)


def test_odd_tables(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", 1), (7, "a b c d e f", 2)], "doc_id long, text string, n_shingles int")
    assert sorted((x.n_shingles, x.component_id) for x in odd.transform(jaccard_components).collect() if x.component_id) == [(2, 7)]
    named = odd.selectExpr("*", "1 as root", "2 as r1", "3 as _lf_s1", "4 as _LF_ROOT", "5 as h")
    assert sorted(tuple(x)[3:8] + (x.component_id or 0,) for x in jaccard_components(named.drop("n_shingles").selectExpr("doc_id", "text", "1 as x", "root", "r1", "_lf_s1", "_LF_ROOT", "h")).collect()) == [(1, 2, 3, 4, 5, 0), (1, 2, 3, 4, 5, 7)]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB", 5)
    monkeypatch.setattr(common, "HUBS", 4)
    r = random.Random(3)
    edges = [(7, i) for i in range(100, 160)] + [(900, i) for i in range(150, 190)] + [(i, i + 1) for i in range(300, 330)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(70)] + [(5, 5)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((i, find(i)) for i in root)
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
