import numpy as np
import pytest

from loomframe.llm import embedding_dedup
from loomframe.llm.embedding_dedup import embedding_groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, a, x in good:
        for j, b, y in good:
            if i != j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
    out = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(links[i]), min(seen), i == min(seen)))
    return sorted(out)


@pytest.mark.parametrize("seed,block,cell", [(1, 2048, 30), (2, 16, 30), (3, 16, 2000)])
def test_equals_brute_force(spark, seed, block, cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    r = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 7)):
            rows.append(((base + r.normal(size=8) * r.choice([0, 0.15, 0.3])).astype(np.float32).tolist(), int(g % 3)))
    rows = [(i + 1, v, y) for i, (v, y) in enumerate(rows)]
    n = len(rows)
    rows += [(n + 10, None, 1), (n + 11, [0.0] * 8, 1), (n + 12, [float("nan")] * 8, 1), (n + 13, rows[0][1], None), (n + 14, [float("inf")] + [1.0] * 7, 0), (n + 15, [], 0), (n + 16, [1.0, None] + [1.0] * 6, 0), (n + 17, [1e-30] * 8, 2), (n + 18, [1e30] * 8, 2), (n + 19, [1.0, 2.0], 2)]
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA))
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got.collect()) == brute(rows)


def test_odd_tables(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1, "a"), (4, [1.0, 2.0], 1, "b")], SCHEMA + ", kept string")
    assert sorted((x.n_links, x.component_id or 0, x.kept) for x in embedding_groups(odd).collect()) == [(0, 0, True), (0, 4, True)]
    named = odd.selectExpr("vec_id", "embedding", "label", "1 as _lf_v", "2 as _LF_H", "3 as _lf_c", "4 as rep")
    assert all(tuple(x)[3:7] == (1, 2, 3, 4) for x in embedding_groups(named).collect())


def test_vectors_are_stored_once(spark, monkeypatch):
    """However many cells a vector may have neighbours in, so disk grows no faster than the input."""
    stored, write = [], embedding_dedup.written

    def noted(df, *by):
        out = write(df, *by)
        stored.append(out.count() if "v" in df.columns else 0)
        return out

    monkeypatch.setattr(embedding_dedup, "written", noted)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 64))
    more = base[r.integers(0, 300, 100)] + r.normal(size=(100, 64)) * 0.38
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, more]))]
    rows += [(400 + i, rows[7][1], 1) for i in range(200)] + [(600, [-0.0] + rows[0][1][1:], 1), (601, [0.0] + rows[0][1][1:], 1)]
    got = embedding_groups(spark.createDataFrame(rows, SCHEMA.replace("float", "double")))
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got.collect()) == brute(rows)
    assert sum(stored) == 401


@pytest.mark.parametrize("spread,cells,threshold", [(0.2, 5, 0.93), (0.6, 12, 0.93), (2.0, 40, 0.75)])
def test_cells_leave_out_no_link(spread, cells, threshold):
    r = np.random.default_rng(cells)
    raw = (r.normal(size=(6, 16))[r.integers(0, 6, 900)] + spread * r.normal(size=(900, 16))).astype(np.float32)
    x = embedding_dedup.scaled(raw)
    c = embedding_dedup.centroids(x, cells)
    cell = (x @ c.T).argmax(1)
    order = np.argsort(cell, kind="stable")
    raw, cell, x = raw[order], cell[order], x[order]
    half = np.arange(900) % 2 == 0  # cells that lie on both shelves
    met = embedding_dedup.Met(np.ones(900, np.int64), np.arange(900))
    one, two = embedding_dedup.Side(0, raw[half], cell[half]), embedding_dedup.Side(450, raw[~half], cell[~half])
    for left, right in ((one, one), (one, two), (two, two)):
        embedding_dedup.meet(met, left, right, c, threshold)
    x = np.concatenate([x[half], x[~half]])
    near = x @ x.T >= threshold
    assert (met.links == near.sum(1) - 1).all() and met.links.any()
    low, before = np.arange(900), None
    while before is None or (low != before).any():
        before, low = low, np.where(near, low, 900).min(1)
    assert (met.roots() == low).all()


def test_cells_share_shelves_or_are_dealt_over_several():
    first, parts, n = embedding_dedup.shelved(np.array([3.0, 4.0, 25.0, 6.0, 0.0, 5.0]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1] and n == 6
