import numpy as np
import pyarrow as pa
import pytest

from loomframe.llm import sketch


@pytest.mark.parametrize("merged,held", [(1 << 26, 1 << 21), (64, 500)])
def test_no_repeated_key_is_lost(spark, merged, held, monkeypatch):
    monkeypatch.setattr(sketch, "MERGED", merged)
    monkeypatch.setattr(sketch, "HELD", held)
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 3000, dtype=np.int64)
    keys = np.concatenate([keys, keys[:200], keys[:50]])
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(6)
    found = sketch.Sketch(*sketch.build(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), len(keys), 16))
    estimated = found.repeated(keys[:3000].view(np.uint64))
    assert estimated[:200].all() and estimated[200:].mean() < 0.15
    assert found.bits.nbytes * 8 == 1 << found.width


def test_two_rows_and_counts(spark, monkeypatch):
    monkeypatch.setattr(sketch, "HELD", 500)
    r = np.random.default_rng(3)
    # Smallest of many hashes: these crowd at the low end of the range.
    keys = r.integers(0, 1 << 63, (60_000, 19), dtype=np.int64).min(1)
    keys = np.concatenate([keys, keys[:500], np.repeat(keys[7:9], 3000)])
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    of = lambda rows: sketch.Sketch(*sketch.build(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), len(keys), 16, rows, counted=True))
    for rows in (1, 2):
        found = of(rows)
        assert found.bits.shape[0] == rows and found.counts.sum() == len(keys)
        estimated = found.repeated(keys[:60_000].view(np.uint64))
        load = 60_000 / (1 << found.width)
        assert estimated[:500].all() and estimated[500:].mean() < 1.2 * (1 - np.exp(-load)) ** rows
        often = found.frequent(keys[:60_000].view(np.uint64), 2000)
        assert often[7:9].all() and often.sum() < 10


def test_nothing_to_sketch(spark):
    empty = spark.createDataFrame([], "k long")
    found = sketch.Sketch(*sketch.build(empty, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 0, 2))
    assert not found.repeated(np.array([1, 2], np.uint64)).any() and isinstance(pa.array([1]), pa.Array)


def test_steps_without_keys_come_first(spark, monkeypatch):
    monkeypatch.setattr(sketch, "HELD", 500)
    keys = np.concatenate([np.random.default_rng(2).integers(0, 1 << 63, 2000, dtype=np.int64)] * 2)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").coalesce(1)

    def steps(batch):  # nothing, then keys, then nothing again: before the first emission and after each
        for part in np.array_split(batch.column(0).to_numpy().view(np.uint64), 8):
            yield part[:0]
            yield part
            yield part[:0]

    found = sketch.Sketch(*sketch.build(df, steps, len(keys), 16))
    assert found.repeated(keys.view(np.uint64)).all()
