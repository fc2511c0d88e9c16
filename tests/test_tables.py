"""Stored tables that change, exports, payloads that fail, functions of SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from loomframe.functions import sql as Q
from loomframe.sources import files as S
from loomframe.sources import payloads as P
from loomframe.sources.tables import StoredTable


def names(path):
    return {b: sorted(os.listdir(f"{path}/{b}")) for b in os.listdir(path) if b.startswith("_bucket")}


def test_a_change_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}", None) for i in range(200)] + [(None, "null key", 1)], "id long, value string, n long")
    table = StoredTable(spark, path, rows.schema, "id", buckets=8)
    assert table.rows().count() == 0 and table.seed(rows) and not table.seed(rows.limit(3))
    before = names(path)
    assert len(before) == 8
    table.upsert(spark.createDataFrame([(5, "new", 1), (5, "newer", 0), (1000, "added", None)], rows.schema))
    want = {i: (f"v{i}", None) for i in range(200)} | {None: ("null key", 1), 5: ("newer", 0), 1000: ("added", None)}
    assert {x.id: (x.value, x.n) for x in table.rows().collect()} == want and table.rows().count() == len(want)
    after = names(path)
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 2
    table.update(F.col("id") == 7, value=F.concat("value", F.lit("!")), n=F.lit(7).cast("long"))
    assert sum(after[b] != names(path)[b] for b in after) == 1
    assert {x.id: (x.value, x.n) for x in table.rows().collect()} == want | {7: ("v7!", 7)}
    same = names(path)
    table.update(F.col("id") == -1, value=F.lit("none"))
    assert names(path) == same
    with pytest.raises(Exception, match="boom"):
        table.update(F.col("id") < 100, value=F.when(F.col("id") == 50, F.raise_error(F.lit("boom"))).otherwise("x"))
    assert {x.id: (x.value, x.n) for x in table.rows().collect()} == want | {7: ("v7!", 7)}


def test_exports_begin_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, "line\nbreak"), (3, ""), (4, "plain")], "id long, note string")
    S.csv_export(rows.repartition(2), str(tmp_path / "x"))
    parts = glob.glob(str(tmp_path / "x/part-*"))
    assert parts and all(open(p, "rb").read().startswith("﻿id,note\n".encode()) for p in parts)
    assert '1,"a ""b"", c"' in "".join(open(p, encoding="utf-8-sig").read() for p in parts)


def test_promote_takes_its_digest_from_what_is_written(spark, tmp_path):
    unsteady = spark.range(1000).withColumn("r", F.rand())
    assert S.promote(unsteady, str(tmp_path / "t")).count() == 1000
    with pytest.raises(FileExistsError):
        S.promote(spark.range(3), str(tmp_path / "t"))


def test_payloads_that_fail(spark):
    bodies = [("al", '{"media": [{"id": 1, "title": {"romaji": "R"}}, {"title": {}}]}'), ("al", '{"media": broken'), ("al", None), ("al", "{}"), ("al", "[]"), ("mal", '{"data": [{"mal_id": "x"}]}'), ("mh", "<html></html>"), ("??", "x"), (None, None)]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "payload_id long, source string, body string")
    got = {x.source: (x.payloads, x["items"], x.broken, x.without_items, x.sample) for x in P.failures(df).collect()}
    assert got["al"][:4] in ((5, 1, 2, 2), (5, 1, 3, 1)) and got["al"][4] is not None
    assert got["mh"] == (1, 0, 0, 1, None) and got["??"] == (1, 0, 0, 1, None) and got[None] == (1, 0, 1, 0, None)
    assert got["mal"][:2] == (1, 0) and got["mal"][2] == 1
    assert P.every_source(df).count() == 1


def test_ratings(spark):
    df = spark.createDataFrame([("Rx - Hentai",), ("EROTICA 17",), ("R - 17+",), ("mature",), ("PG",), (None,)], "r string")
    assert [x[0] for x in df.select(P.rating_class(F.col("r"))).collect()] == ["pornographic", "erotica", "suggestive", "suggestive", "safe", "safe"]


def test_functions_are_inlined(spark):
    Q.register(spark, tables={"lf_twice(n INT)": ("v INT", "SELECT n UNION ALL SELECT n")})
    plan = spark.sql("SELECT lf_clock(id) AS c, lf_js_round(id / 2D) AS r FROM range(10)")
    assert "lf_clock" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [x.c for x in spark.sql("SELECT lf_clock(3725L) AS c UNION ALL SELECT lf_clock(65L)").collect()] == ["1:02:05", "1:05"]
    assert [x.v for x in spark.sql("SELECT v FROM VALUES (1), (2) AS t(n), LATERAL lf_twice(n) ORDER BY v").collect()] == [1, 1, 2, 2]
    assert spark.sql("SELECT lf_leading_number(' 12.5 (end)') AS a, lf_leading_number('x') AS b").first() == (12.5, None)
    assert spark.sql("SELECT * FROM lf_windows(0L, 5L)").count() == 0 and [tuple(x) for x in spark.sql("SELECT * FROM lf_windows(11L, 5L)").collect()] == [(0, 5), (5, 10), (10, 11)]
