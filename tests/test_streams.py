"""Streams that stop and go on, rows that come in several batches, keys without later rows."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from loomframe.streaming import events as S
from loomframe.streaming import state as T

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def naive(ts):
    return None if ts is None else ts.replace(tzinfo=datetime.timezone.utc)


def landed(spark, path, rows, schema, n):
    """One file more, newer than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    for name in os.listdir(path):
        if name.endswith(".parquet") and not name.startswith("f"):
            os.rename(f"{path}/{name}", f"{path}/f{n:03d}.parquet")
            os.utime(f"{path}/f{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def read(spark, path, schema, **options):
    return spark.readStream.schema(schema).options(pathGlobFilter="f*.parquet", maxFilesPerTrigger=1, **options).parquet(path)


CALLS = "user_id long, ts timestamp, event_id long, failed boolean"


def test_breakers_go_on_after_a_restart(spark, tmp_path):
    r, want, last = random.Random(4), {}, {}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for b in range(4):
        rows = [(r.randrange(6), at(b * 1000 + r.randrange(600)), b * 1000 + i, r.choice([True, False, False, None])) for i in range(40)]
        landed(spark, str(tmp_path / "in"), rows, CALLS, b)
        for key, ts, _, failed in sorted(rows, key=lambda x: (x[1], x[2])):
            f, t, a = want.get(key, (0, None, 0))
            f += bool(failed)
            want[key] = (f, t or ts, a + 1) if f >= 5 else (f, None, a)
        stream = T.breakers(read(spark, str(tmp_path / "in"), CALLS), "user_id", "event_id", F.col("failed"))
        if b != 1:  # two files wait for the third run
            out = S.run_to_table(stream, str(tmp_path / "run"), "update", keys=["key"], die_after=2 if b == 2 else None)
        if b == 0:
            last = {x.key: x.failures for x in out.collect()}
            again = S.run_to_table(stream, str(tmp_path / "run"), "update", keys=["key"])
            assert {x.key: x.failures for x in again.collect()} == last, "a run without new files keeps what there was"
    got = {x.key: (x.failures, naive(x.tripped_at), x.after_trip) for x in out.collect()}
    assert got == want and any(t for _, t, _ in want.values())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def plain_failover(rows, providers, disable=5, switch=3):
    out, state = [], {}
    for key, _, id_, limited, active in sorted(rows, key=lambda x: (x[1], x[2])):
        s = state.setdefault(key, {"errors": {}, "off": set(), "primary": None, "left": None})
        there = [p for p in providers if p in active and p not in s["off"]]
        if there != [s["left"]]:
            there = [p for p in there if p != s["left"]]
        s["left"] = None
        if not there:
            s["primary"] = None
            out.append((key, id_, None, 0, False, False))
            continue
        p = s["primary"] = s["primary"] if s["primary"] in there else there[0]
        n = s["errors"][p] = s["errors"].get(p, 0) + 1
        off, leave = limited and n >= disable, not limited and n >= switch
        if off:
            s["off"].add(p)
        if off or leave:
            s["primary"], s["left"] = None, p
        out.append((key, id_, p, n, off, leave))
    return sorted(out, key=str)


def test_failover_over_restarts(spark, tmp_path):
    r, rows = random.Random(6), []
    schema = "user_id long, ts timestamp, event_id long, limited boolean, active array<string>"
    names = ["a", "b", "c"]
    for b in range(3):
        new = [(k, at(b * 1000 + r.randrange(900)), b * 1000 + i, r.random() < 0.5, names[k % 2 :] if k else []) for i in range(70) for k in [r.randrange(5)]]
        landed(spark, str(tmp_path / "in"), new, schema, b)
        rows += new
        stream = T.failover(read(spark, str(tmp_path / "in"), schema), "user_id", "event_id", F.col("limited"), F.col("active"), names)
        out = S.run_to_table(stream, str(tmp_path / "run"))
    got = sorted((tuple(x) for x in out.collect()), key=str)
    assert got == plain_failover(rows, names)
    assert {x[2] for x in got} == {"a", "b", "c", None} and any(x[4] for x in got) and any(x[5] for x in got)


def plain_stuck(rows, seconds, now):
    out, state = [], {}
    end = sorted({x[0] for x in rows})
    for key, ts, id_, quiet in sorted((x for x in rows if x[1] <= now), key=lambda x: (x[1], x[2])) + [(k, now, None, None) for k in end]:
        since = state.get(key)
        if since and not since[2] and (ts - since[0]).total_seconds() >= seconds:
            since[2] = True
            out.append((key, since[1], since[0], since[0] + datetime.timedelta(seconds=seconds)))
        if quiet is False:
            state[key] = None
        elif quiet and not since:
            state[key] = [ts, id_, False]
    return sorted(out)


@pytest.mark.parametrize("mixed", [False, True])
def test_stuck_jobs_over_files_and_restarts(spark, tmp_path, mixed):
    """Jobs that no row follows are found, each once, whatever files hold the rows and wherever the run stops."""
    r = random.Random(7)
    rows = [(r.randrange(8), at(i * 7 + r.random()), i, r.random() < 0.7) for i in range(300)]
    rows += [(100, at(500.5), 1000, True), (101, at(2090.25), 1001, True), (102, at(900.125), 1002, True), (102, at(915.5), 1003, False)]
    rows.sort(key=lambda x: x[1] if not mixed else at((x[1] - START).total_seconds() + r.randrange(0, 240)))
    schema = "user_id long, ts timestamp, event_id long, quiet boolean"
    for b in range(4):
        landed(spark, str(tmp_path / "in"), rows[b * 80 : (b + 1) * 80], schema, b)
        stream = T.stuck_episodes(read(spark, str(tmp_path / "in"), schema), "user_id", "event_id", F.col("quiet"), 30, late="5 minutes")
        if b != 2:
            out = S.run_to_table(stream, str(tmp_path / "run"))
    newest = max(x[1] for x in rows).replace(microsecond=0)
    now = datetime.datetime.fromtimestamp(int(max(x[1] for x in rows).timestamp() * 1000) / 1000, datetime.timezone.utc) - datetime.timedelta(minutes=5)
    got = sorted((x.key, x.id, naive(x.since), naive(x.alert_at)) for x in out.collect())
    want = plain_stuck(rows, 30, now)
    assert newest and got == want and (100, 1000) in [x[:2] for x in got] and 102 not in [x[0] for x in got] and 101 not in [x[0] for x in got]


def test_a_batch_run_again_is_stored_once(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, failed boolean"
    for b in range(5):
        landed(spark, str(tmp_path / "in"), [(1, at(b), b * 10 + i, True) for i in range(10)], schema, b)
    rows = read(spark, str(tmp_path / "in"), schema).select("event_id")
    first = S.run_to_table(rows, str(tmp_path / "run"), keys=[], die_after=2)
    assert sorted(x.event_id for x in first.collect()) == list(range(30))
    for _ in range(2):
        out = S.run_to_table(rows, str(tmp_path / "run"), keys=[])
        assert sorted(x.event_id for x in out.collect()) == list(range(50))
    total = S.run_to_table(rows.groupBy().agg(F.count("*").alias("n")), str(tmp_path / "sum"), "complete", die_after=3)
    total = S.run_to_table(rows.groupBy().agg(F.count("*").alias("n")), str(tmp_path / "sum"), "complete")
    assert [x.n for x in total.collect()] == [50]


def test_subscribers_without_rows(spark):
    none = spark.createDataFrame([(1, 9)], "job_id long, sub long")
    newest = spark.createDataFrame([(2, 1, "a")], "job_id long, place long, stage string")
    out = S.caught_up(none, spark.createDataFrame([(2, 5)], "job_id long, n long"), newest, "job_id").collect()
    assert [(x.job_id, x.sub, x.n, x.rows) for x in out] == [(1, 9, None, [])]
