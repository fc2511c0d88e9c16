"""Queries: the event log as a stream, run over all that is there, against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.operators import joins as J
from loomframe.operators.state import snapshot
from loomframe.plans.base import query
from loomframe.plans.extraction import scratch
from loomframe.plans.payloads import FOLD
from loomframe.sources import adapters as V
from loomframe.streaming import events as S
from loomframe.streaming import state as T

NTZ = "timestamp_ntz"


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1, 2")
def stream_event_counts(spark, sf_dir):
    out = S.run_to_table(S.event_counts(S.source(spark, sf_dir)), scratch(spark), "complete")
    return out.select("user_id", "event_type", "n", F.col("last_at").cast(NTZ).alias("last_at"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """Events that come twice (polled and pushed) count once."""
    rows = S.source(spark, sf_dir)
    out = S.run_to_table(S.deduplicated(rows.union(rows), "event_id"), scratch(spark))
    return out.select("event_id", "user_id", "event_type")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT hour, event_type, n FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM events)""")
def stream_hourly(spark, sf_dir):
    """Hours that the watermark has passed; the last ones are still open."""
    out = S.run_to_table(S.hourly(S.source(spark, sf_dir)), scratch(spark))
    return out.select(F.col("window.start").cast(NTZ).alias("hour"), "event_type", "n")


@query("""WITH o AS (SELECT *, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS failures FROM events)
SELECT user_id, CAST(max(failures) AS BIGINT) AS failures, min(ts) FILTER (failures >= 5) AS tripped_at, count(*) FILTER (failures >= 5) AS after_trip FROM o GROUP BY 1""")
def stream_breaker(spark, sf_dir):
    """Keyed state: failures until the breaker trips; the table has the last row of each key."""
    out = S.run_to_table(T.breakers(S.source(spark, sf_dir), "user_id", "event_id", F.col("value") < 20), scratch(spark), "update", keys=["key"])
    return out.select(F.col("key").alias("user_id"), "failures", F.col("tripped_at").cast(NTZ).alias("tripped_at"), "after_trip")


@query("""WITH RECURSIVE w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS w FROM events),
e AS (SELECT *, event_type = 'view' AS quiet, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') = 'view' AS was FROM events),
s AS (SELECT user_id, event_id, ts, quiet, quiet AND NOT was AS begins, min(CASE WHEN NOT quiet THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM e)
SELECT user_id, event_id, ts AS since, ts + INTERVAL 30 SECOND AS alert_at FROM s, w WHERE begins AND ts + INTERVAL 30 SECOND <= w AND (ends IS NULL OR ends >= ts + INTERVAL 30 SECOND)""")
def stream_stuck(spark, sf_dir):
    """An alert for each job that stays pending for 30 s, when the time is up; jobs without any later event are among them."""
    out = S.run_to_table(T.stuck_episodes(S.source(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "view", 30), scratch(spark))
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("since").cast(NTZ).alias("since"), F.col("alert_at").cast(NTZ).alias("alert_at"))


#: Three providers in order of priority; a job may use all of them, or the last two.
PROVIDERS = ["first", "second", "third"]


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, event_id % 3 <> 0 AS limited, user_id % 4 <> 0 AS wide, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS INTEGER) AS now, [0, 0, 0] AS errors, [false, false, false] AS disabled, CAST(NULL AS INTEGER) AS prim, CAST(NULL AS INTEGER) AS gone, false AS off, false AS leave FROM (SELECT DISTINCT user_id FROM c)
  UNION ALL SELECT user_id, n, event_id, now, errors, [disabled[i] OR (off AND i = now) for i in [1, 2, 3]], CASE WHEN NOT off AND NOT leave THEN now END, CASE WHEN off OR leave THEN now END, off, leave FROM (
    SELECT *, coalesce(limited AND errors[now] >= 5, false) AS off, coalesce(NOT limited AND errors[now] >= 3, false) AS leave FROM (
      SELECT user_id, n, event_id, limited, disabled, now, [errors[i] + CASE WHEN i = now THEN 1 ELSE 0 END for i in [1, 2, 3]] AS errors FROM (
        SELECT *, CASE WHEN list_contains(picks, prim) THEN prim ELSE picks[1] END AS now FROM (
          SELECT *, CASE WHEN len([i for i in there if i IS DISTINCT FROM gone]) > 0 THEN [i for i in there if i IS DISTINCT FROM gone] ELSE there END AS picks FROM (
            SELECT c.user_id, c.n, c.event_id, c.limited, f.errors, f.disabled, f.prim, f.gone, [i for i in [1, 2, 3] if NOT f.disabled[i] AND (i > 1 OR c.wide)] AS there FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1))))))
SELECT user_id, event_id, (['first', 'second', 'third'])[now] AS provider, coalesce(errors[now], 0) AS errors, off AS disabled, leave AS left_ FROM f WHERE n > 0""")
def stream_failover(spark, sf_dir):
    """Failed calls of each job: a sticky primary, left at 3 errors and disabled at 5 limits, and the next by priority."""
    failed = S.source(spark, sf_dir).filter("event_type = 'error'")
    active = F.when(F.col("user_id") % 4 != 0, F.array(*map(F.lit, PROVIDERS))).otherwise(F.array(*map(F.lit, PROVIDERS[1:])))
    out = S.run_to_table(T.failover(failed, "user_id", "event_id", F.col("event_id") % 3 != 0, active, PROVIDERS), scratch(spark))
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "provider", "errors", "disabled", F.col("left").alias("left_"))


STATES = ["PENDING", "RUNNING", "RETRYABLE", "COMPLETE", "FAILED"]


@query("""WITH c AS (SELECT user_id, event_type, ts, event_id, (['PENDING', 'RUNNING', 'RETRYABLE', 'COMPLETE', 'FAILED'])[event_id % 5 + 1] AS state FROM events)
SELECT user_id, event_type, arg_max(state, (ts, event_id)) AS state, max(ts) AS last_at, count(*) FILTER (state IN ('RUNNING', 'RETRYABLE')) AS attempts FROM c GROUP BY 1, 2""")
def stream_attempts(spark, sf_dir):
    """Keyed state rows after full replaces, with their attempts, over batches of a few files, the run broken off and taken up again."""
    path = scratch(spark)
    S.by_batches(V.table(spark, sf_dir, "events"), f"{path}/in", "ts", 6)
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    changes = rows.select("user_id", "event_type", state.alias("state"), F.col("ts").alias("last_at"), "event_id")
    found = snapshot(changes, ["user_id", "event_type"], ["last_at", "event_id"]).drop("event_id")
    S.run_to_table(found, path, "update", keys=["user_id", "event_type"], die_after=1)
    return S.run_to_table(found, path, "update", keys=["user_id", "event_type"])


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'signup'")
def stream_resumed(spark, sf_dir):
    """A poll of landed files, two at a time, that dies behind the write of its second batch; what goes on from the checkpoint stores nothing twice."""
    path = scratch(spark)
    S.by_batches(V.table(spark, sf_dir, "events"), f"{path}/in", "ts", 6)
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    kept = rows.filter("event_type <> 'signup'").select("event_id", "user_id", "event_type", "value")
    S.run_to_table(kept, path, keys=[], die_after=1)
    return S.run_to_table(kept, path, keys=[])


#: The minute of the hour at which the poll that brings an event comes; every seventh is brought 20 minutes later, every eleventh by none.
POLLED = "date_trunc('hour', ts) + INTERVAL 5 MINUTE * CAST(minute(ts) // 5 + 1 AS INTEGER) + CASE WHEN event_id % 7 = 0 THEN INTERVAL 20 MINUTE ELSE INTERVAL 0 MINUTE END"


@query(f"""WITH p AS (SELECT event_id, {POLLED} AS polled_at FROM events WHERE event_id % 11 <> 0),
w AS (SELECT least((SELECT date_trunc('milliseconds', max(ts)) FROM events), (SELECT date_trunc('milliseconds', max(polled_at)) FROM p)) - INTERVAL 2 DAY AS w)
SELECT e.event_id, e.ts AS pushed_at, p.polled_at FROM events e LEFT JOIN p ON p.event_id = e.event_id AND p.polled_at BETWEEN e.ts AND e.ts + INTERVAL 10 MINUTE, w WHERE p.polled_at IS NOT NULL OR e.ts + INTERVAL 10 MINUTE < w""")
def stream_unpolled(spark, sf_dir):
    """Events pushed, with the poll that brought them too within 10 minutes, or none: two streams joined, each row held as long as it must be."""
    pushed = S.source(spark, sf_dir).select("event_id", F.col("ts").alias("pushed_at"))
    step = F.expr("make_dt_interval(0, 0, CAST(5 * (minute(ts) DIV 5 + 1) AS INT) + CAST(CASE WHEN event_id % 7 = 0 THEN 20 ELSE 0 END AS INT))")
    polled = S.source(spark, sf_dir).filter("event_id % 11 <> 0").select("event_id", (F.date_trunc("hour", "ts") + step).alias("polled_at"))
    out = S.run_to_table(S.unpolled(pushed, polled, "10 MINUTES"), scratch(spark))
    return out.select("event_id", *[F.col(c).cast(NTZ).alias(c) for c in ("pushed_at", "polled_at")])


@query(f"""WITH {V.LOGS}, b AS (SELECT job_id, stage, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, log_id DESC) AS back FROM logs),
t AS (SELECT job_id, string_agg(stage, ',' ORDER BY back DESC) AS stages FROM b WHERE back <= 50 GROUP BY 1),
s AS (SELECT job_id, count(*) AS n, arg_max(level, (ts, log_id)) AS level FROM logs WHERE job_id % 5 <> 0 GROUP BY 1)
SELECT e.event_id, e.user_id AS job_id, n, level, coalesce(stages, '') AS stages FROM events e LEFT JOIN s ON s.job_id = e.user_id LEFT JOIN t ON t.job_id = e.user_id WHERE e.event_type = 'signup'""")
def stream_catch_up(spark, sf_dir):
    """What each new subscriber of a stream gets: the job's snapshot, if there is one, and its last 50 rows, oldest first."""
    logs = V.logs(spark, sf_dir)
    snapshot = logs.filter("job_id % 5 <> 0").groupBy("job_id").agg(F.count("*").alias("n"), F.max_by("level", F.struct("ts", "log_id")).alias("level"))
    newest = J.newest(logs, "job_id", [F.col("ts"), F.col("log_id")], 50).select("job_id", "place", "stage")
    subscribers = S.source(spark, sf_dir).filter("event_type = 'signup'").select("event_id", F.col("user_id").alias("job_id"))
    out = S.run_to_table(S.caught_up(subscribers, snapshot, newest, "job_id"), scratch(spark))
    return out.select("event_id", "job_id", "n", "level", F.array_join("rows.stage", ",").alias("stages"))


@query(f"""WITH {V.LOGS}, {FOLD} SELECT job_id, arg_max(stage, (ts, log_id)) FILTER (stage IS NOT NULL) AS stage, arg_max(status, (ts, log_id)) FILTER (status IS NOT NULL) AS status, arg_max(progress, (ts, log_id)) FILTER (progress IS NOT NULL) AS progress, max(ts) AS last_at FROM f GROUP BY 1""")
def stream_fold(spark, sf_dir):
    """Partial events folded into one row a job as they come, a few files at a time: of each field the last value that is there."""
    path = scratch(spark)
    S.by_batches(V.logs(spark, sf_dir).select("job_id", "ts", "log_id", "stage", "level"), f"{path}/in", "ts", 6)
    n, rows = F.col("log_id"), spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    rows = rows.select("job_id", "ts", "log_id", F.when(n % 3 == 0, F.col("stage")).alias("stage"), F.when(n % 4 == 1, F.col("level")).alias("status"), F.when(n % 5 == 2, n % 100).alias("progress"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "log_id"))).alias(c)
    return S.run_to_table(rows.groupBy("job_id").agg(last("stage"), last("status"), last("progress"), F.max("ts").alias("last_at")), path, "update", keys=["job_id"])


@query(f"""WITH {V.LOGS}, l AS (SELECT job_id, lower(stage) AS item, max(ts) AS last_at, count(*) AS times FROM logs GROUP BY 1, 2)
SELECT job_id, item, last_at, times, row_number() OVER (PARTITION BY job_id ORDER BY last_at DESC, item) AS place FROM l QUALIFY place <= 3""")
def stream_mru(spark, sf_dir):
    """Move-to-front lists kept by a stream: the latest use of each item, of which each list's newest few are read."""
    uses = S.source(spark, sf_dir).groupBy(F.col("user_id").alias("job_id"), F.lower("event_type").alias("item")).agg(F.max("ts").alias("last_at"), F.count("*").alias("times"))
    items = S.run_to_table(uses, scratch(spark), "update", keys=["job_id", "item"])
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("last_at"), "item")).cast("bigint")
    return items.withColumns({"last_at": F.col("last_at").cast(NTZ), "place": place}).filter("place <= 3")


@query("""SELECT user_id AS job_id, arg_max(CAST(floor(value) AS BIGINT) % 100, (ts, event_id)) AS done, max(ts) AS last_at FROM events WHERE event_id % 10 <> 3 GROUP BY 1""")
def stream_progress(spark, sf_dir):
    """Progress files polled as they land: the newest snapshot of each job; one that is cut off is passed over."""
    path, n = scratch(spark), F.col("event_id")
    body = F.to_json(F.struct(F.col("user_id").alias("job"), (F.floor("value") % 100).alias("done"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), n.alias("seq")))
    rows = V.table(spark, sf_dir, "events").select("ts", F.when(n % 10 == 3, F.left(body, F.length(body) - 5)).otherwise(body).alias("value"))
    rows.repartitionByRange(4, "ts").select("value").write.text(f"{path}/in")
    read = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{path}/in").select(F.from_json("value", "job long, done long, at long, seq long, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("p"))
    whole = read.filter("p._broken is null and p.job is not null").select("p.*")
    newest = whole.groupBy(F.col("job").alias("job_id")).agg(F.max_by("done", F.struct("at", "seq")).alias("done"), F.max("at").alias("at"))
    out = S.run_to_table(newest, path, "update", keys=["job_id"])
    return out.select("job_id", "done", F.timestamp_micros("at").cast(NTZ).alias("last_at"))
