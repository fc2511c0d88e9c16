"""Queries: payload shapes, cascades, choices, folds of events, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.exprs import ACTIVE
from loomframe.operators import joins as J
from loomframe.plans.base import query
from loomframe.plans.extraction import scratch
from loomframe.sources import adapters as V
from loomframe.sources import payloads as P
from loomframe.streaming import events as S

@query(f"WITH {V.LANDED} SELECT source, id, title, cover, language, CAST(year AS BIGINT) AS year, tags, CAST(arrival AS BIGINT) AS arrival FROM landed")
def payload_union(spark, sf_dir):
    """Nine sources' payload shapes, malformed ones among them, as one catalog."""
    return P.every_source(V.landed(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS k, (['mh', 'ff', 'wt', 'as', 'md', 'mp', 'tl', 'mal', 'al', 'al'])[p_partkey % 10 + 1] AS source, p_partkey % 10 = 9 AS broken, p_partkey % 10 AS shape FROM part)
SELECT source, count(*) AS payloads, CAST(sum(CASE WHEN broken THEN 0 WHEN shape IN (0, 1, 2, 5) THEN 2 ELSE 1 END) AS BIGINT) AS items, count(*) FILTER (broken) AS broken, CAST(0 AS BIGINT) AS without_items, CASE WHEN bool_or(broken) THEN '{"media": broken' END AS sample FROM p GROUP BY 1""")
def payload_failures(spark, sf_dir):
    """What each source's payloads gave, how many could not be read, and one of these."""
    return P.failures(V.landed(spark, sf_dir))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, (['suggestive', 'pornographic', 'safe', 'erotica', 'safe', 'suggestive'])[p_partkey // 10 % 6 + 1] AS rating FROM part WHERE p_partkey % 10 = 7")
def rating_classes(spark, sf_dir):
    """Audience ratings of one source as classes."""
    return P.every_source(V.landed(spark, sf_dir).filter("source = 'mal'"), "rating").select("id", "rating")


@query(r"""WITH h AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS l FROM pages), f AS (SELECT page_id, value, min(i) AS first_at FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS value, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages) GROUP BY 1, 2)
SELECT page_id, value, row_number() OVER (PARTITION BY page_id ORDER BY first_at DESC) AS chapter, coalesce(nullif(ltrim(regexp_extract(value, '([0-9]+)', 1), '0'), ''), '0') AS number FROM f""")
def chapter_list_extract(spark, sf_dir):
    """Links of a page, newest first, numbered from the oldest; their numbers without leading zeros."""
    from loomframe.functions.exprs import unpadded
    from loomframe.operators.extract import matches

    rows = matches(V.table(spark, sf_dir, "pages"), "page_id", "html", r'href="([^"]+)"')
    chapter = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("place"))).cast("bigint")
    return rows.select("page_id", "value", chapter.alias("chapter"), unpadded(F.regexp_extract("value", "([0-9]+)", 1)).alias("number"))


@query(f"WITH {V.OCR} SELECT page, CASE WHEN status = 'SUCCESS' THEN 'first' WHEN page % 3 = 0 AND (page % 7) / 7 > conf THEN 'second' ELSE 'first' END AS chosen FROM ocr")
def cascade_select(spark, sf_dir):
    """The second candidate only where the first did not succeed, and the second did and is strictly better."""
    second_ok, second = F.col("page") % 3 == 0, (F.col("page") % 7) / 7
    return V.ocr(spark, sf_dir).select("page", F.when(F.col("status") == "SUCCESS", "first").when(second_ok & (second > F.col("conf")), "second").otherwise("first").alias("chosen"))


@query(f"""WITH {V.BOXES}, p AS (SELECT page, count(*) AS n, count(*) FILTER (w > 25) AS m, max(w * h) AS biggest FROM boxes GROUP BY 1)
SELECT page, CASE WHEN n >= 2 AND n >= m THEN 'contour' WHEN m >= 2 THEN 'model' WHEN n = 0 OR (n = 1 AND biggest >= 0.7 * 2500) THEN 'whole' ELSE 'contour' END AS chosen FROM p""")
def detector_choice(spark, sf_dir):
    """Which detector's boxes a page takes: the one with more of two or more; the whole page if one box nearly fills it."""
    n, m = F.col("n"), F.col("m")
    rows = V.boxes(spark, sf_dir, dealt=False).groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("w") > 25).alias("m"), F.max(F.col("w") * F.col("h")).alias("biggest"))
    return rows.select("page", F.when((n >= 2) & (n >= m), "contour").when(m >= 2, "model").when((n == 0) | ((n == 1) & (F.col("biggest") >= 0.7 * 2500)), "whole").otherwise("contour").alias("chosen"))


@query("""WITH p AS (SELECT event_id, value / 10 AS dur, 5.0 + event_id % 3 AS expected, event_id % 5 > 0 AS video, event_id % 7 > 0 AS audio FROM events)
SELECT event_id, CASE WHEN NOT video THEN 'no video stream' WHEN NOT audio THEN 'no audio stream' WHEN abs(dur - expected) > 2.0 THEN 'duration differs' ELSE '' END AS reason FROM p""")
def media_checks(spark, sf_dir):
    """Checks of probe results, the first that fails; probes come as JSON."""
    e = F.col("event_id")
    streams = F.filter(F.array(F.when(e % 5 > 0, "video"), F.when(e % 7 > 0, "audio")), lambda s: s.isNotNull())
    probe = F.to_json(F.struct((F.col("value") / 10).alias("duration"), F.transform(streams, lambda s: F.struct(s.alias("codec_type"))).alias("streams")))
    rows = V.table(spark, sf_dir, "events").select("event_id", F.from_json(probe, "duration double, streams array<struct<codec_type:string>>").alias("p"), (5.0 + e % 3).alias("expected"))
    has = lambda kind: F.exists("p.streams", lambda s: s["codec_type"] == kind)
    reason = F.when(~has("video"), "no video stream").when(~has("audio"), "no audio stream").when(F.abs(F.col("p.duration") - F.col("expected")) > 2.0, "duration differs").otherwise("")
    return rows.select("event_id", reason.alias("reason"))


FOLD = "f AS (SELECT job_id, ts, log_id, CASE WHEN log_id % 3 = 0 THEN stage END AS stage, CASE WHEN log_id % 4 = 1 THEN level END AS status, CASE WHEN log_id % 5 = 2 THEN log_id % 100 END AS progress FROM logs)"


@query(f"""WITH {V.LOGS}, {FOLD} SELECT job_id, arg_max(stage, (ts, log_id)) FILTER (stage IS NOT NULL) AS stage, arg_max(status, (ts, log_id)) FILTER (status IS NOT NULL) AS status, arg_max(progress, (ts, log_id)) FILTER (progress IS NOT NULL) AS progress, max(ts) AS last_at FROM f GROUP BY 1""")
def fold_events(spark, sf_dir):
    """Partial events as one row a job: of each field the last value that is there."""
    n = F.col("log_id")
    rows = V.logs(spark, sf_dir).select("job_id", "ts", "log_id", F.when(n % 3 == 0, F.col("stage")).alias("stage"), F.when(n % 4 == 1, F.col("level")).alias("status"), F.when(n % 5 == 2, n % 100).alias("progress"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "log_id"))).alias(c)
    return rows.groupBy("job_id").agg(last("stage"), last("status"), last("progress"), F.max("ts").alias("last_at"))


@query(f"WITH {V.LOGS} SELECT job_id, left(arg_max(message, (ts, log_id)), 500) AS message, count(*) AS n FROM logs GROUP BY 1")
def latest_message(spark, sf_dir):
    """Appended log rows, and the parent's message as the last of them."""
    return V.logs(spark, sf_dir).groupBy("job_id").agg(F.left(F.max_by("message", F.struct("ts", "log_id")), F.lit(500)).alias("message"), F.count("*").alias("n"))


@query(f"""WITH {V.LOGS}, b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, log_id DESC) AS back FROM logs WHERE ts < TIMESTAMP '2024-01-20'),
s AS (SELECT job_id, count(*) AS n FROM logs WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT job_id, 0 AS place, 'snapshot:' || n AS item FROM s UNION ALL SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY back DESC) AS INTEGER), stage FROM b WHERE back <= 5""")
def late_join_catchup(spark, sf_dir):
    """What a late subscriber gets: a snapshot, then the newest rows, oldest first."""
    rows = V.logs(spark, sf_dir).filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    head = rows.groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", F.lit(0).alias("place"), F.concat(F.lit("snapshot:"), F.col("n").cast("string")).alias("item"))
    return head.union(J.newest(rows, "job_id", [F.col("ts"), F.col("log_id")], 5).select("job_id", F.col("place").cast("int").alias("place"), F.col("stage").alias("item")))


@query(f"""WITH {V.JOBS} SELECT job_id, 'pending' AS status, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, job_id) AS place FROM jobs WHERE status IN ({", ".join(repr(s) for s in ACTIVE)})""")
def recovery_queue(spark, sf_dir):
    """After a restart: rows in flight are pending again, queued oldest first."""
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy("created_at", "job_id")).cast("bigint")
    return V.jobs(spark, sf_dir).filter(F.col("status").isin(*ACTIVE)).select("job_id", F.lit("pending").alias("status"), place.alias("place"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN event_type || ',b' WHEN 1 THEN event_type WHEN 2 THEN '' ELSE CAST(user_id AS VARCHAR) END AS texts, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS n FROM events")
def scalar_or_list(spark, sf_dir):
    """A field that is a list or one value, never split into characters."""
    k, kind = F.col("event_id"), F.col("event_type")
    body = F.when(k % 4 == 0, F.to_json(F.struct(F.array(kind, F.lit("b")).alias("t")))).when(k % 4 == 1, F.to_json(F.struct(kind.alias("t")))).when(k % 4 == 2, F.lit("{}")).otherwise(F.to_json(F.struct(F.col("user_id").alias("t"))))
    raw = V.table(spark, sf_dir, "events").select(k.alias("id"), body.alias("body"))
    v = F.try_parse_json("body")
    many, one = F.try_variant_get(v, "$.t", "array<string>"), F.try_variant_get(v, "$.t", "string")
    texts = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return raw.select("id", F.array_join(texts, ",").alias("texts"), F.size(texts).alias("n"))


@query(f"WITH {V.LOGS} SELECT level, count(*) AS n, max(log_id) AS last_id FROM logs GROUP BY 1")
def stream_lines(spark, sf_dir):
    """Log lines as a stream of text, framed into rows."""
    path = scratch(spark)
    V.logs(spark, sf_dir).select(F.concat_ws(" ", F.concat(F.lit("["), "level", F.lit("]")), F.col("log_id").cast("string"), "message")).write.text(f"{path}/lines")
    lines = spark.readStream.text(f"{path}/lines").select(F.regexp_extract("value", r"^\[(\w+)\] (\d+) ", 1).alias("level"), F.regexp_extract("value", r"^\[(\w+)\] (\d+) ", 2).cast("bigint").alias("log_id"))
    return S.run_to_table(lines.groupBy("level").agg(F.count("*").alias("n"), F.max("log_id").alias("last_id")), path, "complete")
