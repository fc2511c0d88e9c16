"""Queries: dashboard figures, distributions, gates and counters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.exprs import ACTIVE, content_key
from loomframe.operators import aggregates as A
from loomframe.plans.base import query
from loomframe.sources import adapters as V

ACTIVE_SQL = ", ".join(f"'{s}'" for s in ACTIVE)


@query(f"""WITH {V.JOBS} SELECT count(*) AS total_jobs, count(*) FILTER (status = 'done') AS done_jobs, count(*) FILTER (status IN ({ACTIVE_SQL})) AS active_jobs,
  CAST(coalesce(sum(total_chapters), 0) AS BIGINT) AS total_chapters, CAST(coalesce(sum(total_images) FILTER (status = 'done'), 0) AS BIGINT) AS done_images,
  CAST(coalesce(sum(total_chapters) FILTER (status = 'done'), 0) AS BIGINT) AS done_chapters FROM jobs""")
def kpi_stats(spark, sf_dir):
    return A.totals(V.jobs(spark, sf_dir))


@query(f"""WITH {V.JOBS}, b AS (SELECT CASE WHEN status IN ('done', 'error', 'cancelled') THEN status ELSE 'active' END AS bucket, count(*) AS n FROM jobs GROUP BY 1)
SELECT bucket, n, CAST(floor(100.0 * n / (SELECT sum(n) FROM b) + 0.5) AS BIGINT) AS pct FROM b""")
def kpi_status_distribution(spark, sf_dir):
    return A.status_shares(V.jobs(spark, sf_dir))


@query(f"""WITH {V.JOBS} SELECT round(coalesce(avg(date_diff('second', created_at, updated_at) / 60.0) FILTER (status = 'done'), 0.0), 4) AS avg_minutes,
  CAST(coalesce(floor(100.0 * count(*) FILTER (status = 'done') / nullif(count(*) FILTER (status NOT IN ({ACTIVE_SQL})), 0) + 0.5), 0) AS BIGINT) AS success_rate FROM jobs""")
def kpi_avg_minutes_success(spark, sf_dir):
    return A.success(V.jobs(spark, sf_dir))


@query(f"""WITH {V.JOBS} SELECT coalesce(nullif(voice, ''), 'default') AS voice, count(*) AS n FROM jobs WHERE status = 'done' GROUP BY 1 ORDER BY n DESC, max(created_at) DESC, voice LIMIT 1""")
def kpi_top_voice(spark, sf_dir):
    return A.top_voice(V.jobs(spark, sf_dir))


@query("""SELECT lang, min(doc_id) AS first_at, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def kpi_languages_first_seen(spark, sf_dir):
    return A.first_seen(V.table(spark, sf_dir, "documents"), "lang", "doc_id")


SOURCE_ROWS = ", ".join(f"('{s}')" for s in [*V.SOURCES, "none"])


@query(f"""WITH {V.CATALOG} SELECT d.source, count(c.source) AS n, count(c.source) > 0 AS active FROM (VALUES {SOURCE_ROWS}) d(source) LEFT JOIN catalog c ON c.source = d.source GROUP BY 1""")
def kpi_source_counts(spark, sf_dir):
    return A.counts_with_zeros(spark.createDataFrame([(s,) for s in [*V.SOURCES, "none"]], "source string"), V.catalog(spark, sf_dir), "source")


CELL_SQL = """CASE WHEN status = 'error' THEN 'error' WHEN status = 'done' OR rendered THEN 'rendered' WHEN status = 'rendering' THEN 'rendering'
  WHEN transcribed OR status = 'transcribed' THEN 'transcribed' WHEN status = 'transcribing' THEN 'transcribing' WHEN status = 'scraped' THEN 'scraped' WHEN status = 'scraping' THEN 'scraping' ELSE 'pending' END"""
CELL_ROWS = ", ".join(f"('{s}')" for s in A.CELL_STATES)


@query(f"""WITH {V.CHAPTERS}, c AS (SELECT {CELL_SQL} AS state FROM chapters)
SELECT d.state, count(c.state) AS n, count(c.state) > 0 AS active FROM (VALUES {CELL_ROWS}) d(state) LEFT JOIN c ON c.state = d.state GROUP BY 1""")
def legend_counts(spark, sf_dir):
    states = spark.createDataFrame([(s,) for s in A.CELL_STATES], "state string")
    return A.counts_with_zeros(states, V.chapters(spark, sf_dir).select(A.cell_state().alias("state")), "state")


STATS_SQL = """SELECT {keys}, count(*) AS n, CAST(coalesce(sum(regions), 0) AS BIGINT) AS regions, count(*) FILTER (status = 'FAILED') AS failures,
  count(*) FILTER (regions > 0 AND status <> 'SUCCESS') AS uncertain, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty FROM ocr GROUP BY {keys}"""


@query(f"WITH {V.OCR} {STATS_SQL.format(keys='lang')}")
def ocr_batch_stats(spark, sf_dir):
    return A.batch_stats(V.ocr(spark, sf_dir), "lang")


@query(f"""WITH {V.OCR}, s AS ({STATS_SQL.format(keys="chapter")}), f AS (SELECT *, CASE WHEN chapter % 9 = 0 THEN failures ELSE 0 END AS call_failures FROM s)
SELECT chapter, n, regions, uncertain, CASE WHEN call_failures > 0 THEN 'call_failed' WHEN n > 3 AND regions = 0 THEN 'never_fired'
  WHEN uncertain >= 4 AND uncertain / greatest(regions, uncertain) > 0.5 THEN 'low_confidence' ELSE 'keep' END AS verdict, empty / n > 0.8 AND n > 3 AS quiet FROM f""")
def ocr_gate(spark, sf_dir):
    stats = A.batch_stats(V.ocr(spark, sf_dir), "chapter").withColumn("call_failures", F.when(F.col("chapter") % 9 == 0, F.col("failures")).otherwise(0))
    return A.gate(stats).select("chapter", "n", "regions", "uncertain", "verdict", "quiet")


@query("""WITH s AS (SELECT user_id AS chapter, event_type <> 'view' AS spoken, value < 30 OR user_id % 17 = 0 AS failed FROM events),
a AS (SELECT chapter, count(*) FILTER (spoken) AS attempted, count(*) FILTER (spoken AND failed) AS failed FROM s GROUP BY 1)
SELECT chapter, attempted, failed, CASE WHEN attempted > 0 AND failed / attempted >= 0.9 THEN 'error' WHEN attempted > 0 AND failed / attempted > 0.2 THEN 'warn' ELSE 'ok' END AS tier FROM a""")
def tts_tiers(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("chapter"), (F.col("event_type") != "view").alias("spoken"), ((F.col("value") < 30) | (F.col("user_id") % 17 == 0)).alias("failed"))
    return A.failure_tiers(rows, "chapter")


@query(f"""WITH {V.OCR} SELECT chapter, coalesce(round_even(avg(conf) FILTER (conf > 0), 4), 0.0) AS confidence FROM ocr GROUP BY 1""")
def mean_confidence(spark, sf_dir):
    mean = F.bround(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), 4)
    return V.ocr(spark, sf_dir).groupBy("chapter").agg(F.coalesce(mean, F.lit(0.0)).alias("confidence"))


@query(f"""WITH {V.CHAPTERS}, p AS (SELECT job_id, part_id % 7 AS src, string_agg(idx, ',' ORDER BY idx) AS positions, min(idx) AS first_at FROM chapters GROUP BY 1, 2)
SELECT job_id, src, positions, first_at, row_number() OVER (PARTITION BY job_id ORDER BY first_at) AS place FROM p""")
def group_positions(spark, sf_dir):
    rows = V.chapters(spark, sf_dir).groupBy("job_id", (F.col("part_id") % 7).alias("src")).agg(F.sort_array(F.collect_list("idx")).alias("p"), F.min("idx").alias("first_at"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("first_at")).cast("bigint")
    return rows.select("job_id", "src", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("positions"), "first_at", place.alias("place"))


@query(f"""WITH {V.CHAPTERS}, d AS (SELECT job_id, idx, greatest(3.0, images / 8) AS dur, row_number() OVER (PARTITION BY job_id ORDER BY idx DESC) AS back FROM chapters),
s AS (SELECT job_id, sum(images) / 7.5 AS audio FROM chapters GROUP BY 1), t AS (SELECT job_id, sum(dur) AS total FROM d GROUP BY 1)
SELECT job_id, idx, round(dur + CASE WHEN back = 1 THEN greatest(0.0, audio - total) ELSE 0 END, 4) AS dur FROM d JOIN s USING (job_id) JOIN t USING (job_id)""")
def durations_shortfall(spark, sf_dir):
    own = Window.partitionBy("job_id")
    rows = V.chapters(spark, sf_dir).withColumn("dur", F.greatest(F.lit(3.0), F.col("images") / 8))
    last = F.row_number().over(own.orderBy(F.desc("idx"))) == 1
    short = F.greatest(F.lit(0.0), F.sum("images").over(own) / 7.5 - F.sum("dur").over(own))
    return rows.select("job_id", "idx", F.round(F.col("dur") + F.when(last, short).otherwise(0.0), 4).alias("dur"))


@query(f"WITH {V.BOXES} SELECT page, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM boxes GROUP BY 1")
def bbox_bounds(spark, sf_dir):
    corners = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("h")).alias("y")))
    polygons = V.boxes(spark, sf_dir, dealt=False).select("page", corners.alias("points"))
    each = polygons.select("page", *[f(F.col(f"points.{axis}")).alias(f"{axis}{i}") for f, i in ((F.array_min, 1), (F.array_max, 2)) for axis in ("x", "y")])
    return each.groupBy("page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@query(f"""WITH {V.SIGNAL} SELECT page, row // 24 AS day, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS dark, bool_or(n > 3) AS any_content,
  stddev_pop(n) < 0.9 OR (avg(n) > 2.5 AND stddev_pop(n) < 1.5) AS blank FROM signal GROUP BY 1, 2""")
def row_profile(spark, sf_dir):
    mean, std = F.avg("n"), F.stddev_pop("n")
    return V.signal(spark, sf_dir).groupBy("page", F.floor(F.col("row") / 24).alias("day")).agg(
        F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)), 6).alias("dark"),
        F.bool_or(F.col("n") > 3).alias("any_content"), ((std < 0.9) | ((mean > 2.5) & (std < 1.5))).alias("blank"),
    )


@query(f"""WITH {V.SIGNAL}, p AS (SELECT page, quantile_cont(mass, 0.2) AS p20, quantile_cont(mass, 0.25) AS p25, quantile_cont(mass, 0.35) AS p35 FROM signal GROUP BY 1)
SELECT page, round(least(greatest(p20, 1.0), 200.0), 4) AS p20, round(least(greatest(p25, 1.0), 200.0), 4) AS p25, round(least(greatest(p35, 1.0), 200.0), 4) AS p35 FROM p""")
def percentile_thresholds(spark, sf_dir):
    clamp = lambda p: F.round(F.least(F.greatest(F.percentile("mass", F.lit(p)), F.lit(1.0)), F.lit(200.0)), 4)
    return V.signal(spark, sf_dir).groupBy("page").agg(clamp(0.2).alias("p20"), clamp(0.25).alias("p25"), clamp(0.35).alias("p35"))


@query(f"""WITH {V.LOGS}, o AS (SELECT *, sum(CASE WHEN level IN ('warn', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, log_id) AS failures FROM logs)
SELECT job_id, CAST(max(failures) AS BIGINT) AS failures, min(ts) FILTER (failures >= 5) AS tripped_at, count(*) FILTER (failures >= 5) AS after_trip FROM o GROUP BY 1""")
def breaker_trip(spark, sf_dir):
    """Running failures per provider; both kinds raise one counter, which trips at 5."""
    from loomframe.operators.state import running_failures

    rows = running_failures(V.logs(spark, sf_dir), "job_id", ["ts", "log_id"], F.col("level").isin("warn", "error"))
    return rows.groupBy("job_id").agg(
        F.max("failures").alias("failures"), F.min(F.when(F.col("failures") >= 5, F.col("ts"))).alias("tripped_at"), F.count_if(F.col("failures") >= 5).alias("after_trip")
    )


@query(f"WITH {V.JOBS} SELECT customer_id, bool_or(status IN ('done', 'error')) AS unread, CAST(sum(total_chapters) AS BIGINT) AS pages FROM jobs GROUP BY 1")
def unread_flags(spark, sf_dir):
    return V.jobs(spark, sf_dir).groupBy("customer_id").agg(F.bool_or(F.col("status").isin("done", "error")).alias("unread"), F.sum("total_chapters").cast("bigint").alias("pages"))


@query(f"""WITH {V.CHAPTERS}, s AS (SELECT job_id, count(*) AS total, count(*) FILTER (status <> 'error') AS produced FROM chapters GROUP BY 1)
SELECT job_id, total, produced, total - produced AS dropped, CASE WHEN produced = 0 THEN 'FAILED' WHEN total > produced THEN 'UNCERTAIN' ELSE 'COMPLETE' END AS state FROM s""")
def final_states(spark, sf_dir):
    work = V.chapters(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "error").alias("produced"))
    return A.final_state(work)


@query(f"""WITH {V.BOXES}, k AS (SELECT page, CASE WHEN greatest(w / h, h / w) > 6 THEN 'line' WHEN w * h < 300 THEN 'text' ELSE 'art' END AS kind FROM boxes)
SELECT page, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'art') AS arts, count(*) FILTER (kind = 'line') AS lines,
  count(*) FILTER (kind = 'text') >= 2 AND count(*) FILTER (kind = 'art') >= 1 AND count(*) FILTER (kind = 'line') >= 1 AS busy FROM k GROUP BY 1""")
def component_classes(spark, sf_dir):
    aspect = F.greatest(F.col("w").cast("double") / F.col("h"), F.col("h").cast("double") / F.col("w"))
    kind = F.when(aspect > 6, "line").when(F.col("w") * F.col("h") < 300, "text").otherwise("art")
    counts = V.boxes(spark, sf_dir, dealt=False).select("page", kind.alias("kind")).groupBy("page").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("text", "art", "line")])
    return counts.withColumn("busy", (F.col("texts") >= 2) & (F.col("arts") >= 1) & (F.col("lines") >= 1))


@query("SELECT doc_id, sha256(text) AS digest, left(sha256('v2:' || source || '/' || doc_id), 16) AS cache_key FROM documents")
def digests(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("digest"), content_key("v2", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("cache_key"))
