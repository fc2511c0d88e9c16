"""Queries: joins, precedence, set operations, cascades and conditional changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.exprs import title_key
from loomframe.functions.exprs import ACTIVE
from loomframe.operators import joins as J
from loomframe.operators import state as T
from loomframe.plans.base import query
from loomframe.plans.extraction import scratch
from loomframe.plans.sequences import STATE_SQL, changes
from loomframe.sources import adapters as V
from loomframe.sources.files import json_list
from loomframe.sources.tables import StoredTable

W = Window


@query(f"""WITH {V.JOBS}, {V.CHAPTERS} SELECT j.job_id, j.status, coalesce(string_agg(c.idx || '=' || c.status, ',' ORDER BY c.idx), '') AS chapters FROM jobs j LEFT JOIN chapters c ON c.job_id = j.job_id GROUP BY 1, 2""")
def job_chapters_nested(spark, sf_dir):
    """Jobs with their ordered chapters."""
    c = V.chapters(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("idx", "status"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["idx"].cast("string"), x["status"])), ",")
    return V.jobs(spark, sf_dir).join(c, "job_id", "left").select("job_id", "status", F.coalesce(text, F.lit("")).alias("chapters"))


@query(f"""WITH {V.LOGS}, u AS (SELECT c_custkey AS job_id, c_mktsegment AS segment FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, log_id DESC) AS k FROM logs)
SELECT u.job_id, segment, log_id, level, k FROM u LEFT JOIN r ON r.job_id = u.job_id AND k <= 5""")
def job_children_topk(spark, sf_dir):
    """Parents with their newest children."""
    k = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("log_id"))).cast("bigint")
    top = V.logs(spark, sf_dir).withColumn("k", k).filter("k <= 5").select("job_id", "log_id", "level", "k")
    users = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("segment"))
    return users.join(top, "job_id", "left")


@query("SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, '') AS narration FROM documents d LEFT JOIN labels l USING (doc_id)")
def narration_lookup(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("t"))
    return V.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", F.coalesce("t", F.lit("")).alias("narration"))


@query(f"""WITH {V.CHAPTERS}, p AS (SELECT p_partkey AS part_id, p_name AS narration FROM part WHERE p_partkey % 3 <> 0),
f AS (SELECT job_id, idx, part_id, supp_id % 5 AS src FROM chapters) SELECT f.job_id, src, string_agg(idx, ',' ORDER BY idx) AS frames, min(idx) AS first_at, coalesce(arg_min(narration, idx), '') AS narration FROM f LEFT JOIN p USING (part_id) GROUP BY 1, 2""")
def frame_narration(spark, sf_dir):
    """Frames to source pages to narrations."""
    pages = V.table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("narration"))
    rows = V.chapters(spark, sf_dir).select("job_id", "idx", "part_id", (F.col("supp_id") % 5).alias("src")).join(pages, "part_id", "left")
    frames = F.array_join(F.transform(F.sort_array(F.collect_list("idx")), lambda x: x.cast("string")), ",")
    first_text = F.min_by("narration", F.when(F.col("narration").isNotNull(), F.col("idx")))
    return rows.groupBy("job_id", "src").agg(frames.alias("frames"), F.min("idx").alias("first_at"), F.coalesce(first_text, F.lit("")).alias("narration"))


@query(f"WITH {V.CHAPTERS} SELECT job_id, idx, images FROM chapters WHERE part_id IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def selected_semi(spark, sf_dir):
    chosen = V.table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("part_id"))
    return V.chapters(spark, sf_dir).join(chosen, "part_id", "left_semi").select("job_id", "idx", "images")


@query(f"WITH {V.LOGS} SELECT log_id, job_id FROM logs WHERE job_id NOT IN (SELECT s_suppkey FROM supplier)")
def unseen_anti(spark, sf_dir):
    seen = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job_id"))
    return V.logs(spark, sf_dir).join(seen, "job_id", "left_anti").select("log_id", "job_id")


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN nullif('', '') ELSE c_mktsegment END, nullif(CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END, ''), '') AS value FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def settings_precedence(spark, sf_dir):
    """Own value, else the global one, else empty."""
    nations = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("global"))
    own = F.when(F.col("c_custkey") % 3 == 1, "").when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment"))
    return V.table(spark, sf_dir, "customer").join(F.broadcast(nations), "c_nationkey", "left").select(F.col("c_custkey").alias("id"), J.precedence(own, F.col("global")).alias("value"))


BATCH_SQL = "b AS (SELECT *, (row_number() OVER w - 1) // 20 AS batch, (row_number() OVER w - 1) % 20 AS local FROM logs WHERE log_id % 3 <> 0 WINDOW w AS (ORDER BY log_id))"


@query(f"WITH {V.LOGS} SELECT log_id, CASE WHEN log_id % 3 = 0 THEN 'cached' ELSE 'fresh:' || level END AS result FROM logs")
def batch_positions(spark, sf_dir):
    """Results of the uncached rows, made in batches, back at the rows' places."""
    rows = V.logs(spark, sf_dir).select("log_id", "job_id", "level")
    misses = rows.filter("log_id % 3 <> 0")
    at = F.row_number().over(W.partitionBy("job_id").orderBy("log_id")).cast("bigint") - 1
    misses = misses.select("log_id", "job_id", "level", F.floor(at / 20).alias("batch"), (at % 20).alias("local"))
    results = misses.select("job_id", "batch", "local", F.concat(F.lit("fresh:"), "level").alias("text"))
    back = misses.join(results, ["job_id", "batch", "local"]).select("log_id", "text")
    return rows.join(back, "log_id", "left").select("log_id", F.coalesce("text", F.lit("cached")).alias("result"))


@query(f"""WITH {V.LOGS}, c AS (SELECT job_id, stage, max(ts) AS at, count(*) % 3 > 0 AS ok FROM logs WHERE level = 'success' GROUP BY 1, 2)
SELECT l.log_id, c.at IS NOT NULL AND c.ok AND date_diff('microsecond', c.at, TIMESTAMP '2024-01-31') // 1000000 <= 604800 AS hit FROM logs l LEFT JOIN c USING (job_id, stage)""")
def cache_split(spark, sf_dir):
    """Cache hits: an entry that succeeded and is young enough."""
    rows = V.logs(spark, sf_dir)
    entries = rows.filter("level = 'success'").groupBy("job_id", "stage").agg(F.max("ts").alias("at"), (F.count("*") % 3 > 0).alias("ok"))
    age = F.timestamp_diff("SECOND", F.col("at"), F.lit("2024-01-31").cast("timestamp"))
    return rows.join(entries, ["job_id", "stage"], "left").select("log_id", F.coalesce(F.col("ok") & (age <= 604800), F.lit(False)).alias("hit"))


@query(f"""WITH {V.LOGS}, {STATE_SQL}, s AS (SELECT job_id, stage, arg_max(state, (ts, log_id)) AS state, CASE WHEN job_id % 5 = 0 THEN '' ELSE 'd' || job_id % 7 END AS checksum FROM states GROUP BY 1, 2),
a AS (SELECT DISTINCT job_id, stage, 'd' || job_id % 9 AS digest, job_id % 11 <> 0 AS qa_ok FROM logs WHERE job_id % 4 <> 1)
SELECT s.job_id, s.stage, state, CASE WHEN digest IS NULL THEN CASE WHEN state = 'COMPLETE' THEN 'RETRYABLE' ELSE state END WHEN NOT qa_ok THEN 'RETRYABLE' WHEN checksum <> '' AND checksum <> digest THEN state ELSE 'COMPLETE' END AS next_state,
CASE WHEN digest IS NULL AND state = 'COMPLETE' THEN 'MISSING_ARTIFACT' WHEN digest IS NOT NULL AND NOT qa_ok THEN 'QA_FAILED' END AS error_code,
coalesce(digest IS NOT NULL AND qa_ok AND NOT (checksum <> '' AND checksum <> digest), false) AS reconciled, digest IS NOT NULL AND NOT coalesce(qa_ok, false) AS quarantined FROM s LEFT JOIN a USING (job_id, stage)""")
def reconcile(spark, sf_dir):
    """State rows against their artifacts."""
    states = T.latest(changes(spark, sf_dir), ["job_id", "stage"], ["ts", "log_id"]).select("job_id", "stage", "state", F.when(F.col("job_id") % 5 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("job_id") % 7).cast("string"))).alias("checksum"))
    made = V.logs(spark, sf_dir).filter("job_id % 4 <> 1").select("job_id", "stage", F.concat(F.lit("d"), (F.col("job_id") % 9).cast("string")).alias("digest"), (F.col("job_id") % 11 != 0).alias("qa_ok")).distinct()
    return T.reconcile(states, made, ["job_id", "stage"])


@query(f"WITH {V.CHAPTERS} SELECT job_id, idx FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = c.job_id AND o_orderstatus = 'F') AND status <> 'done'")
def resume_anti(spark, sf_dir):
    """What is left to do: chapters of jobs that are not complete."""
    done = V.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    return V.chapters(spark, sf_dir).filter("status <> 'done'").join(done, "job_id", "left_anti").select("job_id", "idx")


@query(f"""WITH {V.BOXES}, p AS (SELECT page, box, (y + h + lead(y) OVER (PARTITION BY page ORDER BY y, box)) // 2 AS mid FROM boxes)
SELECT p.page, p.box, mid, EXISTS (SELECT 1 FROM boxes b WHERE b.page = p.page AND b.box <> p.box AND b.y <= mid AND mid < b.y + b.h) AS crossed FROM p WHERE mid IS NOT NULL""")
def midpoint_exists(spark, sf_dir):
    """Whether the middle between neighbours lies in another box of the page."""
    rows = V.boxes(spark, sf_dir)
    following = F.lead("y").over(W.partitionBy("page").orderBy("y", "box"))
    mids = rows.select("page", "box", F.floor((F.col("y") + F.col("h") + following) / 2).alias("mid")).filter("mid is not null")
    other = rows.select(F.col("page").alias("p"), F.col("box").alias("b"), "y", "h")
    hit = mids.join(other, (mids["page"] == other["p"]) & (mids["box"] != other["b"]) & (F.col("y") <= F.col("mid")) & (F.col("mid") < F.col("y") + F.col("h")), "left_semi").select("page", "box", F.lit(True).alias("crossed"))
    return mids.join(hit, ["page", "box"], "left").select("page", "box", "mid", F.coalesce("crossed", F.lit(False)).alias("crossed"))


KEY_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {V.CATALOG}, t AS (SELECT {KEY_SQL.format("title")} AS k, min(arrival) AS found FROM catalog WHERE source = 'mh' GROUP BY 1)
SELECT c.arrival, t.found FROM catalog c LEFT JOIN t ON {KEY_SQL.format("c.title")} = t.k WHERE c.source IN ('md', 'al')""")
def title_resolution(spark, sf_dir):
    """Titles of one source found on another, the first hit of each."""
    rows = V.catalog(spark, sf_dir).withColumn("k", title_key(F.col("title")))
    found = rows.filter("source = 'mh'").groupBy("k").agg(F.min("arrival").alias("found"))
    return rows.filter("source in ('md', 'al')").join(found, "k", "left").select("arrival", "found")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE upper(lang) END AS label FROM documents")
def dimension_lookup(spark, sf_dir):
    """Labels of a small dimension, the upper-case code where there is none."""
    names = spark.createDataFrame([("en", "English"), ("fr", "French")], "lang string, name string")
    return V.table(spark, sf_dir, "documents").join(F.broadcast(names), "lang", "left").select("doc_id", F.coalesce("name", F.upper("lang")).alias("label"))


@query(f"""WITH {V.CHAPTERS}, {V.LOGS}, u AS (SELECT job_id, log_id % 7 + 1 AS idx, arg_max(stage, log_id) AS status FROM logs GROUP BY 1, 2)
SELECT c.job_id, c.idx, coalesce(u.status, c.status) AS status FROM chapters c LEFT JOIN u ON u.job_id = c.job_id AND u.idx = c.idx""")
def merge_updates(spark, sf_dir):
    """Latest change of each child over its stored row."""
    updates = T.latest(V.logs(spark, sf_dir).select("job_id", (F.col("log_id") % 7 + 1).alias("idx"), F.col("stage").alias("new"), "log_id"), ["job_id", "idx"], ["log_id"])
    return V.chapters(spark, sf_dir).join(updates, ["job_id", "idx"], "left").select("job_id", "idx", F.coalesce("new", "status").alias("status"))


@query(f"WITH {V.LOGS} SELECT job_id, stage, count(*) % 2 = 1 AS marked FROM logs WHERE level <> 'info' GROUP BY 1, 2")
def toggle_parity(spark, sf_dir):
    """A toggled mark is set after an odd number of toggles."""
    return V.logs(spark, sf_dir).filter("level <> 'info'").groupBy("job_id", "stage").agg((F.count("*") % 2 == 1).alias("marked"))


@query(f"""WITH {V.LOGS}, a AS (SELECT job_id, list_sort(list_distinct(list(level))) AS l FROM logs GROUP BY 1) SELECT job_id, coalesce(array_to_string([x FOR x IN l IF x NOT IN ('info', 'warn')], ','), '') AS available FROM a""")
def provider_available(spark, sf_dir):
    """Active members without the disabled and the excluded."""
    own = V.logs(spark, sf_dir).groupBy("job_id").agg(F.sort_array(F.collect_set("level")).alias("l"))
    return own.select("job_id", F.array_join(F.array_except("l", F.array(F.lit("info"), F.lit("warn"))), ",").alias("available"))


@query(f"WITH {V.JOBS} SELECT 'jobs' AS kind, count(*) AS n FROM jobs WHERE status <> 'error' UNION ALL SELECT 'chapters', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT job_id FROM jobs WHERE status = 'error')")
def delete_cascade(spark, sf_dir):
    """Rows left after jobs are deleted with their children."""
    gone = V.jobs(spark, sf_dir).filter("status = 'error'").select("job_id")
    left = lambda rows, kind: rows.join(gone, "job_id", "left_anti").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return left(V.jobs(spark, sf_dir), "jobs").union(left(V.chapters(spark, sf_dir), "chapters"))


@query(f"WITH {V.JOBS} SELECT job_id, CASE WHEN job_id % 2 = 0 AND status IN ('pending', 'scraping', 'transcribing', 'rendering') THEN 'cancelled' WHEN job_id % 2 = 1 AND status IN ('error', 'cancelled', 'done') THEN 'pending' ELSE status END AS status FROM jobs")
def conditional_update(spark, sf_dir):
    """Cancel and retry requests take effect only from the states that allow them."""
    from loomframe.functions.exprs import ACTIVE, RETRYABLE

    even, s = F.col("job_id") % 2 == 0, F.col("status")
    new = F.when(even & s.isin(*ACTIVE), "cancelled").when(~even & s.isin(*RETRYABLE), "pending").otherwise(s)
    return V.jobs(spark, sf_dir).select("job_id", new.alias("status"))


@query("SELECT coalesce(n.id, o.id) AS id, coalesce(n.value, o.value) AS value FROM (SELECT c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey AS id, 'new' AS value FROM customer WHERE c_custkey % 3 = 0) n ON n.id = o.id")
def settings_upsert(spark, sf_dir):
    """Old rows without the changed ones, and the changed ones."""
    rows = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    new = rows.filter("id % 3 = 0").select("id", F.lit("new").alias("value"))
    return rows.filter("id % 2 = 0").join(new, "id", "left_anti").union(new)


@query("SELECT coalesce(n.id, o.id) AS id, coalesce(n.value, o.value) AS value FROM (SELECT c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey AS id, 'new' AS value FROM customer WHERE c_custkey % 3 = 0) n ON n.id = o.id")
def settings_stored(spark, sf_dir):
    """A stored table, seeded once and upserted: the second seed finds rows and does nothing."""
    rows = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    table = StoredTable(spark, scratch(spark), rows.schema, "id")
    table.seed(rows.filter("id % 2 = 0"))
    table.seed(rows)
    table.upsert(rows.filter("id % 3 = 0").select("id", F.lit("new").alias("value")))
    return table.rows()


@query(f"WITH {V.JOBS} SELECT job_id, CASE WHEN status IN ({', '.join(repr(s) for s in ACTIVE)}) AND job_id % 3 = 0 THEN 'cancelled' ELSE status END AS status, CASE WHEN status IN ({', '.join(repr(s) for s in ACTIVE)}) AND job_id % 3 = 0 THEN 0 ELSE total_images END AS total_images FROM jobs")
def bulk_update_stored(spark, sf_dir):
    """Stored rows changed by a predicate."""
    jobs = V.jobs(spark, sf_dir).select("job_id", "status", "total_images")
    table = StoredTable(spark, scratch(spark), jobs.schema, "job_id")
    table.seed(jobs)
    table.update(F.col("status").isin(*ACTIVE) & (F.col("job_id") % 3 == 0), status=F.lit("cancelled"), total_images=F.lit(0).cast("bigint"))
    return table.rows()


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ',b' WHEN 1 THEN event_type ELSE '' END AS items, CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n FROM events")
def stored_lists(spark, sf_dir):
    """Lists kept as JSON text: empty where the text is missing, malformed, or no list."""
    k, kind = F.col("event_id") % 5, F.col("event_type")
    text = F.when(k == 0, F.to_json(F.array(kind, F.lit("b")))).when(k == 1, F.to_json(F.array(kind))).when(k == 2, F.lit('["cut')).when(k == 3, F.col("props"))
    items = json_list(text, "string")
    return V.table(spark, sf_dir, "events").select("event_id", F.array_join(items, ",").alias("items"), F.size(items).alias("n"))


@query(f"WITH {V.JOBS}, {V.CHAPTERS} SELECT job_id FROM jobs WHERE status = 'done' INTERSECT SELECT job_id FROM chapters WHERE rendered")
def finished_and_rendered(spark, sf_dir):
    """Jobs in both of two sets."""
    return V.jobs(spark, sf_dir).filter("status = 'done'").select("job_id").intersect(V.chapters(spark, sf_dir).filter("rendered").select("job_id"))
