"""Dashboard figures and quality gates over job, chapter, page and segment relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.exprs import ACTIVE, js_round
from loomframe.operators.places import numbered

#: Tests of a chapter cell, in order; the last is the default.
CELL_STATES = ["error", "rendered", "rendering", "transcribed", "transcribing", "scraped", "scraping", "pending"]


def totals(jobs: DataFrame) -> DataFrame:
    """All counts and sums of the dashboard in one pass; sums over nothing are 0."""
    done = F.col("status") == "done"
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(done).alias("done_jobs"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active_jobs"),
        F.coalesce(F.sum("total_chapters"), F.lit(0)).cast("bigint").alias("total_chapters"),
        F.coalesce(F.sum(F.when(done, F.col("total_images"))), F.lit(0)).cast("bigint").alias("done_images"),
        F.coalesce(F.sum(F.when(done, F.col("total_chapters"))), F.lit(0)).cast("bigint").alias("done_chapters"),
    )


def status_shares(jobs: DataFrame) -> DataFrame:
    """Jobs in four buckets with the rounded percentage of each."""
    bucket = F.when(F.col("status").isin("done", "error", "cancelled"), F.col("status")).otherwise("active")
    counts = jobs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over four rows at most
    return counts.select("bucket", "n", js_round(F.try_divide(100.0 * F.col("n"), total)).cast("bigint").alias("pct"))


def success(jobs: DataFrame) -> DataFrame:
    """Mean minutes of done jobs, and the rounded success rate over jobs that are not active; 0 where there are none."""
    done = F.col("status") == "done"
    minutes = F.timestamp_diff("SECOND", F.col("created_at"), F.col("updated_at")) / 60.0
    resting = F.count_if(~F.col("status").isin(*ACTIVE))
    return jobs.agg(
        F.round(F.coalesce(F.avg(F.when(done, minutes)), F.lit(0.0)), 4).alias("avg_minutes"),
        F.coalesce(js_round(F.try_divide(100.0 * F.count_if(done), resting)), F.lit(0)).cast("bigint").alias("success_rate"),
    )


def top_voice(jobs: DataFrame) -> DataFrame:
    """Voice of most done jobs; of equals the one whose newest job is newest, then by name."""
    counts = jobs.filter("status = 'done'").groupBy(F.coalesce(F.when(F.col("voice") != "", F.col("voice")), F.lit("default")).alias("voice"))
    counts = counts.agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))
    return counts.orderBy(F.desc("n"), F.desc("newest"), "voice").limit(1).select("voice", "n")


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Different values in the order of their first rows (ties: of the values)."""
    seen = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first_at"))
    return numbered(seen, [F.col("first_at"), F.col(value)])


def counts_with_zeros(dimension: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows per member of a small dimension, zeros kept, with a flag for those above zero."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("active"))


def cell_state() -> Column:
    """Display state of a chapter: the first test that holds."""
    s = F.col("status")
    return (
        F.when(s == "error", "error").when((s == "done") | F.col("rendered"), "rendered").when(s == "rendering", "rendering")
        .when(F.col("transcribed") | (s == "transcribed"), "transcribed").when(s == "transcribing", "transcribing")
        .when(s == "scraped", "scraped").when(s == "scraping", "scraping").otherwise("pending")
    )


def batch_stats(pages: DataFrame, *keys: str) -> DataFrame:
    """Recognition figures by group: regions, failures, uncertain pages that have regions, empty texts."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("regions"), F.lit(0)).cast("bigint").alias("regions"),
        F.count_if(F.col("status") == "FAILED").alias("failures"),
        F.count_if((F.col("regions") > 0) & (F.col("status") != "SUCCESS")).alias("uncertain"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
    )


def gate(stats: DataFrame) -> DataFrame:
    """First rule that sends a group to the fallback, or keep; quiet groups are only marked.

    stats: n, regions, call_failures, uncertain, empty.
    """
    share = F.try_divide(F.col("uncertain").cast("double"), F.greatest("regions", "uncertain"))
    verdict = (
        F.when(F.col("call_failures") > 0, "call_failed").when((F.col("n") > 3) & (F.col("regions") == 0), "never_fired")
        .when((F.col("uncertain") >= 4) & (F.coalesce(share, F.lit(0.0)) > 0.5), "low_confidence").otherwise("keep")
    )
    quiet = (F.try_divide(F.col("empty").cast("double"), F.col("n")) > 0.8) & (F.col("n") > 3)
    return stats.withColumns({"verdict": verdict, "quiet": F.coalesce(quiet, F.lit(False))})


def failure_tiers(segments: DataFrame, *keys: str) -> DataFrame:
    """Share of failed segments among those with something to say: error from 0.9, warn above 0.2.

    segments: spoken, failed (boolean).
    """
    share = F.try_divide(F.count_if(F.col("spoken") & F.col("failed")).cast("double"), F.count_if("spoken"))
    out = segments.groupBy(*keys).agg(F.count_if("spoken").alias("attempted"), F.count_if(F.col("spoken") & F.col("failed")).alias("failed"), share.alias("share"))
    tier = F.when(F.col("share") >= 0.9, "error").when(F.col("share") > 0.2, "warn").otherwise("ok")
    return out.select(*keys, "attempted", "failed", tier.alias("tier"))


def final_state(work: DataFrame) -> DataFrame:
    """State of finished work from the numbers of units planned and produced.

    work: total, produced. Nothing produced is FAILED, something dropped is UNCERTAIN, else COMPLETE.
    """
    dropped = F.col("total") - F.col("produced")
    state = F.when(F.col("produced") == 0, "FAILED").when(dropped > 0, "UNCERTAIN").otherwise("COMPLETE")
    return work.withColumns({"dropped": dropped, "state": state})


def reply_slots(items: DataFrame, expected: str = "expected") -> DataFrame:
    """Texts by slot: 1-based indexes move down by one and 0 stays, so 0 and 1 share a slot; out of range, or none, takes the
    place in the array; the later item wins.

    items: reply, place (0-based), index, text, expected.
    """
    slot = F.when(F.col("index") >= 1, F.col("index") - 1).otherwise(F.col("index"))
    slot = F.when(slot.isNotNull() & (slot >= 0) & (slot < F.col(expected)), slot).otherwise(F.col("place"))
    rows = items.withColumn("slot", slot.cast("bigint")).filter(F.col("slot") < F.col(expected))
    return rows.groupBy("reply", "slot").agg(F.max_by(F.coalesce("text", F.lit("")), "place").alias("text"))
