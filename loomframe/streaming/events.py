"""Structured Streaming over the event log: counts, duplicates, attempts, joins of streams, and runs that a restart takes up."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from loomframe.streaming import state
from loomframe.streaming.state import LATE


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The event table as a stream of files, with ts as an instant."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events, value and last time by key and stage so far."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events by hour and stage; an hour ends when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def unpolled(pushed: DataFrame, polled: DataFrame, within: str, late: str = LATE) -> DataFrame:
    """(event_id, pushed_at, polled_at): each event pushed, with the time a poll brought it too, if one did within so long; else null.

    pushed (event_id, pushed_at) and polled (event_id, polled_at) are streams. A row is held until the watermark, the smaller of both
    streams', is so far past it that no poll can bring it any more.
    """
    left = pushed.withWatermark("pushed_at", late)
    right = polled.select(F.col("event_id").alias("polled_id"), "polled_at").withWatermark("polled_at", late)
    met = (F.col("event_id") == F.col("polled_id")) & F.expr(f"polled_at >= pushed_at AND polled_at <= pushed_at + INTERVAL {within}")
    return left.join(right, met, "left_outer").select("event_id", "pushed_at", "polled_at")


def caught_up(subscribers: DataFrame, snapshot: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """A stream of subscribers, each with the snapshot of its key and the newest rows, oldest first (null and empty where there are none).

    snapshot has a row a key; newest (key, place, ...) the rows that a top-k by key has bounded. Both are read again for each batch.
    """
    rest = [c for c in newest.columns if c not in (key, "place")]
    lists = newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("rows"))
    return subscribers.join(snapshot, key, "left").join(lists, key, "left").withColumn("rows", F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)))


class Stopped(Exception):
    """Raised on purpose, after a batch is written and before it counts as done."""


def run_to_table(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None, confs: dict[str, str] | None = None, die_after: int | None = None) -> DataFrame:
    """All that is there now, through to a table below path. Called again with the same path, it goes on from the checkpoint.

    Append mode without die_after goes to Spark's file sink. Otherwise each batch is a folder of its own, named by its number and
    replaced as a whole, so a batch that is run again after a failure is not stored twice. Complete mode gives the last batch; update mode the
    last row of each of the keys. die_after: the run fails behind the write of that batch, as if the driver had died there.
    """
    spark, checkpoint, out = stream.sparkSession, f"{path}/checkpoint", f"{path}/out"
    schema = stream.schema

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if mode == "complete":  # the batch before is kept until this one counts as done
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={n - 2}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if die_after is not None and n >= die_after:
            raise Stopped(f"behind the write of batch {n}")

    with state.settings(spark, {**state.ROCKS, **(confs or {})}):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.format("parquet").option("path", out).start() if mode == "append" and die_after is None and keys is None else writer.foreachBatch(step).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if die_after is None:
                raise
    if mode == "append" and die_after is None and keys is None:
        return spark.read.parquet(out)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(out)
    if mode == "complete":
        return rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    if mode == "append" or not keys:
        return rows.drop("batch")
    rest = [c for c in schema.names if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def by_batches(rows: DataFrame, path: str, order: str, files: int) -> str:
    """rows as that many files or so, dealt out by ranges of the order column, as a folder that a stream reads a few at a time."""
    rows.repartitionByRange(files, order).write.mode("overwrite").parquet(path)
    return path


def fresh(path: str) -> str:
    return f"{path}/stream-{uuid.uuid4().hex}"
