"""Keyed state on Spark's state store: stuck episodes, breakers, failover among providers.

State is kept by key in RocksDB and goes into the checkpoint with each batch, so a query that is stopped, or dies, goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATE = "2 days"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with some settings, put back afterwards; a streaming query keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def instant(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


class StuckEpisodes(StatefulProcessor):
    """One alert for each episode of a quiet state that lasts as long as the limit, at the time it does, whether or not a row follows.

    Rows wait until the watermark has passed them and are then taken in order of time and id, so the order of files and batches
    does not matter within the watermark. What waits is a key's rows of the watermark's delay.
    """

    def __init__(self, seconds: int):
        self.limit = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, quiet boolean")
        self.episode = handle.getValueState("episode", "since long, id long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted((r.us, r.id, r.quiet) for r in rows)
        self.waiting.appendList(new)
        self.handle.registerTimer(new[0][0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        since, first, told = self.episode.get() if self.episode.exists() else (None, None, False)
        for us, id_, quiet in [*due, (now, None, None)]:
            if since is not None and not told and us - since >= self.limit:
                told = True
                yield Row(key=key[0], id=first, since=instant(since), alert_at=instant(since + self.limit))
            if quiet is False:
                since, first, told = None, None, False
            elif quiet and since is None:
                since, first, told = us, id_, False
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if since is None:
            self.episode.clear()
        else:
            self.episode.update((since, first, told))
        # Wakes up for the next row that waits, or for the alert, whichever is due first.
        wake = [r[0] // 1000 + 1 for r in later[:1]] + ([(since + self.limit) // 1000 + 1] if since is not None and not told else [])
        if wake:
            self.handle.registerTimer(max(min(wake), now // 1000 + 1))


def stuck_episodes(events: DataFrame, key: str, id_col: str, quiet: Column, seconds: int, late: str = LATE) -> DataFrame:
    """(key, id, since, alert_at) of each episode of rows for which quiet holds that lasts seconds or longer; id is that of its first row.

    Rows with a null key or time are left out; a null quiet ends an episode. Rows of one time are taken in order of id.
    Episodes are judged as far as the watermark has come: late behind the newest time.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col(id_col).alias("id"), F.coalesce(quiet, F.lit(False)).alias("quiet"))
    return rows.groupBy("key").transformWithState(StuckEpisodes(seconds), "key long, id long, since timestamp, alert_at timestamp", "Append", "EventTime")


class Breakers(StatefulProcessor):
    """Failures of each key, the time at which they reached the limit, and the rows from then on.

    A batch's rows of a key are in order of time and id, rows of later batches come after them. A key that has tripped only counts;
    one that has not holds its rows of the batch, which the source's limits by trigger bound.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures long, tripped_us long, after_trip long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        failures, tripped, after = self.state.get() if self.state.exists() else (0, None, 0)
        for us, _, failed in ((r.us, None, r.failed) for r in rows) if tripped is not None else sorted((r.us, r.id, r.failed) for r in rows):
            failures += failed
            if tripped is None and failures >= self.limit:
                tripped = us
            after += tripped is not None
        self.state.update((failures, tripped, after))
        yield Row(key=key[0], failures=failures, tripped_at=None if tripped is None else instant(tripped), after_trip=after)


def breakers(events: DataFrame, key: str, id_col: str, failed: Column, limit: int = 5) -> DataFrame:
    """(key, failures, tripped_at, after_trip) of each key that a batch has rows of, for a sink in update mode. A null failed is no failure."""
    rows = events.select(F.col(key).alias("key"), F.unix_micros("ts").alias("us"), F.col(id_col).alias("id"), F.coalesce(failed, F.lit(False)).alias("failed"))
    return rows.groupBy("key").transformWithState(Breakers(limit), "key long, failures long, tripped_at timestamp, after_trip long", "Update", "None")


class Failover(StatefulProcessor):
    """Which provider took each failed call of a key, and what the failure changed.

    The primary stays until it is disabled or left: by its errors of either kind, one count for both. A limited call (too many
    requests, forbidden) disables a provider whose count has reached `disable`; any other error makes the key leave a provider whose count has reached
    `switch` for the next one that is available, if there is one. The next primary is the first available one in order of priority. With all
    disabled, a call goes to none and counts for nothing.
    """

    def __init__(self, providers: list[str], disable: int, switch: int):
        self.providers, self.disable, self.switch = providers, disable, switch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("calls", "errors string, disabled string, primary int, left int")

    def pick(self, active: list[str], disabled: set[int], primary: int | None, left: int | None) -> int | None:
        there = [i for i, p in enumerate(self.providers) if p in active and i not in disabled]
        there = [i for i in there if i != left] or there
        return primary if primary in there else min(there, default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        errors, disabled, primary, left = [0] * len(self.providers), set(), None, None
        if self.state.exists():
            counts, off, primary, left = self.state.get()
            errors, disabled = list(map(int, counts.split(","))), {int(i) for i in off.split(",") if i}
        for _, id_, limited, active in sorted((r.us, r.id, r.limited, r.active) for r in rows):
            now = self.pick(active, disabled, primary, left)
            primary, left = now, None
            if now is None:
                yield Row(key=key[0], id=id_, provider=None, errors=0, disabled=False, left=False)
                continue
            errors[now] += 1
            off, leave = limited and errors[now] >= self.disable, not limited and errors[now] >= self.switch
            if off:
                disabled.add(now)
            if off or leave:
                primary, left = None, now
            yield Row(key=key[0], id=id_, provider=self.providers[now], errors=errors[now], disabled=off, left=leave)
        self.state.update((",".join(map(str, errors)), ",".join(map(str, sorted(disabled))), primary, left))


def failover(failed_calls: DataFrame, key: str, id_col: str, limited: Column, active: Column, providers: list[str], disable: int = 5, switch: int = 3) -> DataFrame:
    """(key, id, provider, errors, disabled, left) of each failed call: who took it, its errors by then, and whether it was disabled or left.

    active: the providers that the key may use, an array. Calls that succeed change nothing and need not be in the stream. Order is that
    of breakers(). Rows with a null key are a key of their own.
    """
    rows = failed_calls.select(F.col(key).alias("key"), F.unix_micros("ts").alias("us"), F.col(id_col).alias("id"), limited.alias("limited"), active.alias("active"))
    return rows.groupBy("key").transformWithState(Failover(providers, disable, switch), "key long, id long, provider string, errors int, disabled boolean, left boolean", "Append", "None")
