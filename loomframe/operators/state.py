"""Keyed state: attempts, breakers, reconciliation, latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_failures(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """rows with failures, the running number of failed rows of each key."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(failed.cast("bigint")).over(own))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, as grouped maxima (no sort of whole groups)."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def snapshot(changes: DataFrame, keys: list[str], order: list[str], state: str = "state") -> DataFrame:
    """Current row of each key after full-row replaces, with attempts: changes to RUNNING or RETRYABLE so far."""
    rest = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    found = changes.groupBy(*keys).agg(last, F.count_if(F.col(state).isin("RUNNING", "RETRYABLE")).alias("attempts"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "attempts")


def reconcile(states: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Next state of each row from what became of its artifact.

    states: keys, state, checksum; artifacts: keys, digest, qa_ok, reason. Missing: COMPLETE becomes RETRYABLE; failed check:
    RETRYABLE and quarantined; another digest than the recorded one: unchanged, not reconciled; else COMPLETE.
    """
    both = states.join(artifacts.withColumn("_there", F.lit(True)), keys, "left")
    there, bad = F.coalesce("_there", F.lit(False)), ~F.coalesce("qa_ok", F.lit(False))
    differs = F.coalesce((F.col("checksum") != "") & (F.col("checksum") != F.col("digest")), F.lit(False))
    next_state = (
        F.when(~there, F.when(F.col("state") == "COMPLETE", "RETRYABLE").otherwise(F.col("state")))
        .when(bad, "RETRYABLE").when(differs, F.col("state")).otherwise("COMPLETE")
    )
    code = F.when(~there & (F.col("state") == "COMPLETE"), "MISSING_ARTIFACT").when(there & bad, "QA_FAILED")
    return both.select(*keys, "state", next_state.alias("next_state"), code.alias("error_code"), (there & ~bad & ~differs).alias("reconciled"), (there & bad).alias("quarantined"))


def transitions(rows: DataFrame, key: str, order: list[str], value: str, quiet: str | None = None) -> DataFrame:
    """Rows whose value differs from the one before; a first row only if it is not the quiet value."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("before", before)
    first = F.col("before").isNull() & (F.col(value) != quiet) if quiet is not None else F.lit(False)
    return rows.filter((F.col("before") != F.col(value)) | first)


def stuck(rows: DataFrame, key: str, ts: str, state: Column, seconds: int, now: Column) -> DataFrame:
    """Rows of a state that nothing follows within so many seconds; gap is the time to the next row of the key, or to now where there is none."""
    following = F.coalesce(F.lead(ts).over(Window.partitionBy(key).orderBy(ts)), now)
    gap = F.timestamp_diff("SECOND", F.col(ts), F.col("following"))
    return rows.withColumn("following", following).filter(state & (gap >= seconds)).withColumn("gap", gap)
