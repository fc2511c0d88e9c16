"""Federated search over the hits of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.exprs import title_key
from loomframe.sources.adapters import SOURCES


def upgraded(hits: DataFrame, key: str = "key") -> DataFrame:
    """One hit per key: the first with a cover, else the first; first_at is where the key came first."""
    own = F.struct(F.col("cover").isNull().alias("bare"), F.col("arrival"))
    rest = [c for c in hits.columns if c != key]
    best = hits.groupBy(key).agg(F.min_by(F.struct(*rest), own).alias("_hit"), F.min("arrival").alias("first_at"))
    return best.select(key, *[F.col(f"_hit.{c}").alias(c) for c in rest], "first_at")


def federated(parts: list[DataFrame], q: str, priority: list[str] | None = None, default_source: str | None = None, limit: int = 225) -> DataFrame:
    """Hits of all sources in one ranked list, with place.

    Blank titles go; titles are compared without case, accents and punctuation. Rank: exact, beginning, containing,
    other; then the source's priority (unknown 99, missing as the default source), then the order of arrival. An empty query
    ranks by source alone. The list ends at the limit (9 sources of 25 hits each).
    """
    known = priority or SOURCES[:9]
    hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    hits = upgraded(hits.withColumn("key", title_key(F.col("title"))).filter("key <> ''"))
    needle = title_key(F.lit(q))
    relevance = F.when(needle == "", 3).when(F.col("key") == needle, 0).when(F.startswith("key", needle), 1).when(F.contains(F.col("key"), needle), 2).otherwise(3)
    place = F.array_position(F.array(*map(F.lit, known)), F.coalesce("source", F.lit(default_source or known[0])))
    prio = F.when(place > 0, place - 1).otherwise(99)
    top = hits.withColumns({"_r": relevance, "_p": prio}).orderBy("_r", "_p", "first_at").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_r", "_p", "first_at")).cast("bigint")).drop("_r", "_p")
