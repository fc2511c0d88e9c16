"""Joins of the content pipeline: nested children, precedence, ranges, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key with place, counted from the oldest of them."""
    own = Window.partitionBy(key)
    back = rows.withColumn("_back", F.row_number().over(own.orderBy(*[c.desc() for c in order]))).filter(F.col("_back") <= n)
    return back.withColumn("place", F.row_number().over(own.orderBy(F.desc("_back"))).cast("bigint")).drop("_back")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of stretches of one key that overlap: left (key, lo, hi, ...), right (key, y1, y2, ...).

    Both are cut into buckets of a width, so that the join has an equality to partition by; a pair counts in the
    bucket where the overlap begins.
    """
    a = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col("y1") / width), F.floor((F.col("y2") - 1) / width))))
    both = a.join(b, [key, "_b"]).filter((F.col("y1") < F.col("hi")) & (F.col("y2") > F.col("lo")))
    return both.filter(F.floor(F.greatest("lo", "y1") / width) == F.col("_b")).drop("_b")


def nearest(points: DataFrame, targets: DataFrame, key: str, within: int) -> DataFrame:
    """points (key, at) with snapped: the nearest target row within reach, of two the smaller, or the point itself."""
    bucket = within + 1
    p = points.withColumn("_b", F.explode(F.array(*[F.floor(F.col("at") / bucket) + d for d in (-1, 0, 1)])))
    t = targets.select(key, F.col("row").alias("_row"), F.floor(F.col("row") / bucket).alias("_b"))
    near = p.join(t, [key, "_b"], "left").withColumn("_d", F.abs(F.col("_row") - F.col("at")))
    best = F.min_by("_row", F.when(F.col("_d") <= within, F.struct("_d", "_row")))
    return near.groupBy(key, "at").agg(F.coalesce(best, F.col("at")).alias("snapped"))


def precedence(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))
