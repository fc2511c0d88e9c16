"""Places over a whole list: row numbers in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.sources.files import own_folder

#: monotonically_increasing_id is the partition's number times this, plus the row's within it.
STRIDE = 1 << 33


def numbered(rows: DataFrame, order: list[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """rows with their 1-based place in the order, which must end with a unique column.

    The rows are dealt out by ranges of the order, sorted within each range, and stored once with their numbers there. The ranges' sizes,
    one number for each, give what is to be added. A key that many rows share is cut by the columns behind it.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = own_folder(spark)
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    part = F.floor(F.col("_at") / STRIDE)
    sizes = sorted(map(tuple, stored.groupBy(part.alias("part")).agg(F.count("*")).collect()))
    before, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, before))
        before += size
    offsets = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    return stored.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at") % STRIDE + 1).drop("_part", "_before", "_at")
