"""Stored tables whose rows change: bucket partitions, of which a change rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 16


class StoredTable:
    """A Parquet table below a path, a folder a bucket of its key.

    A change reads and writes the buckets of its keys, and puts them in the place of the old ones when all are written (Spark's dynamic
    partition overwrite): a change that fails while it is computed or written leaves the table as it was, and files of other buckets are not touched. One
    change at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def stored(self) -> DataFrame:
        """All rows, with their bucket."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema).withColumn("_bucket", F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.stored().drop("_bucket")

    def _put(self, rows: DataFrame) -> None:
        dealt = rows.withColumn("_bucket", self.bucket()).repartition("_bucket")
        dealt.write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def seed(self, rows: DataFrame) -> bool:
        """The first rows, if the table has none; whether it had none."""
        if not self.stored().isEmpty():
            return False
        self._put(rows.select(*self.schema.names))
        return True

    def _touched(self, changes: DataFrame) -> list[int]:
        # Bounded by the number of buckets.
        return [r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect()]

    def upsert(self, changes: DataFrame) -> None:
        """The table with all rows of the changes in place of those of the same keys. Of changes with one key, the last columns' largest wins."""
        rest = [c for c in self.schema.names if c != self.key]
        new = changes.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_row")).select(self.key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*self.schema.names)
        old = self.stored().filter(F.col("_bucket").isin(self._touched(new))).drop("_bucket")
        self._put(old.join(new.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(new))

    def update(self, where: Column, **values: Column) -> None:
        """New values for the rows for which where holds; buckets without such rows stay as they are."""
        hit = F.coalesce(where, F.lit(False))
        touched = [r[0] for r in self.stored().filter(hit).select("_bucket").distinct().collect()]
        if touched:
            changed = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}
            self._put(self.stored().filter(F.col("_bucket").isin(touched)).withColumn("_hit", hit).withColumns(changed).select(*self.schema.names))
