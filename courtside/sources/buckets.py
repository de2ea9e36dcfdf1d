"""Snapshots in key buckets, of which a batch of events reads and replaces only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 64
SPLIT = 4  # tasks that write one bucket, so that a key with many rows is no single task's work


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class BucketedTable:
    """A snapshot whose rows lie in folders by a hash of ``key``; the number of buckets stays for its life."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketedTable:
        table = cls(df.sparkSession, path, df.schema, key, buckets)
        table._write(df, table.path)
        return table

    def _write(self, df: DataFrame, path: str) -> None:
        rows = df.select(*self.schema.names).withColumn("_bucket", _bucket(self.key, self.buckets))
        rows.repartition("_bucket", F.pmod(F.xxhash64(*self.schema.names), F.lit(SPLIT))).write.mode("overwrite").partitionBy("_bucket").parquet(path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; folders of the others are not listed for the scan."""
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("_bucket", IntegerType())).option("basePath", self.path).parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))).select(*self.schema.names)

    def apply(self, batch_id: int, events: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame | tuple[DataFrame, DataFrame]]) -> DataFrame | None:
        """Replace the buckets that the events' keys lie in by ``change(rows of these buckets, events)``; returns what that rejects.

        ``change`` may look at a row and at events of the row's key only. Its result is written beside the table first and marked as whole;
        then it takes the place of the touched buckets. A batch that is repeated after a failure finds that result and puts it in place again,
        so it is applied once, whatever the change does.
        """
        staged = f"{self.path}-batches/batch_id={batch_id}"
        fs, done = _folder(self.spark, f"{staged}/touched/_SUCCESS")
        if not fs.exists(done):
            touched = events.select(_bucket(self.key, self.buckets).alias("bucket")).where("bucket IS NOT NULL").distinct()
            numbers = sorted(r[0] for r in touched.collect())  # at most the number of buckets
            out = change(self.read(numbers), events)
            new, rejected = out if isinstance(out, tuple) else (out, None)
            self._write(new, f"{staged}/rows")
            if rejected is not None:
                rejected.write.mode("overwrite").parquet(f"{staged}/rejected")
            self.spark.createDataFrame([(n,) for n in numbers], "bucket int").write.mode("overwrite").parquet(f"{staged}/touched")
        numbers = sorted(r[0] for r in self.spark.read.parquet(f"{staged}/touched").collect())
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add("_bucket", IntegerType())).option("basePath", f"{staged}/rows").parquet(f"{staged}/rows")
        filled = {r[0] for r in rows.select("_bucket").distinct().collect()}
        for n in sorted(set(numbers) - filled):  # nothing is left of these
            fs, gone = _folder(self.spark, f"{self.path}/_bucket={n}")
            fs.delete(gone, True)
        if filled:
            rows.repartition("_bucket", F.pmod(F.xxhash64(*self.schema.names), F.lit(SPLIT))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        fs, rejects = _folder(self.spark, f"{staged}/rejected")
        return self.spark.read.parquet(f"{staged}/rejected") if fs.exists(rejects) else None
