"""Paged responses, appends and notification output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courtside.functions.common import names


def page_envelope(df: DataFrame, keys, page: int = 1, limit: int = 10, order: str | None = None) -> DataFrame:
    """One row per request: keys, page, limit and the page's rows as an array (at most ``limit`` long)."""
    keys = names(keys)
    cols = [c for c in df.columns if c not in keys]
    if order:
        cols = [order, *[c for c in cols if c != order]]
    data = F.array_sort(F.collect_list(F.struct(*cols))) if order else F.collect_list(F.struct(*cols))
    return df.groupBy(*keys).agg(data.alias("data")).select(*keys, F.lit(page).alias("page"), F.lit(limit).alias("limit"), "data")


def write_page(df: DataFrame, path: str, keys, page: int = 1, limit: int = 10, order: str | None = None, fmt: str = "json") -> None:
    """Write paged responses."""
    page_envelope(df, keys, page, limit, order).write.mode("overwrite").format(fmt).save(path)


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append rows to a table folder."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own folder; a replay overwrites it, so nothing is doubled."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark, path: str, schema) -> DataFrame:
    """Rows of all written micro-batches (an empty frame before the first)."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def emit_notifications(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append notifications, partitioned by day, each micro-batch exactly once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", F.to_date("time"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
