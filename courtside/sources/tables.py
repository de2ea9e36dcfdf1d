"""Table scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from courtside.sources.schemas import schemas


def load_tables(spark: SparkSession, path: str, only: Mapping[str, str] | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """One DataFrame per table under ``path``, with declared schemas (no inference).

    ``only`` replaces the marketplace schemas by other ``{table: schema}`` pairs.
    """
    wanted = only if only is not None else schemas()
    suffix = f".{fmt}"
    return {name: spark.read.schema(schema).format(fmt).load(f"{path}/{name}{suffix}") for name, schema in wanted.items()}


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """S01 from a database: ``parts`` parallel range reads over a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
    return reader.option("numPartitions", parts).load()


def save_tables(tables: Mapping[str, DataFrame], path: str, bucket_by: Mapping[str, tuple[str, int]] | None = None) -> None:
    """Write a snapshot of tables under ``path``; ``bucket_by`` lays a table out for joins on one key."""
    for name, df in tables.items():
        if bucket_by and name in bucket_by:
            key, n = bucket_by[name]
            df = df.repartition(n, key).sortWithinPartitions(key)
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones as NULL (older exports lack some)."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
