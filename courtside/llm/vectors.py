"""Vector columns: rows that take part in a search, classes of equal vectors, and vectors of Arrow batches as matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions.store import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def is_vector(column: Column) -> Column:
    """Whether it has components and all of them are finite numbers."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return column.isNotNull() & (F.size(column) > 0) & ~odd


def one_length(rows: DataFrame, vector: str) -> int:
    """Components of every vector; 0 for no rows."""
    least, most = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    return most or 0


def classes(rows: DataFrame, by: list[str], id_col: str, keep: int) -> DataFrame:
    """Equal vectors once, with the ``keep`` smallest ids in order as ``ids``.

    A class with most of all rows is cut to its smallest ids before the shuffle. Repeated rows count once.
    """
    place = F.dense_rank().over(W.partitionBy(*by).orderBy(id_col))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).groupBy(*by).agg(F.array_sort(F.collect_set(id_col)).alias("ids"))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.zeros((0, 0), dtype)
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1).astype(dtype, copy=False)


def first_k(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``scores`` the ``k`` highest allowed columns, equal scores by column: numbers of rows and columns, in order."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, np.array(np.iinfo(np.int64).min if scores.dtype.kind == "i" else -np.inf, scores.dtype))
        bar = np.partition(masked, -k, axis=1)[:, -k]
        allowed = allowed & (masked >= bar[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]
