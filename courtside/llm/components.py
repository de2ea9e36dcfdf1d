"""Connected components of an edge list, smallest node as the label, without collecting edges or groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.store import new_path

ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges a-b: the nodes that are not the smallest of their component, and that smallest node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, parent[left], low)
        np.minimum.at(parent, parent[right], low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        if (before == parent).all():
            break
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` for every node of the edges (two bigint columns) but the roots themselves; root is the smallest node reachable.

    Alternates two steps until nothing changes: every node hangs its larger neighbours on its smallest one, then every node hangs itself
    and its smaller neighbours on the smallest. Smallest neighbours are counted map-side, so a hub sends one row per task; the joins back
    on the hub are plain equi joins that adaptive execution splits. Each round is written to the shared folder, which cuts the lineage.
    Null ends and loops are ignored; repeated edges change nothing.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = new_path(spark, "components")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def seal(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        return tuple(row)

    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("root")).where("node is not null and root is not null and node <> root")
    now = written(pairs.mapInArrow(_stars, "node bigint, root bigint"))
    state = seal(now)
    if not state[0]:
        return now
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
        larger = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node <> root").distinct()
        least = larger.groupBy("node").agg(F.min("root").alias("least"))
        hung = larger.join(least, "node").where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        now = written(hung.union(least.withColumnRenamed("least", "root")).distinct())
        new = seal(now)
        if new == state:
            return now
        state = new
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
