"""Approximate nearest neighbours by a permutation index.

Every vector is known by its nearest pivots in order. A vector is filed under its first pivot; within a slice of such a list, an inverted
file posts every row under each pivot of its prefix, with the place that the pivot has there. A query opens the lists of its own nearest
pivots, adds up over the postings of its pivots how well the places agree, which gives the footrule distance (a pivot that is missing from
a prefix counts as the place behind its end), and compares the rows that rank best with exact inner products.

How many lists a query opens and which share of the rows it compares is measured: a bounded set of probe queries is answered by brute
force, and the smallest settings are taken that find the target share of their true neighbours. The share becomes a bar on the footrule
distance of each query by ranking a bounded sample of the rows. All rows are indexed, no row is dropped for the size of a list, and a query
that finds too few rows is compared with all of them.

Inner products become distances by one more component: vectors are scaled to the longest and filled up to length one, queries get a zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.common import salted_join
from courtside.llm.vectors import classes, is_vector, matrix, one_length, written

GROUP = 2048  # rows of a slice and queries of a block, about
BLOCK = 256  # queries whose distances to a slice are held at once
PAIRS = 1 << 17  # candidates that are compared at once
FIRST_LISTS = 4  # lists that give a query the score which rows of further lists have to reach
OPENED = 0.25  # what adding up the postings of a row costs, against comparing it
SHARES = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.27, 0.4, 0.6, 1.0)


class Pivots:
    """Pivots, the length of a prefix, and the sample by which queries turn a share of the rows into a bar."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int, prefix: int):
        self.longest = longest
        filled = self.filled(sample)
        self.pivots = filled[:pivots]
        self.count = len(self.pivots)
        self.prefix = min(prefix, self.count)
        self.weights = self.weights_of(self.prefixes(filled))

    def filled(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))[:, None]])

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        length = np.sqrt((vectors**2).sum(1))
        return np.hstack([vectors / length[:, None], np.zeros((len(vectors), 1))])

    def prefixes(self, filled: np.ndarray) -> np.ndarray:
        """Numbers of the nearest pivots, nearest first."""
        return np.argsort(-(filled @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix].astype(np.int16)

    def weights_of(self, prefixes: np.ndarray) -> np.ndarray:
        """Rows by pivots: prefix length less place, 0 where the pivot is missing."""
        out = np.zeros((len(prefixes), self.count), np.int16)
        np.put_along_axis(out, prefixes.astype(np.int64), np.arange(self.prefix, 0, -1, dtype=np.int16)[None], 1)
        return out

    def agreement(self, prefix: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of the smaller weights; the footrule distance is prefix * (prefix + 1) less twice that."""
        return np.minimum(weights[:, prefix], np.arange(self.prefix, 0, -1, dtype=np.int16)).sum(1)

    def bar(self, prefix: np.ndarray, share: float) -> int:
        """The agreement that ``share`` of the sample reaches; -1 for all rows."""
        if share >= 1:
            return -1
        seen = np.sort(self.agreement(prefix, self.weights))[::-1]
        return int(seen[min(len(seen), math.ceil(share * len(seen))) - 1])


def postings(prefixes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An inverted file: rows and weights by pivot, and where each pivot's postings begin."""
    rows, places = np.divmod(np.arange(prefixes.size), prefixes.shape[1])
    pivot = prefixes.ravel()
    order = np.argsort(pivot, kind="stable")
    return rows[order], (prefixes.shape[1] - places[order]).astype(np.int16), np.searchsorted(pivot[order], np.arange(count + 1))


def agreements(asked: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], n_rows: int, count: int) -> np.ndarray:
    """Queries by rows, added up over the postings of the queries' pivots."""
    out = np.zeros((len(asked), n_rows), np.int32)
    query, weight, starts = postings(asked, count)
    row, of_row, begins = rows
    for pivot in range(count):
        q, r = slice(starts[pivot], starts[pivot + 1]), slice(begins[pivot], begins[pivot + 1])
        if q.start < q.stop and r.start < r.stop:
            out[np.ix_(query[q], row[r])] += np.minimum.outer(weight[q], of_row[r])
    return out


def inner(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``a`` and rows ``j`` of ``b``, given as columns, added up in the order of the components."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        for x, y in zip(a, b, strict=True):
            out[some] += x[i[some]] * y[j[some]]
    return out


def compared(asked: pa.Table, rows: pa.Table, count: int, k: int) -> pa.Table:
    """For a block of queries and a slice of a list: each query's ``k`` best classes among those that reach its bar and floor."""
    schema = pa.schema([("key", asked.schema.field("key").type), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
    if not asked.num_rows or not rows.num_rows:
        return schema.empty_table()
    rows = rows.take(pa.array(np.argsort(np.array([i[0] for i in rows.column("ids").to_pylist()]), kind="stable")))  # equal scores: smallest ids first
    queries, vectors = (np.ascontiguousarray(matrix(t.column("v")).T) for t in (asked, rows))
    prefixes, file = matrix(asked.column("prefix"), np.int16), postings(matrix(rows.column("prefix"), np.int16), count)
    bar, floor = asked.column("bar").to_numpy(), asked.column("floor").to_numpy()
    parts = []
    for at in range(0, len(prefixes), BLOCK):
        agreed = agreements(prefixes[at : at + BLOCK], file, rows.num_rows, count)
        i, j = np.nonzero(agreed >= bar[at : at + BLOCK, None])
        i += at
        score = inner(queries, vectors, i, j)
        keep = score >= floor[i]
        i, j, score = i[keep], j[keep], score[keep]
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append((i[first], j[first], score[first]))
    i, j, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table([asked.column("key").take(pa.array(i)), pa.array(score), rows.column("ids").take(pa.array(j))], schema=schema)


class PivotIndex:
    """Classes of equal vectors by first pivot, as a table in the shared folder."""

    def __init__(self, rows: DataFrame, pivots: int, prefix: int, sample: int):
        """``rows``: ``v`` and ``ids`` of every class; not empty. The first ``pivots`` of ``sample`` rows, in the order of a hash, are the pivots."""
        self.spark = rows.sparkSession
        longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
        some = matrix(rows.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(sample).select("v").toArrow().column("v"))
        self.pivots = known = Pivots(some, math.sqrt(longest), pivots, prefix)

        def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = known.prefixes(known.filled(matrix(batch.column("v"))))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), known.prefix).cast(pa.list_(pa.int16()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(found[:, 0].astype(np.int32))], [*batch.schema.names, "prefix", "list"])

        more = [T.StructField("prefix", T.ArrayType(T.ShortType())), T.StructField("list", T.IntegerType())]
        rows = rows.select("v", "ids")
        self.rows = written(rows.mapInArrow(filed, T.StructType([*rows.schema.fields, *more])), "pivots")
        sizes = self.rows.groupBy("list").agg(F.count(F.lit(1)), F.sum(F.size("ids"))).collect()  # at most the number of pivots
        self.slices = {pivot: math.ceil(n / GROUP) for pivot, n, _ in sizes}
        self.n_ids = sum(n for _, _, n in sizes)

    def settings(self, probes: np.ndarray, k: int, recall: float) -> tuple[int, float]:
        """Lists to open (by the query's nearest pivots) and share of the rows to compare, the least that find ``recall`` of the probes' neighbours."""
        known = self.pivots

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    score = probes @ matrix(batch.column("v")).T
                    top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    probe = np.repeat(np.arange(len(probes)), top.shape[1])
                    kept = [batch.column("prefix").take(pa.array(top.ravel())), pa.array(score[probe, top.ravel()])]
                    yield pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int32)), *kept], ["probe", "prefix", "score"])

        near = self.rows.select("v", "prefix").mapInArrow(best, "probe int, prefix array<smallint>, score double")
        place = F.row_number().over(W.partitionBy("probe").orderBy(F.col("score").desc(), "prefix"))
        truth = near.withColumn("place", place).where(F.col("place") <= k + 1).toArrow()  # k + 1 rows of each probe
        probe, of_row = truth.column("probe").to_numpy(), matrix(truth.column("prefix"), np.int64)
        asked = known.prefixes(known.of_queries(probes))
        agreed, opened = np.zeros(len(probe)), np.zeros(len(probe), np.int64)
        weights = known.weights_of(of_row)
        for p, prefix in enumerate(asked):
            of = np.flatnonzero(probe == p)
            agreed[of] = known.agreement(prefix, weights[of])
            place_of = np.full(known.count, known.count - 1)
            place_of[prefix] = np.arange(len(prefix))
            opened[of] = place_of[of_row[of, 0]]
        # A probe is one of the rows and finds itself, so its first row doesn't count.
        counted = truth.column("place").to_numpy() > 1
        if not counted.any():
            return known.count, 1.0
        opened, agreed, probe = opened[counted], agreed[counted], probe[counted]
        lengths = sorted({max(1, known.prefix >> s) for s in range(4)}) + [known.count]
        fit = [(known.count * 1.0, known.count, 1.0)]
        for share in SHARES:
            reached = agreed >= np.array([known.bar(prefix, share) for prefix in asked])[probe]
            fit += [(n * (OPENED + share), n, share) for n in lengths if ((opened < n) & reached).mean() >= recall]
        return min(fit)[1:]

    def asked(self, queries: DataFrame, share: float) -> DataFrame:
        """``key`` and ``v`` of queries with their prefixes and bars."""
        known = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = known.prefixes(known.of_queries(matrix(batch.column("v"))))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), known.prefix).cast(pa.list_(pa.int16()))
                    bars = pa.array([known.bar(p, share) for p in found], pa.int32())
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists, bars], [*batch.schema.names, "prefix", "bar"])

        queries = queries.select("key", "v")
        more = [T.StructField("prefix", T.ArrayType(T.ShortType())), T.StructField("bar", T.IntegerType())]
        return queries.mapInArrow(run, T.StructType([*queries.schema.fields, *more]))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """``key``, ``score`` and ``id``: the ``k`` best rows of every query in its ``lists``, from ``key``, ``v``, ``prefix``, ``bar``, ``floor`` and ``lists``."""
        asked = asked.select("key", "v", "prefix", "bar", "floor", F.explode(F.col("lists").cast("array<int>")).alias("list"))
        per_list = asked.groupBy("list").count().collect()  # at most the number of pivots
        sizes = [(p, math.ceil(n / GROUP), self.slices[p]) for p, n in per_list if p in self.slices]
        table = F.broadcast(self.spark.createDataFrame(sizes, "list int, blocks int, slices int"))
        left = asked.join(table, "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
        right = self.rows.join(table, "list").withColumn("slice", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        by, count = ["list", "slice", "block"], self.pivots.count
        left = left.select(*by, "key", "v", "prefix", "bar", "floor").groupBy(*by)
        right = right.select(*by, "v", "ids", "prefix").groupBy(*by)
        schema = T.StructType([asked.schema["key"], T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.LongType()))])
        return left.cogroup(right).applyInArrow(lambda a, b: compared(a, b, count, k), schema).select("key", "score", F.explode("ids").alias("id"))


def best(found: DataFrame, k: int) -> DataFrame:
    """``key`` and ``near``: the ``k`` best (falling score, then id) as a list of ``below`` (the score negated) and ``id``."""
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("score").desc(), "id"))
    found = found.distinct().withColumn("_place", place).where(F.col("_place") <= k)
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "id"))).alias("near"))


def nearest_neighbours(
    rows: DataFrame, query: Column, k: int = 20, recall: float = 0.95, pivots: int = 256, prefix: int = 64, sample: int = 4096, probes: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` rows with the largest inner products that each query row finds.

    Queries are the rows for which ``query`` holds; candidates are all rows but those with the query's own id. ``recall`` is the share of true
    neighbours at which the settings are chosen, measured on at most ``probes`` queries (by a hash of the vector) against all rows; pivots
    and bars come from at most ``sample`` rows. More ``pivots`` with the same ``prefix`` make the lists shorter; a larger share of the pivots in
    the prefix makes the footrule sharper.

    Rows with a null id, a vector that is null, empty, zero or has a component that is null or not finite take no part; vectors of
    different lengths raise an error. Repeated rows count once. Equal scores go by id. A query with fewer than ``k`` other rows gets all.
    Other columns are not read. Without queries or rows the result is empty.
    """
    v = F.col("v")
    some = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("query"))
    some = written(some.where(F.col("id").isNotNull() & is_vector(v) & F.exists(v, lambda x: x != 0)), "vectors")
    queries = some.where("query").select(F.col("id").alias("query_id"), "v").distinct()
    if queries.isEmpty():
        return some.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    one_length(some, "v")
    index = PivotIndex(written(classes(some.select("id", "v"), ["v"], "id", k + 1), "classes"), pivots, prefix, sample)
    known = index.pivots

    # Queries with equal vectors search once.
    once = written(queries.groupBy("v").agg(F.min("query_id").alias("least")).select(F.struct("least", F.xxhash64("v").alias("hash")).alias("key"), "v"), "queries")
    lists, share = index.settings(matrix(once.orderBy("key.hash", "key.least").limit(probes).select("v").toArrow().column("v")), k, recall)
    asked = written(index.asked(once, share), "asked")
    nothing = F.lit(-math.inf)
    opened = F.slice("prefix", 1, lists) if lists <= known.prefix else F.expr(f"array_union(prefix, cast(sequence(0, {known.count - 1}) as array<smallint>))")
    first = written(best(index.search(asked.withColumn("floor", nothing).withColumn("lists", F.slice("prefix", 1, FIRST_LISTS)), k + 1), k + 1), "near")
    floor = F.when(F.size("near") > k, -F.col("near")[k]["below"]).otherwise(nothing)
    rest = asked.join(first.withColumn("floor", floor).select("key", "floor"), "key", "left").withColumn("floor", F.coalesce("floor", nothing))
    rest = rest.withColumn("lists", F.slice(opened, FIRST_LISTS + 1, known.count))
    flat = first.select("key", F.explode("near").alias("n")).select("key", (-F.col("n.below")).alias("score"), F.col("n.id").alias("id"))
    near = written(best(index.search(rest, k + 1).unionByName(flat), k + 1), "near")

    short = asked.join(near.where(F.size("near") >= min(k + 1, index.n_ids)), "key", "left_anti")
    if not short.isEmpty():
        every = F.expr(f"sequence(0, {known.count - 1})")
        full = best(index.search(short.withColumn("bar", F.lit(-1)).withColumn("floor", nothing).withColumn("lists", every), k + 1), k + 1)
        near = near.join(full.select("key"), "key", "left_anti").unionByName(full)
    back = salted_join(queries, near.join(once, "key").select("v", "near"), ["v"], ["query_id"])
    back = back.select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)).alias("place", "n"))
    return back.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.below")).alias("score"))
