"""Hard negatives by an inverted multi-index.

Vectors of integers are cut in two halves, each with a codebook of half-space centroids and, for every centroid, the largest distance
(radius) of the halves that it stands for. A row lies in the cell of its two centroids. For an anchor, ``a * c + |a| * r`` bounds the half
scores of a centroid's rows from above, so the sum of two bounds holds for a whole cell. A multi-sequence heap walks the cells in falling
order of that sum; an anchor is finished when the next sum falls below what each of its windows still needs.

Anchors walk in rounds, each with more cells than the last. Within a round, anchors and rows meet by cell in groups of bounded size: a
cell's rows are dealt over slices, the anchors that ask for it over blocks. First every anchor finds its positives, then the rows of other labels
in the windows that its positives' scores open. Scores are exact integers and a walk ends only on proof, so the results are those of a
comparison with all rows, whatever the codebooks; these decide only how many cells are read.

Equal vectors with equal labels form a class, of which only the smallest ids can ever be among the first few.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.common import salted_join
from courtside.llm.vectors import classes, first_k, is_vector, matrix, one_length, written

GROUP = 2048  # rows of a slice and anchors of a block, about
FIRST_CELLS = 8  # cells that an anchor asks for in its first round; each round asks for STEP times as many
STEP = 4
SAMPLE = 4096  # rows that the codebooks are fitted on
MOST_CODES = 256  # centroids of a half: the tables of cells that go to the tasks have at most the square of it
UNBOUNDED = 1 << 62
FOUND = "array<struct<high:bigint,score:bigint,id:bigint>>"


def codebook(halves: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of at most ``k`` groups (Lloyd's iterations from evenly spaced distinct rows)."""
    different = np.unique(halves, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(k, len(different))).round().astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(halves, centres)[0]
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, halves)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(halves: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centroid."""
    code = ((centres**2).sum(1) - 2 * halves @ centres.T).argmin(1)
    return code, np.sqrt(((halves - centres[code]) ** 2).sum(1))


class Cells:
    """What a walk needs: both codebooks, their radii, and the occupied cells."""

    def __init__(self, books: list[np.ndarray], radii: list[np.ndarray], filled: set[int]):
        self.books, self.radii, self.filled = books, radii, filled

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Highest and lowest scores of each half's centroids, widened by more than rounding."""
        out, at = [], 0
        for book, radius in zip(self.books, self.radii, strict=True):
            half = anchor[at : at + book.shape[1]].astype(float)
            at += book.shape[1]
            middle, reach = book @ half, np.linalg.norm(half) * radius
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            out.append((middle + reach + slack, middle - reach - slack))
        return out

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """Highest and lowest possible score and number of the occupied cells, in falling order of the highest."""
        (high1, low1), (high2, low2) = self.bounds(anchor)
        first, second = np.argsort(-high1, kind="stable"), np.argsort(-high2, kind="stable")
        a, b = high1[first], high2[second]
        heap, width = [(-(a[0] + b[0]), 0, 0)], len(self.books[1])
        seen = {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = int(first[i]) * width + int(second[j])
            if cell in self.filled:
                yield -bound, float(low1[first[i]] + low2[second[j]]), cell
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[x] + b[y]), x, y))


def next_cells(walk: Iterator[tuple[float, float, int]], skip: int, budget: int, need: int, highest: int) -> tuple[list[int], int, bool]:
    """The next cells to read, how many the walk has passed by now, and whether it can end after them.

    Cells whose every score lies above ``highest`` are passed; the first cell whose every score lies below ``need`` ends the walk.
    """
    cells, passed = [], 0
    for high, low, cell in walk:
        if high < need:
            return cells, passed, True
        if passed >= skip and low <= highest:
            if len(cells) == budget:
                return cells, passed, False
            cells.append(cell)
        passed += 1
    return cells, passed, True


def floors(found: list[dict], highs: list[int], lows: list[int], k: int) -> list[int]:
    """The least score that can still enter each window."""
    out = []
    for high, low in zip(highs, lows, strict=True):
        scores = sorted((f["score"] for f in found if f["high"] == high), reverse=True)
        out.append(max(low, scores[k - 1]) if len(scores) >= k else low)
    return out


def scored(asked: pa.Table, rows: pa.Table, k: int, same: bool) -> pa.Table:
    """For a block of anchors and a slice of a cell: the first ``k`` classes in each window, rows of the anchor's label or of others."""
    schema = pa.schema([("key", asked.schema.field("key").type), ("high", pa.int64()), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))])
    if not asked.num_rows or not rows.num_rows:
        return schema.empty_table()
    rows = rows.take(pa.array(np.argsort(np.array([i[0] for i in rows.column("ids").to_pylist()]), kind="stable")))  # equal scores: smallest ids first
    anchors, vectors = matrix(asked.column("q"), np.int64), matrix(rows.column("q"), np.int64)
    if float(np.abs(anchors).max()) * float(np.abs(vectors).max()) * vectors.shape[1] < 2**53:
        anchors, vectors = anchors.astype(float), vectors.astype(float)  # sums stay exact
    label, of_row = asked.column("label").to_numpy(), rows.column("label").to_numpy()
    highs, least = asked.column("highs").to_pylist(), asked.column("floors").to_pylist()
    parts = []
    for at in range(0, len(anchors), 256):
        score = anchors[at : at + 256] @ vectors.T
        fits = (label[at : at + 256, None] == of_row) == same
        for w in range(max(map(len, highs[at : at + 256]), default=0)):
            high = np.array([x[w] if w < len(x) else -UNBOUNDED for x in highs[at : at + 256]], np.int64)
            low = np.array([x[w] if w < len(x) else UNBOUNDED for x in least[at : at + 256]], np.int64)
            row, column = first_k(score, fits & (score <= high[:, None]) & (score >= low[:, None]), k)
            parts.append((row + at, high[row], score[row, column].astype(np.int64), column))
    anchor, high, score, column = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    return pa.table([asked.column("key").take(pa.array(anchor)), pa.array(high), pa.array(score), rows.column("ids").take(pa.array(column))], schema=schema)


class MultiIndex:
    """The rows by cell and slice, with all that anchors need to walk them."""

    def __init__(self, rows: DataFrame, rows_per_cell: int = GROUP):
        """``rows`` has ``label``, ``q`` (integers) and ``ids``, a class each; not empty."""
        self.spark = rows.sparkSession
        n, most = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
        width = one_length(rows, "q")
        if most**2 * width >= UNBOUNDED:
            raise ValueError(f"components of up to {most} make scores that don't fit 64 bits")
        sample = matrix(rows.orderBy(F.xxhash64("q", "label"), "label", "q").limit(SAMPLE).select("q").toArrow().column("q"))
        codes = min(MOST_CODES, max(4, math.ceil(math.sqrt(n / rows_per_cell))))
        cut = width // 2
        books = [codebook(sample[:, :cut], codes), codebook(sample[:, cut:], codes)]
        wide = len(books[1])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = matrix(batch.column("q"))
                    (i, d), (j, e) = nearest(q[:, :cut], books[0]), nearest(q[:, cut:], books[1])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * wide + j), pa.array(d), pa.array(e)], [*batch.schema.names, "cell", "d", "e"])

        fields = [*rows.select("label", "q", "ids").schema.fields, T.StructField("cell", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("e", T.DoubleType())]
        self.rows = written(rows.select("label", "q", "ids").mapInArrow(placed, T.StructType(fields)), "cells")
        per_cell = self.rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("d"), F.max("e")).collect()  # at most MOST_CODES ** 2
        radii = [np.zeros(len(b)) for b in books]
        for cell, _, d, e in per_cell:
            radii[0][cell // wide], radii[1][cell % wide] = max(radii[0][cell // wide], d), max(radii[1][cell % wide], e)
        self.slices = {cell: math.ceil(n / GROUP) for cell, n, _, _ in per_cell}
        self.cells = Cells(books, radii, set(self.slices))

    def search(self, state: DataFrame, k: int, same: bool) -> DataFrame:
        """``key``, ``label``, ``q``, ``highs`` and ``found``: for every anchor and window the first ``k`` rows (a superset in a class of ties is cut).

        ``state`` has the anchors' ``key``, ``label``, ``q``, and as lists the windows' ``highs`` and ``lows``.
        """
        budget, cells = FIRST_CELLS, self.cells
        state = state.withColumn("passed", F.lit(0).cast("bigint")).withColumn("found", F.array().cast(FOUND))
        ended: list[DataFrame] = []
        columns = ["key", "label", "q", "highs", "found"]
        while True:
            asked = written(self._ask(state, budget, k), "asked")
            per_cell = asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()  # at most MOST_CODES ** 2
            ended.append(asked.where("size(cells) = 0").select(columns))
            if not per_cell:
                break
            met = self._meet(asked, {cell: math.ceil(n / GROUP) for cell, n in per_cell}, k, same)
            before = asked.where("size(cells) > 0").select("key", F.explode("found").alias("f")).select("key", "f.high", "f.score", "f.id")
            place = F.row_number().over(W.partitionBy("key", "high").orderBy(F.col("score").desc(), "id"))
            best = met.unionByName(before).withColumn("_place", place).where(F.col("_place") <= k)
            best = best.groupBy("key").agg(F.collect_list(F.struct("high", "score", "id")).alias("found"))
            more = asked.where("size(cells) > 0").drop("found", "cells", "floors").join(best, "key", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
            now = written(more, "walks")
            ended.append(now.where("done").select(columns))
            state = now.where("not done").drop("done")
            budget *= STEP
        out = ended[0]
        for df in ended[1:]:
            out = out.unionByName(df)
        return out

    def _ask(self, state: DataFrame, budget: int, k: int) -> DataFrame:
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column("q"), np.int64)
                out = []
                for x, passed, highs, lows, found in zip(q, *(batch.column(c).to_pylist() for c in ("passed", "highs", "lows", "found")), strict=True):
                    least = floors(found, highs, lows, k)
                    new = next_cells(cells.walk(x), passed, budget, min(least), max(highs)) if highs else ([], passed, True)
                    out.append((*new, least))
                if out:
                    asks, passed, done, least = (list(x) for x in zip(*out, strict=True))
                    kept = [batch.column(c) for c in ("key", "label", "q", "highs", "lows", "found")]
                    more = [pa.array(passed, pa.int64()), pa.array(done, pa.bool_()), pa.array(asks, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*kept, *more], ["key", "label", "q", "highs", "lows", "found", "passed", "done", "cells", "floors"])

        state = state.select("key", "label", "q", "highs", "lows", "found", "passed")
        longs = T.ArrayType(T.LongType())
        more = [T.StructField("done", T.BooleanType()), T.StructField("cells", longs), T.StructField("floors", longs)]
        return state.mapInArrow(run, T.StructType([*state.schema.fields, *more]))

    def _meet(self, asked: DataFrame, blocks: dict[int, int], k: int, same: bool) -> DataFrame:
        """Anchors and rows by cell, block and slice: the best of each group."""
        sizes = self.spark.createDataFrame([(c, b, self.slices[c]) for c, b in blocks.items()], "cell bigint, blocks int, slices int")  # at most MOST_CODES ** 2
        asks = asked.select("key", "label", "q", "highs", "floors", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
        asks = asks.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
        rows = self.rows.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("q", "label"), F.col("slices")).cast("int"))
        rows = rows.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        by = ["cell", "slice", "block"]
        left = asks.select(*by, "key", "label", "q", "highs", "floors").groupBy(*by)
        right = rows.select(*by, "label", "q", "ids").groupBy(*by)
        schema = T.StructType([asked.schema["key"], T.StructField("high", T.LongType()), T.StructField("score", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
        met = left.cogroup(right).applyInArrow(lambda a, b: scored(a, b, k, same), schema)
        return met.select("key", "high", "score", F.explode("ids").alias("id"))


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rows_per_cell: int = GROUP,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Scores are inner products of the vectors' components times ``scale``, rounded down. Anchors are the rows for which ``anchor`` holds. An
    anchor's positives are its first ``positives`` other rows of the same label, by falling score and then by id; for each of them, the first
    ``negatives`` rows of other labels with ``least_percent`` per cent of the positive's score or more, and no more than that score.

    Rows with a null id or label, a null or empty vector or a component that is null or not finite take no part; vectors of different
    lengths raise an error, and so do components whose scores would not fit 64 bits. Rows with equal id, label and vector count once; ids
    are taken for unique otherwise. Other columns are not read. Without anchors or rows the result is empty.
    """
    x, keep = F.col("v"), max(positives + 1, negatives)
    some = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    some = some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & is_vector(x))
    some = written(some.select("id", "label", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("q"), "anchor"), "vectors")
    anchors = some.where("anchor").withColumn("hash", F.xxhash64("q")).select("id", "label", "q", "hash").distinct()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if anchors.isEmpty():
        return some.sparkSession.createDataFrame([], schema)
    index = MultiIndex(written(classes(some.select("id", "label", "q"), ["label", "q"], "id", keep), "classes"), rows_per_cell)

    # Anchors with equal vector and label walk once.
    asked = anchors.groupBy("label", "q", "hash").agg(F.min("id").alias("least")).select(F.struct("label", "hash", "least").alias("key"), "label", "q")
    whole = [F.array(F.lit(b).cast("bigint")).alias(n) for n, b in (("highs", UNBOUNDED), ("lows", -UNBOUNDED))]
    near = index.search(asked.select("key", "label", "q", *whole), positives + 1, True)
    near = written(near.select("key", "label", "q", F.transform("found", lambda f: F.struct((-f["score"]).alias("below"), f["id"].alias("id"))).alias("near")), "positives")
    highs = F.array_distinct(F.transform(F.filter("near", lambda f: f["below"] <= 0), lambda f: -f["below"]))
    lows = F.expr(f"transform(highs, h -> cast(ceil(cast({least_percent} as decimal(10,0)) * h / 100) as bigint))")
    far = index.search(near.select("key", "label", "q", highs.alias("highs")).withColumn("lows", lows), negatives, False)
    both = near.select("key", "label", "q", F.array_sort("near").alias("near")).join(far.select("key", "found"), "key").drop("key")

    # Back to every anchor: a class may hold most of them.
    own = salted_join(anchors.select(F.col("id").alias("anchor_id"), "label", "q"), both, ["label", "q"], ["anchor_id"])
    own = own.select("anchor_id", "found", F.explode(F.slice(F.filter("near", lambda f: f["id"] != F.col("anchor_id")), 1, positives)).alias("p"))
    own = own.select("anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.below")).alias("positive_score"), "found")
    fit = F.array_sort(F.transform(F.filter("found", lambda f: f["high"] == F.col("positive_score")), lambda f: F.struct((-f["score"]).alias("below"), f["id"].alias("id"))))
    out = own.select("anchor_id", "positive_id", "positive_score", F.posexplode(fit).alias("place", "n"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.below")).alias("negative_score"))
