"""Small column and frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP_LIMIT_ROWS = 1000  # Spark prunes row_number() <= k before the shuffle up to this k by default


def names(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ntz(value: str) -> Column:
    """A time-zone-free timestamp literal, the type the Parquet timestamps load as."""
    return F.lit(value).cast("timestamp_ntz")


def for_keys(df: DataFrame, req, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` asked for: all (None), by scalar/list of one key, or by a requests DataFrame."""
    keys = names(on)
    if req is None:
        return df
    if isinstance(req, DataFrame):
        return df.join(req.select(*keys).distinct(), keys, "left_semi")
    if isinstance(req, (list, tuple, set)):
        return df.filter(F.col(keys[0]).isin(*req))
    return df.filter(F.col(keys[0]) == req)


def ranked(df: DataFrame, keys, order: Sequence[Column], top: int, name: str = "_rn") -> DataFrame:
    """Keep the first ``top`` rows of every key, numbered from 1 in ``name``.

    Up to GROUP_LIMIT_ROWS Spark itself drops losers before the shuffle; beyond it a first pass over
    (key, hash slice) does, so that one hot key never has to pass whole through a single task.
    """
    keys = names(keys)
    if top > GROUP_LIMIT_ROWS:
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(64))
        local = W.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_slice", spread).withColumn("_local", F.row_number().over(local))
        df = df.filter(F.col("_local") <= top).drop("_slice", "_local")
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= top)


def page_by(df: DataFrame, keys, order: Sequence[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """LIMIT/OFFSET per key: rows in (offset, offset + limit] of ``order``, which must end in a unique key."""
    page, limit = page or 1, limit or 10
    offset = (page - 1) * limit
    out = ranked(df, keys, order, offset + limit)
    return (out.filter(F.col("_rn") > offset) if offset else out).drop("_rn")


BOUND_STEP = 16  # bounds of the keys are rounded up to a power of it, so that each class of keys has a fixed limit


def page_requests(df: DataFrame, keys, order: Sequence[Column], requests: DataFrame, page: str = "page", limit: str = "limit") -> DataFrame:
    """T01 for many requests: for each request row its own page of its key's rows, with the request's columns and ``position`` from 1.

    ``requests`` has the keys, a page and a limit (1 and 10 where unset) and may ask several pages of one key. A key's rows are ranked once, up to
    the furthest row that any of its requests asks for; the keys are dealt into classes by that bound, so that in each class losers are
    dropped before the shuffle. ``order`` has to end in a unique key. Null keys have no rows.
    """
    keys = names(keys)
    size = F.when(is_unset(limit), F.lit(10)).otherwise(F.col(limit)).cast("bigint")
    start = (F.when(is_unset(page), F.lit(1)).otherwise(F.col(page)).cast("bigint") - 1) * size
    asked = requests.withColumn("_from", start).withColumn("_to", F.col("_from") + size)
    bounds = asked.groupBy(*keys).agg(F.max("_to").alias("_bound")).where("_bound > 0")
    furthest = bounds.agg(F.max("_bound")).first()[0] or 0
    out, low = None, 0
    while low < furthest:
        high = min(max(BOUND_STEP, low * BOUND_STEP), furthest)
        mine = bounds.where((F.col("_bound") > low) & (F.col("_bound") <= high)).select(*keys)
        some = ranked(df.join(mine, keys, "left_semi"), keys, order, high, "position")
        out, low = some if out is None else out.unionByName(some), high
    if out is None:
        out = df.limit(0).withColumn("position", F.lit(0))
    out = salted_join(asked, out, keys, requests.columns, salts=4).where("position > _from AND position <= _to")
    return out.drop("_from", "_to").withColumn("position", F.col("position").cast("bigint"))


def seek_requests(df: DataFrame, keys, order: Sequence[str], requests: DataFrame, limit: str = "limit") -> DataFrame:
    """The rows that follow a cursor: for each request row the first ``limit`` rows of its key behind its place in the order.

    ``order`` names columns, ascending, the last of them unique; ``requests`` has the keys, the limit (10 where unset) and the last row seen as
    ``after_<column>`` for each of them (all null: from the start). Rows before the cursor are dropped where they meet it, so a deep page costs no
    more than a first one. Adds the request's columns and ``position`` from 1.
    """
    keys = names(keys)
    after = [f"after_{c}" for c in order]
    size = F.when(is_unset(limit), F.lit(10)).otherwise(F.col(limit)).cast("int")
    asked = requests.withColumn("_size", size)
    most = asked.agg(F.max("_size")).first()[0] or 0
    marks = asked.select(*keys, *after, "_size").groupBy(*keys, *after).agg(F.max("_size").alias("_most"))
    open_ = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in after])
    met = salted_join(df, marks, keys, [c for c in df.columns if c not in keys], salts=4)
    met = met.where(open_ | (F.struct(*order) > F.struct(*[F.col(c).alias(o) for o, c in zip(order, after, strict=True)])))
    found = ranked(met, [*keys, *after], [F.col(c) for c in order], max(most, 1), "position").where("position <= _most").drop("_most")
    same = reduce(lambda a, b: a & b, [asked[c].eqNullSafe(found[c]) for c in [*keys, *after]])
    out = asked.join(found, same).drop(*[found[c] for c in [*keys, *after]])
    return out.where("position <= _size").drop("_size").withColumn("position", F.col("position").cast("bigint"))


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, limit: int = 10) -> DataFrame:
    """LIMIT/OFFSET over the whole frame (a distributed top-k, no full sort)."""
    out = df.orderBy(*order).limit(page * limit)
    return out.offset((page - 1) * limit) if page > 1 else out


def attach_list(rows: DataFrame, child: DataFrame, row_keys, on: str, value: str, out: str) -> DataFrame:
    """Add ``out``: sorted distinct child values per row, an empty array when there is none.

    Children are joined to the (already paged) rows first, so lists are built only for rows that are kept.
    """
    keys = names(row_keys)
    rest = [c for c in rows.columns if c not in keys]
    joined = rows.join(child.select(on, F.col(value).alias("_item")), on, "left")
    aggs = [F.array_sort(F.collect_set("_item")).alias(out)]
    if rest:
        aggs.append(F.first(F.struct(*rest)).alias("_row"))
    done = joined.groupBy(*keys).agg(*aggs)
    return done.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns], out)


def count_by(child: DataFrame, key: str, out: str) -> DataFrame:
    """Rows per key; counted map-side first, so a hot key shuffles one row per task."""
    return child.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def rating_summary(reviews: DataFrame, key: str, avg: str = "avg_rating", n: str | None = "no_of_reviews") -> DataFrame:
    aggs = [F.avg("rating").alias(avg)]
    if n:
        aggs.append(F.count(F.lit(1)).alias(n))
    return reviews.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def with_rating(df: DataFrame, reviews: DataFrame, key: str, count: bool = False) -> DataFrame:
    """Left join of the pre-aggregated rating, 0 when a row has no review."""
    r = rating_summary(reviews, key, n="no_of_reviews" if count else None)
    fill = {"avg_rating": 0.0, **({"no_of_reviews": 0} if count else {})}
    return df.join(r, key, "left").fillna(fill)


def first_image(images: DataFrame, key: str) -> DataFrame:
    return images.groupBy(key).agg(F.min("img").alias("img"))


def flag(df: DataFrame, pairs: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1 when (keys) occurs in ``pairs``, else 0."""
    hit = pairs.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return df.join(hit, list(keys), "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def salted_join(big: DataFrame, small: DataFrame, keys, spread: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi join that splits a hot key of ``big`` over ``salts`` tasks by repeating ``small`` that often."""
    keys = names(keys)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


RUN_ROWS = 256  # rows of a run: few enough for a page of a file to hold it many times
RUNS_DEALT = 64  # runs that are numbered together


def deal_in_runs(rows: DataFrame, key: str, spread: str, run: int = RUN_ROWS) -> DataFrame:
    """Number the runs of at most ``run`` rows of each key: ``_lot`` and ``_run``. Rows are dealt over lots by a hash of ``spread``, so that no hot
    key is numbered by one task. Null keys go."""
    lots = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(run * RUNS_DEALT)).alias("_lots"))
    dealt = rows.join(lots, key).withColumn("_lot", F.pmod(F.xxhash64(spread), F.col("_lots"))).drop("_lots")
    return dealt.withColumn("_run", F.floor((F.row_number().over(W.partitionBy(key, "_lot").orderBy(spread)) - 1) / F.lit(run)))


def join_in_runs(left: DataFrame, right: DataFrame, key: str, spread: str, run: int = RUN_ROWS) -> DataFrame:
    """Equi join of hot keys on both sides: every ``left`` row comes out once for each run of at most ``run`` of the key's ``right`` rows.

    Neither a hot key nor its result is one task's work, and a task holds one run at a time. In the result a left row stands still while a run
    goes by, and the next left row meets the same run, which columnar files store in a fraction of the rows' size. ``left`` may be a stream.
    """
    dealt = deal_in_runs(right, key, spread, run)
    # another order of the columns, as the shuffle of the heads would be left out where that of the distinct runs serves
    heads = left.join(dealt.select(key, "_lot", "_run").distinct(), key)
    return meet_runs(heads, dealt, ["_run", "_lot", key]).drop("_lot", "_run")


def pack_runs(rows: DataFrame, key: str, spread: str, run: int = RUN_ROWS) -> DataFrame:
    """The runs of :func:`deal_in_runs`, a row for each: the key, ``_lot``, ``_run`` and the array of the run's values of ``spread``, nulls among them."""
    runs = deal_in_runs(rows, key, spread, run).groupBy(key, "_lot", "_run").agg(F.collect_list(F.struct(spread)).alias("_rows"))
    return runs.select(key, "_lot", "_run", F.col(f"_rows.{spread}").alias(spread))


def meet_runs(heads: DataFrame, runs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``heads``, which name a run each, with the rows of their run or the run itself (:func:`pack_runs`), a run after the other."""
    # the number is given, as partitions would be merged by the size of what they hold, not of what comes of it
    heads = heads.repartition(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    # only a merge join lays a run's rows together; the optimizer would drop a sort of its own below a join
    return heads.join(runs.hint("merge"), list(on))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_unset(c: Column | str) -> Column:
    """True for NULL, empty text and zero: the values an absent request field takes."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | (col.cast("string") == "") | (F.coalesce(col.try_cast("double"), F.lit(1.0)) == 0)
