"""Batches on a bucketed snapshot leave what they would leave on the whole, and touch only the buckets of their keys."""

import os
import random

from pyspark.sql import functions as F

from courtside.operators import applies as a
from courtside.sources.buckets import BucketedTable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_equal_the_full_rewrite(spark, tmp_path):
    r = random.Random(1)
    likes = spark.createDataFrame([(u, p) for u in range(40) for p in range(6) if r.random() < 0.6], "user_id long, post_id long")
    actions = spark.createDataFrame([(i, i // 3, r.randrange(45), r.randrange(7), r.choice(["add", "remove"])) for i in range(150)], "event_id long, ts long, user_id long, post_id long, action string")
    table = BucketedTable.create(likes, str(tmp_path / "likes"), "user_id", 8)
    table.apply(0, actions, lambda old, e: a.apply_toggles(old, e, ["user_id", "post_id"]))
    whole = a.apply_toggles(likes, actions, ["user_id", "post_id"])
    assert rows(table.read()) == rows(whole)
    gone = spark.createDataFrame([(1, 3, 1), (2, 3, 99)], "event_id long, user_id long, post_id long")
    whole, bad = a.apply_deletes(whole, gone, ["user_id", "post_id"])
    rejected = table.apply(1, gone, lambda old, e: a.apply_deletes(old, e, ["user_id", "post_id"]))
    assert rows(table.read()) == rows(whole) and rows(rejected) == rows(bad)


def test_only_touched_buckets_are_read_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable.create(spark.range(5000).select("id", (F.col("id") * 2).alias("v")), path, "id", 16)
    before, sizes = files(path), []
    events = spark.createDataFrame([(1, 1, 17, 0)], "event_id long, ts long, id long, v long")

    def change(old, new):
        sizes.append(len(old.inputFiles()))
        return a.apply_updates(old, new, "id", ["v"])

    table.apply(7, events, change)
    after = files(path)
    bucket = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert len(bucket) == 1 and {f: t for f, t in before.items() if os.path.dirname(f) not in bucket} == {f: t for f, t in after.items() if os.path.dirname(f) not in bucket}
    assert sorted(r.v for r in table.read().where("id in (16, 17, 18)").collect()) == [0, 32, 36]
    plan = table.read([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_repeated_batch_is_applied_once_and_emptied_buckets_go(spark, tmp_path):
    table = BucketedTable.create(spark.createDataFrame([(1, 5), (2, 6)], "id long, n long"), str(tmp_path / "t"), "id", 4)
    events = spark.createDataFrame([(1,)], "id long")
    add = lambda old, e: old.join(e.withColumn("hit", F.lit(1)), "id", "left").select("id", (F.col("n") + F.coalesce("hit", F.lit(0))).alias("n"))
    table.apply(0, events, add)
    table.apply(0, events, add)  # repeated
    table.apply(1, events, add)
    assert rows(table.read()) == [(1, 7), (2, 6)]
    table.apply(2, events, lambda old, e: old.join(e, "id", "left_anti"))
    assert rows(table.read()) == [(2, 6)]
    table.apply(3, events.limit(0), lambda old, e: old)
    assert rows(table.read()) == [(2, 6)]
