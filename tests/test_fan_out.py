"""Feeds and other products of hot keys: result size on disk, whole queues stay out of shuffles, and the results against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from courtside.functions.common import join_in_runs
from courtside.operators import applies as a
from courtside.operators import social as s
from courtside.streaming import flows


def size(folder):
    return sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".parquet"))


def bulk(spark, posts=600, readers=2000):
    new = spark.range(posts).select(F.col("id").alias("post_id"), (F.col("id") % 2).alias("user_id"))
    follows = spark.range(readers * 2).selectExpr("xxhash64(id div 2) % 100000 AS follower_user_id", "id % 2 AS followed_user_id", "'all' AS notification_status")
    return new, follows


def test_fan_out_takes_little_space(spark, tmp_path):
    posts, follows = bulk(spark)
    a.fan_out_posts(posts, follows).write.parquet(str(tmp_path / "o"))
    n = spark.read.parquet(str(tmp_path / "o")).count()
    assert n == 300 * follows.distinct().count() and size(tmp_path / "o") < n / 2


def test_feed_stream_takes_little_space(spark, tmp_path):
    posts, follows = bulk(spark)
    posts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.feed_stream(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in")), follows)
    flows.run_batches(stream, str(tmp_path / "ck"), lambda b, i: b.write.parquet(str(tmp_path / "o"))).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "o")).count()
    assert n == 300 * follows.distinct().count() and size(tmp_path / "o") < n / 2


def test_join_in_runs(spark):
    r = random.Random(5)
    left = [(r.choice([1, 2, 3, None]), i) for i in range(40)] + [(1, 0)] * 2
    right = [(r.choice([1, 1, 1, 2, 4, None]), r.choice([*range(50), None])) for _ in range(300)]
    df = join_in_runs(spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int"), "k", "b", run=3)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in df.select("k", "a", "b").collect()), key=key) == sorted(((k, i, b) for k, i in left for j, b in right if k == j and k is not None), key=key)


def feed_tables(spark, n=90):
    r = random.Random(11)
    at = lambda: None if r.random() < 0.1 else f"2024-01-{1 + r.randrange(9):02d} 00:00:00"
    posts = [(i, r.choice([0, 1, 2, 77]), at(), f"t{i}") for i in range(n)]
    posts += posts[:5] + [(7, 1, at(), "again")]
    readers = [(u, p) for u in range(12) for p in range(n + 5) if r.random() < (0.9 if u < 6 else 0.04)]
    readers += readers[:40] + [(None, p) for p in range(0, n, 3)] + [(3, None)]
    df = spark.createDataFrame([(p, u, t, c) for p, u, t, c in posts], "post_id INT, user_id INT, t STRING, content STRING")
    df = df.select("post_id", "user_id", F.col("t").cast("timestamp_ntz").alias("time"), "content")
    users = spark.createDataFrame([(i, "f", "l", None, "i") for i in range(3)], "user_id INT, first_name STRING, last_name STRING, profile_picture STRING, img STRING")
    empty = spark.createDataFrame([], "user_id INT, post_id INT, comment_id INT, post_img_id INT, img STRING")
    return spark.createDataFrame(readers, "user_id INT, post_id INT"), readers, posts, (df, users, empty, empty, empty)


@pytest.mark.parametrize("page", [1, 2])
def test_feed_in_blocks(spark, monkeypatch, page):
    monkeypatch.setattr(s, "FIRST_BLOCK", 8, raising=False)
    monkeypatch.setattr(s, "BLOCK_STEP", 3, raising=False)
    unseen, readers, posts, args = feed_tables(spark)
    heads = args[0].join(args[1].select("user_id"), "user_id", "left_semi").select("post_id", "time")
    got = s._newest(unseen, heads, page * 6)
    order = lambda p, t: (t is not None, t or "", p)
    want = {}
    for u in {u for u, _ in readers}:
        mine = {p for v, p in readers if v == u}
        want[u] = sorted((order(p, t) for p, w, t, _ in posts if p in mine and w < 3), reverse=True)[: page * 6]
    found = {}
    for x in got.collect():
        found.setdefault(x.user_id, []).append(order(x.post_id, None if x.time is None else str(x.time)))
    assert {u: sorted(v, reverse=True)[: page * 6] for u, v in found.items()} == {u: v for u, v in want.items() if v}
    feed = s.community_feed(unseen, *args, page=page, limit=6)
    assert {x.user_id for x in feed.select("user_id").distinct().collect()} == {u for u, v in want.items() if len(v) > 6 * (page - 1)}


def test_a_feed_meets_the_newest_posts_only(spark):
    posts, follows = bulk(spark, 3000, 50)
    heads = posts.select("post_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, 0, 0, 0, post_id)")).alias("time"))
    made = a.fan_out_posts(posts, follows)
    found = s._newest(made, heads, 10)
    assert found.count() == 10 * follows.select("follower_user_id").distinct().count()
    plan = made.join(heads.limit(5).select("post_id"), "post_id", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    # the semi join lies below the join that makes the rows
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")


def test_consume_feed_shuffles_rows_of_shown_posts_only(spark):
    rows = [(u, p) for u in range(8) for p in range(30)] + [(None, 3), (2, None), (1, 3), (1, 3)]
    shown = [(1, 3), (1, 4), (2, 4), (9, 9), (2, None), (None, 3)]
    unseen, delivered = spark.createDataFrame(rows, "user_id INT, post_id INT"), spark.createDataFrame(shown + shown, "user_id INT, post_id INT")
    key = lambda x: tuple((v is None, v) for v in x)
    got = a.consume_feed(unseen, delivered, delivered_only=True)
    assert sorted(map(tuple, got.select("user_id", "post_id").collect()), key=key) == sorted((x for x in rows if None in x or x not in shown), key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 2 and plan.count("LeftSemi") == 1
    whole = a.consume_feed(unseen, delivered)
    assert {x.user_id for x in whole.collect()} == {None, 0, 3, 4, 5, 6, 7}


def test_facilities_of_many_requests_take_little_space(spark, tmp_path):
    from courtside.operators.discovery import filter_facilities_each

    places = spark.range(200).selectExpr("id AS facility_id", "10D AS hourly_rate", "concat('n', id) AS name", "40D AS latitude", "-74D AS longitude")
    hours = spark.range(200).selectExpr("id AS facility_id", "'monday' AS week_day", "1 AS available")
    amenities = spark.range(200).selectExpr("id AS facility_id", "'Parking' AS name")
    reviews, images = spark.createDataFrame([(1, 4.0)], "facility_id BIGINT, rating DOUBLE"), spark.createDataFrame([(1, "i")], "facility_id BIGINT, img STRING")
    req = spark.range(20_000).selectExpr("xxhash64(id) AS request_id", "array('Parking') AS want_amenities", "CAST(NULL AS ARRAY<STRING>) AS want_days")
    req = req.unionByName(req.limit(1).withColumn("request_id", F.lit(None).cast("bigint")))
    filter_facilities_each(places, reviews, images, amenities, hours, req).write.parquet(str(tmp_path / "o"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == got.distinct().count() == 200 * 20_001 and got.where("request_id IS NULL").count() == 200
    assert size(tmp_path / "o") < 200 * 20_001 * 3


def test_items_that_lack_a_bit_of_a_set_are_dropped_where_they_are_found(spark):
    from courtside.operators.search import containing_all

    items = spark.range(400).selectExpr("id AS i", "explode(array(0L, 1 + id % 40)) AS e")
    out = containing_all(items, "i", "e", spark.createDataFrame([([0, 3],), ([0, 3, 4],), ([0],)], "w array<bigint>"), "w")
    assert sorted((len(x.w), x.i) for x in out.collect()) == sorted([(1, i) for i in range(400)] + [(2, i) for i in range(400) if i % 40 == 2])
    assert "_bits" in out._jdf.queryExecution().optimizedPlan().toString()


def test_facility_cards_are_rounded_before_rows_are_made_of_them(spark):
    from courtside.operators.discovery import filter_facilities_each
    from courtside.plans import catalog

    places = spark.range(3).selectExpr("id AS facility_id", "10D AS hourly_rate", "concat('n', id) AS name", "40D AS latitude", "-74D AS longitude")
    hours = spark.range(3).selectExpr("id AS facility_id", "'monday' AS week_day", "1 AS available")
    reviews, images = spark.createDataFrame([(1, 4.0), (1, 4.0), (1, 5.0)], "facility_id BIGINT, rating DOUBLE"), spark.createDataFrame([(1, "i")], "facility_id BIGINT, img STRING")
    req = spark.createDataFrame([(7, None, ["monday"]), (None, None, ["monday"]), (7, None, ["monday"]), (8, ["Cafe"], None)], "request_id BIGINT, want_amenities ARRAY<STRING>, want_days ARRAY<STRING>")
    got = filter_facilities_each(places, reviews, images, spark.createDataFrame([], "facility_id BIGINT, name STRING"), hours, req, digits=2)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in got.select("request_id", "facility_id", "avg_rating").collect()), key=key) == sorted([(r, f, 4.33 if f == 1 else 0.0) for r in (7, 7, None) for f in range(3)], key=key)
    plan = catalog.QUERIES["r06_filter_facilities_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_asked") < plan.index("round(")


def test_the_log_of_the_feed_stream_has_a_row_for_a_run(spark, tmp_path, monkeypatch):
    from courtside.plans import catalog, stream_plans

    events = [(e, u, f'{{"k": {k}}}') for e, (u, k) in enumerate((u, k) for u in [*range(20, 120), None] for k in (3, 4, 19))]
    df = spark.createDataFrame([(e, u, "signup", p) for e, u, p in events], "event_id BIGINT, user_id BIGINT, event_type STRING, props STRING")
    df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    docs = [*range(60), 3, 3, None]
    spark.createDataFrame([(d, "t") for d in docs], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    logs, drain = [], stream_plans._drain
    monkeypatch.setattr(stream_plans, "_drain", lambda *x: logs.append(drain(*x)) or logs[-1])
    got = catalog.QUERIES["e06_feed_stream"](spark, str(tmp_path)).select("user_id", "post_id").collect()
    first = {}
    for e, u, p in events:
        if u is not None:  # nobody's id differs from an author's
            first.setdefault((u, int(p[6:-1]) % 15), e)
    assert sorted(map(tuple, got)) == sorted((u, d) for (u, w), e in first.items() if e % 4 for d in docs if d is not None and d % 15 == w)
    assert logs[0].count() == 2 * 4 + 2 < len(got) / 50  # posts of authors 3 and 4, each met by one run of followers


def test_packed_runs_hold_all_rows(spark):
    posts = spark.createDataFrame([(i, i % 3) for i in range(12)] + [(0, 0), (99, None)], "post_id INT, user_id INT")
    follows = spark.createDataFrame([(u, w, "all") for u in [*range(50), None] for w in (0, 1, 5)] + [(7, 2, "mute"), (8, 0, "all")], "follower_user_id INT, followed_user_id INT, notification_status STRING")
    key = lambda x: tuple((v is None, v) for v in x)
    rows = lambda df: sorted(map(tuple, df.select("user_id", "post_id").collect()), key=key)
    packed = a.fan_out_posts(posts, follows, run=7, packed=True)
    assert rows(a.unpacked(packed)) == rows(a.fan_out_posts(posts, follows, run=7)) and {len(x.user_ids) for x in packed.collect()} <= set(range(1, 8))


def test_rows_of_a_block_are_shuffled_by_reader_only(spark, monkeypatch):
    unseen, _, _, args = feed_tables(spark)
    plans, put = [], s.written
    monkeypatch.setattr(s, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or put(df, name))
    found = s._newest(unseen.unionByName(unseen), args[0].select("post_id", "time"), 5)
    assert found.groupBy("user_id").count().where("count > 5").count() == 0
    text = dict(plans)["feed-found"]
    assert "WindowGroupLimit" in text and len(re.findall(r"hashpartitioning\([^)]*user_id#", text)) == 1


def test_queues_are_made_of_staged_runs(spark, tmp_path):
    from courtside.sources.fixtures import Marketplace

    events = [(e, u, f'{{"k": {k}}}') for e, (u, k) in enumerate((u, k) for u in [*range(20, 320), None, None] for k in (3, 4, 19, 3))]
    df = spark.createDataFrame([(e, u, "signup", p) for e, u, p in events], "event_id BIGINT, user_id BIGINT, event_type STRING, props STRING")
    df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    docs = [*range(60), 3, 3, None]
    spark.createDataFrame([(d, "t") for d in docs], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    m = Marketplace(spark, str(tmp_path))
    got = m.user_unseen_posts
    first = {}
    for e, u, p in events:
        if u is not None:
            first.setdefault((u, int(p[6:-1]) % 15), e)
    assert sorted(map(tuple, got.collect())) == sorted((u, d) for (u, w), e in first.items() if e % 4 for d in docs if d is not None and d % 15 == w)
    text = got._jdf.queryExecution().executedPlan().toString()
    # a merge join also where runs are few enough to be broadcast, as only it lays the rows of a run together
    assert "event_type" not in text and "SortMergeJoin [_no" in text
