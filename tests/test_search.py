"""Requests that bring their own needle, set, filter, page or cursor, against plain Python."""

import random

from pyspark.sql import functions as F

from courtside.functions import common
from courtside.functions.common import page_requests, seek_requests
from courtside.operators.radius import radius_page, within_radius
from courtside.operators.search import containing, containing_all, search_items


def test_containing(spark):
    r = random.Random(1)
    values = ["".join(r.choice("abAB%_é ") for _ in range(r.randrange(9))) for _ in range(200)] + ["", None]
    needles = ["", "a", "AB", "%", "_", "é", "abab", "zzz", "a" * 40, None, " A", "b%"]
    got = containing(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame([(n,) for n in needles * 2], "n string"), "n")
    want = {(n, v) for n in needles for v in values if n is not None and v is not None and n.lower() in v.lower()}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_search_items_looks_into_all_columns_once(spark):
    items = spark.createDataFrame([(1, "Ann", "Lee"), (2, "Lee", "Lee"), (3, None, "lee"), (4, "Bo", None)], "id int, a string, b string")
    asked = spark.createDataFrame([("lee",), ("O",)], "q string")
    assert sorted((r.q, r.id) for r in search_items(items, ["a", "b"], asked, "q").collect()) == [("O", 4), ("lee", 1), ("lee", 2), ("lee", 3)]


def test_candidates_come_from_the_rarest_gram_only(spark):
    values = spark.createDataFrame([(f"common {i}",) for i in range(500)] + [("common xyz",)], "v string")
    plan = containing(values, "v", spark.createDataFrame([("on xyz",)], "n string"), "n")
    assert [tuple(r) for r in plan.collect()] == [("on xyz", "common xyz")]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_containing_all(spark):
    r = random.Random(2)
    has = {i: {r.randrange(8) for _ in range(r.randrange(6))} for i in range(150)}
    rows = [(i, e) for i, s in has.items() for e in (s or {None})]
    sets = [[], [1], [2, 1, 2], [7, None], [1, 2, 3, 4], [99], [0, 99], None, list(range(8))]
    items = spark.createDataFrame(rows + rows[:20], "i int, e int")
    got = containing_all(items, "i", "e", spark.createDataFrame([(s,) for s in sets + sets], "w array<int>"), "w")
    found = [(None if x.w is None else tuple(x.w), x.i) for x in got.collect()]
    want = {(None if s is None else tuple(s), i) for s in sets for i, e in has.items() if {x for x in s or [] if x is not None} <= e}
    assert len(found) == len(set(found)) and set(found) == want
    assert containing_all(items.limit(0), "i", "e", spark.createDataFrame([([],)], "w array<int>"), "w").count() == 0


def _pages(rows, asked):
    out = []
    for k, page, limit, tag in asked:
        page, limit = page or 1, limit or 10
        mine = sorted(r for r in rows if r[0] == k and k is not None)
        out += [(tag, i + 1, r[1]) for i, r in enumerate(mine) if (page - 1) * limit <= i < page * limit]
    return sorted(out)


def test_page_requests(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_LIMIT_ROWS", 40)  # the sliced form, too
    rows = [(k, v) for k in (1, 2, 3, None) for v in range(90 if k == 1 else 7)]
    asked = [(1, 1, 10, "a"), (1, 3, 20, "b"), (2, None, None, "c"), (2, 2, 5, "d"), (3, 0, 0, "e"), (9, 1, 1, "f"), (None, 1, 1, "g"), (1, 1, 10, "h"), (3, 50, 10, "i")]
    df, req = spark.createDataFrame(rows, "k int, v int"), spark.createDataFrame(asked, "k int, page int, limit int, tag string")
    got = sorted((r.tag, r.position, r.v) for r in page_requests(df, "k", [F.col("v")], req).collect())
    assert got == _pages(rows, asked)
    assert page_requests(df, "k", [F.col("v")], req.limit(0)).count() == 0


def test_small_pages_are_pruned_below_the_shuffle(spark):
    df = spark.range(0, 100_000, 1, 8).selectExpr("id % 3 as k", "id as v")
    req = spark.createDataFrame([(0, 1, 10), (1, 4, 10)], "k long, page int, limit int")
    plan = page_requests(df, "k", [F.col("v")], req)
    assert plan.count() == 20
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_seek_requests(spark):
    rows = [(k, v % 5, v) for k in (1, 2) for v in range(40)]
    asked = [(1, 2, 17, 5, "a"), (1, None, None, 3, "b"), (2, 4, 39, 5, "c"), (2, 0, 35, None, "d"), (1, 2, 17, 9, "e"), (7, None, None, 5, "f")]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    req = spark.createDataFrame(asked, "k int, after_t int, after_v int, limit int, tag string")
    got = sorted((r.tag, r.position, r.t, r.v) for r in seek_requests(df, "k", ["t", "v"], req).collect())
    want = []
    for k, t, v, limit, tag in asked:
        mine = sorted((x[1], x[2]) for x in rows if x[0] == k and (t is None or (x[1], x[2]) > (t, v)))[: limit or 10]
        want += [(tag, i + 1, *x) for i, x in enumerate(mine)]
    assert got == sorted(want)


def test_radius_page_by_class(spark):
    r = random.Random(3)
    items = [(i, 40 + r.random() / 3, -74 + r.random() / 3, c) for i in range(300) for c in {r.choice("xy"), r.choice("yz")}]
    places = [(j, 40 + r.random() / 3, -74 + r.random() / 3, r.choice("xyzw")) for j in range(25)]
    df = spark.createDataFrame(items, "item int, latitude double, longitude double, c string")
    req = spark.createDataFrame(places, "req int, latitude double, longitude double, c string")
    pairs = within_radius(df, req.withColumnRenamed("c", "d"), 9000.0).where("c = d").select("req", "item", "c").collect()
    same = within_radius(df, req, 9000.0, by=["c"]).select("req", "item", "c").collect()
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, same))
    want = {}
    for q, i, c in pairs:
        want.setdefault(q, []).append(i)
    got = {}
    for x in sorted(radius_page(df, req, [F.col("item")], "item", 1, 4, 9000.0, by=["c"]).collect(), key=lambda x: x.position):
        got.setdefault(x.req, []).append(x.item)
    assert got == {q: sorted(i)[:4] for q, i in want.items()}
    every = spark.createDataFrame([(1000 + i, c) for i in range(6) for c in "xw"], "item int, c string")
    more = radius_page(df.limit(0), req, [F.col("item")], "item", 1, 4, 9000.0, extra=every, by=["c"]).collect()
    assert {(x.req, x.item) for x in more} == {(j, 1000 + i) for j, _, _, c in places if c in "xw" for i in range(4)}


def test_chats_of_a_few_readers_equal_their_part_of_all(spark):
    from courtside.operators.chat import chat_list, unread_chats

    chats = spark.createDataFrame([(1, 1, 2, "a"), (2, 2, 1, "a"), (3, 1, 3, "b"), (4, 3, 1, "b"), (5, 2, 3, "c"), (6, 3, 2, "c")], "chat_id int, user_id int, friend_user_id int, room_id string")
    chats = chats.selectExpr("*", "'all' as notification_status", "1 as new_messages")
    messages = spark.createDataFrame([(i, 1 + i % 6, f"2024-01-01 00:{i:02d}:00", f"m{i}") for i in range(20)], "message_id int, chat_id int, time string, content string")
    users = spark.createDataFrame([(u, "n") for u in (1, 2, 3)], "user_id int, first_name string").selectExpr("*", "'l' as last_name", "'p' as profile_picture", "'i' as img", "'s' as socket_id")
    unseen = spark.createDataFrame([(i, 1 + i % 3) for i in range(20)], "message_id int, user_id int")
    for op in (lambda req: unread_chats(unseen, messages, chats, users, req), lambda req: chat_list(chats, messages, users, req)):
        everyone = op(None)
        some = op(2)
        assert sorted(map(str, some.collect())) == sorted(str(r) for r in everyone.select(some.columns).collect() if r["user_id"] == 2)
        assert some.count() > 0


def test_every_user_asks_for_facilities(spark, tmp_path):
    from courtside.plans import catalog

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", [(i, f"Customer#{i}") for i in range(1, 25)], "c_custkey BIGINT, c_name STRING")
    put("supplier", [(3, "Supplier#3")], "s_suppkey BIGINT, s_name STRING")
    put("nation", [(1, "FRANCE")], "n_nationkey INT, n_name STRING")
    put("part", [(i, f"part {i}", "kind", 7, 90.0 + i) for i in range(20)], "p_partkey BIGINT, p_name STRING, p_type STRING, p_size INT, p_retailprice DOUBLE")
    put("orders", [(1, 5)], "o_orderkey BIGINT, o_custkey BIGINT")
    line = spark.createDataFrame([(1, 4, 2.0, "O")], "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_linestatus STRING").withColumn("l_shipdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["r06_filter_facilities_batch"](spark, str(tmp_path)).select("request_id", "facility_id").collect()
    days = ["saturday", "sunday", "monday", "tuesday", "wednesday", "thursday", "friday"]
    has = {p: {n for i, n in enumerate(["Parking", "Showers", "Lockers", "Cafe"]) if p * (i + 1) % 3 != 1} | {n for d, n in enumerate(days) if (p + d) % 4} for p in range(20)}
    wants = lambda u: {0: {"Parking", "Cafe"}, 1: {"Lockers"}, 2: {"Pool"}, 3: set()}[u % 4] | {0: {"monday", "friday"}, 1: {"sunday"}, 2: set()}[u % 3]
    assert sorted(map(tuple, got)) == sorted((u, p) for u in [*range(1, 25), 1_000_003, 2_000_001] for p in range(20) if wants(u) <= has[p])
