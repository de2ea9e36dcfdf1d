"""Batch applies against one-at-a-time simulations and apply-twice properties."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import applies as a
from courtside.operators import booking as b
from courtside.operators import quality as q
from courtside.operators import social as s

NTZ = "TIMESTAMP_NTZ"


def ts(i):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_unique_pairs_apply_twice_equals_once(spark):
    rng = random.Random(1)
    snap = spark.createDataFrame([(u, u) for u in range(6)], "user_id INT, post_id INT")
    ev = spark.createDataFrame([(i, ts(i), rng.randrange(6), rng.randrange(6)) for i in range(80)], "event_id INT, ts TIMESTAMP_NTZ, user_id INT, post_id INT")
    once, rejected = a.apply_unique_pairs(snap, ev, ["user_id", "post_id"])
    twice, again = a.apply_unique_pairs(once, ev, ["user_id", "post_id"])
    assert rows(once) == rows(twice) and again.count() == 80
    assert once.count() - 6 + rejected.count() == 80
    assert {r.reason for r in rejected.collect()} == {"exists", "repeated"}


def test_review_rules(spark):
    snap = spark.createDataFrame([(1, 1, 5.0, "old")], "user_id INT, facility_id INT, rating DOUBLE, content STRING")
    ev = spark.createDataFrame([(1, ts(1), 1, 1, 4.0, "again"), (2, ts(3), 2, 1, 3.0, "late"), (3, ts(2), 2, 1, 2.0, "early"), (4, ts(1), 3, 1, 0.0, "x"), (5, ts(1), 3, 1, 2.0, "")],
                               "event_id INT, ts TIMESTAMP_NTZ, user_id INT, facility_id INT, rating DOUBLE, content STRING")
    new, bad = a.apply_reviews(snap, ev, "facility_id")
    assert rows(new, "user_id", "content") == [(1, "old"), (2, "early")]
    assert rows(bad, "event_id", "reason") == [(1, "exists"), (2, "repeated"), (4, "missing_rating"), (5, "missing_content")]


def test_toggles_equal_sequential(spark):
    rng = random.Random(2)
    snap = {(u, p) for u in range(4) for p in range(2)}
    events = [(i, ts(rng.randrange(40)), rng.randrange(5), rng.randrange(4), rng.choice(["add", "remove"])) for i in range(200)]
    want = set(snap)
    for _, _, u, p, act in sorted(events, key=lambda e: (e[1], e[0])):
        (want.add if act == "add" else want.discard)((u, p))
    got = a.apply_toggles(spark.createDataFrame(sorted(snap), "user_id INT, post_id INT"),
                          spark.createDataFrame(events, "event_id INT, ts TIMESTAMP_NTZ, user_id INT, post_id INT, action STRING"), ["user_id", "post_id"])
    assert rows(got) == sorted(want)


def test_updates_keep_old_values_and_owners(spark):
    snap = spark.createDataFrame([(1, 7, "a", 1.0), (2, 8, "b", 2.0)], "id INT, owner INT, name STRING, rate DOUBLE")
    ev = spark.createDataFrame([(1, ts(1), 1, 7, "x", 9.0), (2, ts(2), 1, 7, "y", None), (3, ts(3), 2, 7, "steal", 0.0)], "event_id INT, ts TIMESTAMP_NTZ, id INT, owner INT, name STRING, rate DOUBLE")
    new, bad = a.apply_updates(snap, ev, "id", ["name", "rate"], owner="owner")
    assert rows(new) == [(1, 7, "y", 1.0), (2, 8, "b", 2.0)]
    assert rows(bad, "event_id", "reason") == [(3, "not_owner")]


def test_deletes_need_the_owner(spark):
    snap = spark.createDataFrame([(1, 5), (2, 5)], "user_id INT, facility_id INT")
    left, bad = a.apply_deletes(snap, spark.createDataFrame([(1, 5), (3, 5)], "user_id INT, facility_id INT"), ["user_id", "facility_id"])
    assert rows(left) == [(2, 5)] and rows(bad) == [(3, 5, "absent")]


def test_replace_children_takes_the_newest_batch(spark):
    snap = spark.createDataFrame([(1, "monday"), (2, "monday")], "trainer_id INT, week_day STRING")
    ev = spark.createDataFrame([(1, ts(1), 10, "friday"), (1, ts(2), 11, "sunday"), (1, ts(2), 11, "tuesday")], "trainer_id INT, ts TIMESTAMP_NTZ, batch_id INT, week_day STRING")
    assert rows(a.replace_children(snap, ev, "trainer_id")) == [(1, "sunday"), (1, "tuesday"), (2, "monday")]


def test_chats_are_mirrored_and_made_once(spark):
    users = spark.range(10).withColumnRenamed("id", "user_id")
    chats = spark.createDataFrame([(1, 2), (2, 1)], "user_id BIGINT, friend_user_id BIGINT")
    ev = spark.createDataFrame([(1, ts(1), 3, 4), (2, ts(2), 4, 3), (3, ts(1), 5, 5), (4, ts(1), 2, 1), (5, ts(1), 1, 99)], "event_id INT, ts TIMESTAMP_NTZ, user_id BIGINT, friend_user_id BIGINT")
    new, bad = a.create_chats(chats, ev, users)
    assert rows(new, "user_id", "friend_user_id") == [(3, 4), (4, 3)]
    assert new.select("room_id").distinct().count() == 1
    assert rows(bad, "event_id", "reason") == [(2, "repeated"), (3, "self"), (4, "exists"), (5, "unknown_user")]


def test_feed_on_read_equals_stored_queue(spark):
    posts = spark.createDataFrame([(i, i % 3, ts(i * 7 % 50), f"t{i}") for i in range(60)], "post_id INT, user_id INT, time TIMESTAMP_NTZ, content STRING")
    users = spark.createDataFrame([(i, "f", "l", None, "i") for i in range(9)], "user_id INT, first_name STRING, last_name STRING, profile_picture STRING, img STRING")
    follows = spark.createDataFrame([(i, a_, ["all", "mute"][(i + a_) % 4 == 0]) for i in range(3, 9) for a_ in range(3)], "follower_user_id INT, followed_user_id INT, notification_status STRING")
    empty = spark.createDataFrame([], "user_id INT, post_id INT, comment_id INT, post_img_id INT, img STRING")
    args = (posts, users, empty, empty, empty)
    for page in (1, 2):
        stored = s.community_feed(a.fan_out_posts(posts, follows), *args, page=page, limit=6)
        read = s.feed_on_read(follows, *args, page=page, limit=6)
        assert rows(stored, "user_id", "post_id") == rows(read, "user_id", "post_id")


def hours(spark, key, rng, n):
    days = ["saturday", "sunday", "monday", "tuesday", "wednesday", "thursday", "friday"]
    out = []
    for i in range(n):
        for d in days:
            lo, hi = rng.randrange(7, 14), rng.randrange(12, 24)
            times = (f"{lo:02d}:{rng.choice(['00', '30'])}:00", f"{hi:02d}:{rng.choice(['00', '15'])}:00") if rng.random() > 0.1 else (None, None)
            out.append((i, d, *times, int(rng.random() > 0.2)))
    return out, spark.createDataFrame(out, f"{key} BIGINT, week_day STRING, start_time STRING, end_time STRING, available INT")


@pytest.mark.parametrize("seed", [3, 4])
def test_slots_equal_sequential_booking(spark, seed):
    import datetime

    rng = random.Random(seed)
    fh, dfh = hours(spark, "facility_id", rng, 3)
    th, dth = hours(spark, "trainer_id", rng, 3)
    day0 = datetime.date(2024, 1, 1)
    booked = [(i, rng.randrange(20), rng.randrange(3), rng.randrange(3), day0 + datetime.timedelta(rng.randrange(3)), "10:00:00", "11:00:00") for i in range(12)]
    alone = [(i, rng.randrange(20), rng.randrange(3), day0 + datetime.timedelta(rng.randrange(3)), "10:00:00", "11:00:00") for i in range(8)]
    reqs = [(i, ts(rng.randrange(100)), rng.randrange(20), rng.randrange(3), rng.choice([None, 0, 1, 2]), day0 + datetime.timedelta(rng.randrange(3))) for i in range(150)]
    books = spark.createDataFrame(booked, "book_id BIGINT, user_id BIGINT, facility_id BIGINT, trainer_id BIGINT, time DATE, start_time STRING, end_time STRING")
    bf = spark.createDataFrame(alone, "book_facility_id BIGINT, user_id BIGINT, facility_id BIGINT, time DATE, start_time STRING, end_time STRING")
    dreq = spark.createDataFrame(reqs, "request_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, facility_id BIGINT, trainer_id BIGINT, date DATE")

    taken = [(u, f_, t, d) for _, u, f_, t, d, _, _ in booked] + [(u, f_, None, d) for _, u, f_, d, _, _ in alone]
    want = []
    for rid, _, u, fac, tr, day in sorted(reqs, key=lambda r: (r[1], r[0])):
        wd = day.strftime("%A").lower()
        h = next(x for x in fh if x[0] == fac and x[1] == wd)
        if not h[4] or h[2] is None:
            continue
        lo, hi = h[2], h[3]
        if tr is not None:
            g = next(x for x in th if x[0] == tr and x[1] == wd)
            if not g[4] or g[2] is None:
                continue
            lo, hi = max(lo, g[2]), min(hi, g[3])
            if not lo < hi:
                continue
        if (u, fac, tr, day) in taken:
            continue
        n = sum(1 for x in taken if x[1:] == (fac, tr, day))
        h0 = int(lo[:2]) + n
        end = f"{h0 + 1:02d}{hi[2:]}"
        if h0 + 1 >= 24 or end > hi:
            continue
        taken.append((u, fac, tr, day))
        want.append((rid, f"{h0:02d}{lo[2:]}", end))
    got, refused = b.allocate_slots(books, bf, dreq, dfh, dth)
    assert rows(got, "request_id", "start_time", "end_time") == sorted(want)
    assert refused.count() == len(reqs) - len(want)


def test_payments_equal_sequential(spark):
    rng = random.Random(5)
    n = 30
    pay = [(i, 100, "usd", rng.choice(["pending", "success"]), None) for i in range(n)]
    book = [(i, i, 1, 1, ts(0).date(), "09:00:00", "10:00:00") for i in range(n) if i % 7]
    ev = []
    for i in range(120):
        bid = rng.randrange(n + 3)
        ev.append((i, ts(rng.randrange(50)), f"tx{i}", rng.choice(["payment_intent.succeeded", "payment_intent.canceled", "other"]), '{"user_id":1,"facility_id":1,"trainer_id":1,"book_id":%d}' % bid))
    state = {p[0]: [p[3], p[4]] for p in pay}
    left, sessions = {x[0] for x in book}, set()
    for _, _, tx, kind, note in sorted(ev, key=lambda e: (e[1], e[0])):
        bid = int(note.split('"book_id":')[1].rstrip("}"))
        if kind.endswith("succeeded") and state.get(bid, [None])[0] == "pending":
            state[bid] = ["success", tx]
            if bid in left:
                sessions.add(bid)
        elif kind.endswith("canceled") and bid in state and bid in left:
            del state[bid]
            left.discard(bid)
    dpay = spark.createDataFrame(pay, "book_id BIGINT, total_amount BIGINT, currency STRING, status STRING, transaction_id STRING")
    dbook = spark.createDataFrame(book, "book_id BIGINT, user_id BIGINT, facility_id BIGINT, trainer_id BIGINT, time DATE, start_time STRING, end_time STRING")
    dbf = spark.createDataFrame([], "book_facility_id BIGINT, user_id BIGINT, facility_id BIGINT, time DATE, start_time STRING, end_time STRING")
    users = spark.createDataFrame([(i, "n") for i in range(n)], "user_id BIGINT, first_name STRING")
    fac = spark.createDataFrame([(1, "hall")], "facility_id BIGINT, name STRING")
    dev = spark.createDataFrame(ev, "event_id BIGINT, ts TIMESTAMP_NTZ, transaction_id STRING, type STRING, description STRING")
    out = a.settle_payments(dpay, dpay.limit(0), dbook, dbf, users, fac, dev)
    assert rows(out["payments"], "book_id", "status", "transaction_id") == sorted((k, *v) for k, v in state.items())
    assert rows(out["books"], "book_id") == [(k,) for k in sorted(left)]
    assert rows(out["sessions"], "book_id") == [(k,) for k in sorted(sessions)]


def test_ids_are_dense_in_order(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("o"), "id")
    got = [tuple(r) for r in a.assign_ids(df, [F.col("o"), F.col("id")], 11).orderBy("o", "id").select("id").collect()]
    ids = [r.n for r in a.assign_ids(df, [F.col("o"), F.col("id")], 11, "n").orderBy("o", "id").collect()]
    assert ids == list(range(11, 5011)) and len(got) == 5000


def test_cascade_follows_chains(spark):
    t = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id INT"),
        "posts": spark.createDataFrame([(10, 1), (20, 2)], "post_id INT, user_id INT"),
        "comments": spark.createDataFrame([(100, 2, 10), (200, 2, 20), (300, 1, 20)], "comment_id INT, user_id INT, post_id INT"),
        "comment_likes": spark.createDataFrame([(1, 2, 100), (2, 2, 200), (3, 2, 300), (4, 1, 200)], "comment_like_id INT, user_id INT, comment_id INT"),
    }
    left, refused = q.cascade_delete(t, "users", spark.createDataFrame([(1,)], "user_id INT"))
    assert refused.count() == 0
    assert {k: [r[0] for r in v.collect()] for k, v in left.items()} == {"users": [2], "posts": [20], "comments": [200], "comment_likes": [2]}


def test_keys_that_are_referred_to_without_cascade_are_refused(spark):
    t = {
        "users": spark.createDataFrame([(i,) for i in range(1, 6)], "user_id INT"),
        "trainers": spark.createDataFrame([(7, 3)], "trainer_id INT, user_id INT"),
        "books": spark.createDataFrame([(10, 1, None), (20, 2, 7), (30, 4, None)], "book_id INT, user_id INT, trainer_id INT"),
        "payments": spark.createDataFrame([(20, 5)], "book_id INT, total_amount INT"),
        "chats": spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 4, 5)], "chat_id INT, user_id INT, friend_user_id INT"),
        "messages": spark.createDataFrame([(100, 1), (200, 2), (300, 3)], "message_id INT, chat_id INT"),
    }
    # 2 booked and 3 trains what is paid for; the chat of 1 and 2 goes with 1, that of 2 and 3 stays
    left, refused = q.cascade_delete(t, "users", spark.createDataFrame([(1,), (2,), (3,), (99,)], "user_id INT"))
    assert rows(refused, "user_id") == [(2,), (3,)]
    assert {k: sorted(r[0] for r in v.collect()) for k, v in left.items()} == {"users": [2, 3, 4, 5], "trainers": [7], "books": [20, 30], "payments": [20], "chats": [2, 3], "messages": [200, 300]}
    without = {k: v for k, v in t.items() if k != "payments"}
    left, refused = q.cascade_delete(without, "users", spark.createDataFrame([(2,), (3,)], "user_id INT"))
    assert refused.count() == 0 and rows(left["books"], "book_id") == [(10,), (30,)] and rows(left["messages"], "message_id") == [(300,)]


def test_audit_reads_every_table_once(spark, tmp_path):
    from courtside.sources.schemas import schemas

    from pyspark.sql.types import StructField, StructType

    tables, shapes = {}, {n: StructType([StructField(f.name, f.dataType) for f in s.fields]) for n, s in schemas().items()}
    for name, schema in shapes.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.schema(schema).parquet(f"{tmp_path}/{name}")
    fill = {"users": [{"user_id": 1, "email": "a"}, {"user_id": 2, "email": "a"}], "posts": [{"post_id": 1, "user_id": 1}, {"post_id": 2, "user_id": 9}, {"post_id": 3, "user_id": 9}, {"post_id": 4, "user_id": None}]}
    for name, records in fill.items():
        schema = shapes[name]
        spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.schema(schema).parquet(f"{tmp_path}/{name}")
    found = q.audit_integrity(tables)
    assert rows(found) == [("posts", "foreign_key", "user_id", "9", 2), ("users", "unique", "email", "a", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    read = sum(1 for line in plan.splitlines() if "Relation [" in line)
    audited = {t for k in q.FOREIGN_KEYS for t in (k[0], k[2])} | {t for t, _ in q.UNIQUE_KEYS}
    assert read == len(audited & set(tables))


def test_validation_names_every_failed_rule(spark):
    df = spark.createDataFrame([("monday", "09:00:00", "10:00:00", 1), ("funday", "9", "08:00:00", 3), ("friday", None, None, 1), ("friday", None, None, 0), ("friday", "09:00:00", "10:00:00", 0)],
                               "week_day STRING, start_time STRING, end_time STRING, available INT")
    ok, bad = q.validate(df, q.hours_rules())
    assert ok.count() == 2
    assert sorted(r.failed for r in bad.collect()) == [["structure"], ["structure"], ["week_day", "time_format", "time_order", "available"]]
