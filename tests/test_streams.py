"""Each stream equals its batch twin, over several micro-batches and across a restart."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from courtside.sources.payloads import read_payment_events, read_requests, read_socket_events
from courtside.sources.sinks import append_rows, emit_notifications, write_page
from courtside.sources.tables import conform, load_tables, save_tables
from courtside.streaming import flows, presence

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def put_json(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in records))
    n = len(os.listdir(folder))
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def sock(i, t, user, event, **kw):
    return {"event_id": i, "ts": f"2024-01-01T00:{t:02d}:00", "user_id": user, "event": event, **kw}


def drain(stream, folder, mode):
    out = f"{folder}/out"
    flows.run_batches(stream, f"{folder}/ck", lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), mode).awaitTermination()
    return out


def test_presence_ignores_older_arrivals_and_survives_restart(spark, tmp_path):
    src, work = str(tmp_path / "src"), str(tmp_path)
    put_json(src, "a.json", [sock(1, 5, 1, "connect_user"), sock(2, 6, 2, "connect_user"), sock(3, 1, 1, "typing"), sock(9, 2, 3, "nonsense")])
    put_json(src, "b.json", [sock(4, 3, 1, "disconnect_user"), sock(5, 9, 2, "disconnect")])
    stream = lambda: presence.presence(read_socket_events(spark, src, files_per_batch=1))
    drain(stream(), work, "update")
    put_json(src, "c.json", [sock(6, 12, 2, "connect_user"), sock(7, 11, 1, "disconnect_user")])
    out = drain(stream(), work, "update")
    log = spark.read.option("recursiveFileLookup", "true").parquet(out)
    batch = presence.presence(read_socket_events(spark, src, stream=False))
    assert rows(presence.snapshot(log, ["user_id"]), "user_id", "online") == rows(batch, "user_id", "online") == [(1, False), (2, True)]


def test_membership_needs_a_chat(spark, tmp_path):
    src = str(tmp_path / "src")
    chats = spark.createDataFrame([(1, 2, "r"), (2, 1, "r")], "user_id BIGINT, friend_user_id BIGINT, room_id STRING")
    put_json(src, "a.json", [sock(1, 1, 1, "join_chat", friend_user_id=2), sock(2, 1, 2, "join_chat", friend_user_id=1), sock(3, 1, 3, "join_chat", friend_user_id=1)])
    put_json(src, "b.json", [sock(4, 2, 1, "leave_chat", room_id="r"), sock(5, 2, 2, "leave_chat", room_id="other")])
    out = drain(presence.room_membership(read_socket_events(spark, src, files_per_batch=1), chats), str(tmp_path), "update")
    log = spark.read.option("recursiveFileLookup", "true").parquet(out)
    assert rows(presence.snapshot(log, ["user_id", "room_id"]), "user_id", "joined") == [(1, False), (2, True)]


EVENT = "user_id BIGINT, room_id STRING, ts_us BIGINT, is_read BOOLEAN"


def counted(spark, tmp_path, batches):
    """Counters left by the stream, and by all events together; a file per micro-batch."""
    src = str(tmp_path / "src")
    for i, batch in enumerate(batches):
        put_json(src, f"{i}.json", [{"user_id": u, "room_id": "r", "ts_us": t, "is_read": read} for u, t, read in batch])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        out = drain(flows.unread_counters(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(src)), str(tmp_path), "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for i in sorted(os.listdir(out), key=lambda n: int(n.split("=")[1])):
        got.update({r.user_id: r.unread for r in spark.read.parquet(f"{out}/{i}").collect()})
    return got, {r.user_id: r.unread for r in flows.unread_counters_batch(spark.read.schema(EVENT).json(src)).collect()}


def test_unread_counters_with_late_messages_and_reads(spark, tmp_path):
    batches = [
        [(1, 3, False), (1, 10, False), (2, 5, True), (3, 1, False), (3, 2, False), (3, 2, False)],
        [(1, 5, True), (2, 3, False), (3, 9, True)],  # a read between earlier messages; a message older than the read
        [(1, 4, False), (2, 7, False), (3, 8, False)],
        [(1, 2, True), (2, 6, True), (3, 11, False), (3, 9, False)],  # a read older than the newest
        [(1, 12, False), (2, 7, False), (3, 4, True)],
    ]
    got, batch = counted(spark, tmp_path, batches)
    assert got == batch == {1: 2, 2: 2, 3: 1}


def test_states_as_of(spark):
    r = random.Random(7)
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    changes = [(u, at(r.randrange(200)), i, bool(r.randrange(2))) for i, u in enumerate([1] * 60 + [2] * 3 + [9])]
    events = [(i, r.choice([1, 1, 2, 3, None]), at(r.randrange(220)), "x") for i in range(300)]
    states = spark.createDataFrame(changes, "user_id int, ts string, event_id bigint, online boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows_ = spark.createDataFrame(events, "id int, user_id int, ts string, _value string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {x.id: x.online for x in flows.as_of(rows_, states, "user_id", "online", hours=24).collect()}
    want = {i: max([(t, e, o) for v, t, e, o in changes if v == u and t <= ts], default=(None, None, None))[2] for i, u, ts, _ in events}
    assert got == want and len(set(want.values())) == 3


def test_delivery_by_presence_at_the_time_of_the_message(spark, tmp_path):
    src = str(tmp_path / "src")
    put_json(src, "a.json", [{"message_id": i, "chat_id": c, "ts": f"2024-01-01T00:{t:02d}:00", "content": "x"} for i, c, t in ((1, 10, 5), (2, 10, 15), (3, 99, 5), (4, 11, 5), (5, 10, 0))])
    stream = spark.readStream.schema("message_id BIGINT, chat_id BIGINT, ts TIMESTAMP_NTZ, content STRING").json(src)
    chats = spark.createDataFrame([(10, "r", 1, 2), (11, "r", 2, 1)], "chat_id BIGINT, room_id STRING, user_id BIGINT, friend_user_id BIGINT")
    moves = spark.createDataFrame([(1, 2, "2024-01-01 00:01:00", True), (2, 2, "2024-01-01 00:10:00", False)], "event_id BIGINT, user_id BIGINT, ts STRING, online BOOLEAN")
    moves = moves.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    flows.chat_delivery(stream, lambda: chats, lambda: moves, str(tmp_path / "o"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o/delivered")), "message_id", "receiver_id") == [(1, 2)]
    assert rows(spark.read.parquet(str(tmp_path / "o/missed")), "user_id", "new_messages") == [(1, 1), (2, 2)]


def test_losing_an_old_socket_changes_nothing(spark, tmp_path):
    src, work = str(tmp_path / "src"), str(tmp_path)
    put_json(src, "a.json", [sock(1, 1, 1, "connect_user", socket_id="a"), sock(2, 1, 2, "connect_user", socket_id="b"), sock(8, 9, None, "disconnect", socket_id="f")])
    put_json(src, "b.json", [sock(3, 3, 1, "connect_user", socket_id="c"), sock(4, 4, None, "disconnect", socket_id="b"), sock(9, 8, 5, "connect_user", socket_id="f")])
    put_json(src, "c.json", [sock(5, 5, None, "disconnect", socket_id="a"), sock(6, 1, 3, "connect_user", socket_id="d"), sock(7, 2, 3, "disconnect_user")])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        out = drain(presence.connections(read_socket_events(spark, src, files_per_batch=1)), work, "update")
        users = drain(presence.presence(read_socket_events(spark, src, files_per_batch=1).where("user_id IS NOT NULL")), f"{work}/users", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    read = lambda p: spark.read.option("recursiveFileLookup", "true").parquet(p)
    got = presence.presence_by_socket(read(users), read(out))
    # 1 came back on c before a was lost; b was lost; 3 left; f was lost after it was opened, though its loss arrived first
    assert {r.user_id: (r.online, r.ts.minute) for r in got.collect()} == {1: (True, 3), 2: (False, 4), 3: (False, 2), 5: (False, 9)}


def test_payment_log_has_each_event_once(spark, tmp_path):
    src = str(tmp_path / "src")

    def hook(i, kind):
        return {"type": f"payment_intent.{kind}", "id": f"e{i}", "created": f"2024-01-0{1 + i % 3}T00:00:00", "data": {"object": {"id": f"pi{i}", "description": json.dumps({"user_id": 1, "facility_id": 2, "trainer_id": None, "book_id": i})}}}

    put_json(src, "a.json", [hook(5, "succeeded"), hook(2, "canceled"), hook(3, "created")])
    put_json(src, "b.json", [hook(5, "succeeded"), hook(1, "succeeded")])
    put_json(src, "c.json", [hook(2, "canceled"), hook(4, "canceled")])
    out = str(tmp_path / "o")
    flows.payment_stream(read_payment_events(spark, src, files_per_batch=1), out, str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == [("e1",), ("e2",), ("e4",), ("e5",)]
    batch = read_payment_events(spark, src, stream=False)
    assert batch.filter("note.trainer_id IS NULL AND note.book_id = 5").count() == 2


def test_notifications_are_written_by_day(spark, tmp_path):
    src = str(tmp_path / "src")
    put_json(src, "a.json", [{"event_id": 1, "event_type": "like", "ts": "2024-01-01T10:00:00", "actor_id": 1, "object_id": "7"}])
    put_json(src, "b.json", [{"event_id": 2, "event_type": "comment", "ts": "2024-01-02T10:00:00", "actor_id": 1, "object_id": "7", "content": "hi"}])
    stream = spark.readStream.schema("event_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ, actor_id BIGINT, object_id STRING, content STRING").option("maxFilesPerTrigger", 1).json(src)
    posts = spark.createDataFrame([(7, 42)], "post_id BIGINT, user_id BIGINT")
    users = spark.createDataFrame([(1, "Ann", "Lee", "athlete")], "user_id BIGINT, first_name STRING, last_name STRING, type STRING")
    out = str(tmp_path / "o")
    emit_notifications(flows.notification_stream(stream, posts, users), out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got, "user_id", "title", "content") == [(42, "New comment", "hi"), (42, "New like", "Ann Lee liked your post")]
    assert {str(r.day) for r in got.select("day").collect()} == {"2024-01-01", "2024-01-02"}


def test_request_bodies_and_tables(spark, tmp_path):
    src = str(tmp_path / "req")
    os.makedirs(src)
    with open(f"{src}/r.json", "w") as f:
        f.write('{"user_id": 1, "page": 2}\n{nope\n{"user_id": "x"}\n')
    good, bad = read_requests(spark, src, "user_id BIGINT, page INT")
    assert rows(good) == [(1, 2)] and bad.count() == 2

    likes = spark.createDataFrame([(1, 1, 1)], "like_id BIGINT, user_id BIGINT, post_id BIGINT")
    folder = str(tmp_path / "db")
    save_tables({"likes": likes}, folder, {"likes": ("post_id", 2)})
    append_rows(likes, f"{folder}/likes.parquet")
    from courtside.sources.schemas import schemas

    assert load_tables(spark, folder, {"likes": schemas()["likes"]})["likes"].count() == 2
    assert len(schemas()) == 47
    assert conform(likes.drop("post_id"), schemas()["likes"]).first().post_id is None


def test_page_envelope_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (2, 6, "c")], "user_id INT, id INT, v STRING")
    write_page(df, str(tmp_path / "p"), "user_id", 1, 10, order="id")
    got = {r.user_id: [(d.id, d.v) for d in r.data] for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got == {1: [(4, "a"), (5, "b")], 2: [(6, "c")]}


def test_checkpoint_folder_comes_from_the_session(spark):
    from courtside.functions.store import settle, shared_dir

    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert settle(spark.range(10)).agg(F.sum("id")).first()[0] == 45


if __name__ == "__main__":
    pytest.main([__file__])
