"""Registered streams: events derived from whole tables are staged in the shared folder, drained in several micro-batches, and the result read back.

Events are dealt over the micro-batches by a hash, so every batch brings events that are older than some of the batches before.
"""

from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions.store import new_path
from courtside.operators import applies as a
from courtside.plans.apply_plans import PAID, PAY, PAY_ROWS
from courtside.plans.registry import query
from courtside.sources.payloads import read_payment_events, read_socket_events
from courtside.streaming import flows, presence

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BATCHES = 5
PARTS = 8  # partitions of the state of these small streams


def _stage(df, name):
    """Write events as a stream source of BATCHES files and open it, a file per micro-batch."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.repartition(BATCHES, F.xxhash64(*df.columns)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stage_json(df, name):
    path = new_path(df.sparkSession, name)
    df.repartition(BATCHES, F.xxhash64(*df.columns)).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


def _drain(stream, name, mode="append"):
    """Run a stream to its end into a change log and return the log, with the number of the micro-batch."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    q = flows.run_batches(stream, new_path(spark, f"{name}-ck"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), mode)
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])).option("basePath", out).parquet(out)


@contextmanager
def _rocks(spark):
    """The state store that processors with state of their own need, in PARTS partitions: their number is fixed for a stream's life."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(PARTS)}
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


STATE = """SELECT user_id, arg_max(event = 'connect_user', (ts, event_id)) AS online, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id
FROM socket_events WHERE event <> 'send_message' GROUP BY 1"""


@query("e01_presence", STATE)
def _(m):
    return presence.snapshot(_drain(presence.presence(_stage(m.socket_events, "sockets")), "presence", "update").drop("batch_id"), ["user_id"])


# Users connect on a socket of their own for each connection; sockets are lost later, some of them after the user has connected anew.
SOCKETS = """SELECT event_id, CASE event_type WHEN 'signup' THEN 'connect_user' WHEN 'error' THEN 'disconnect_user' ELSE 'disconnect' END AS event, ts,
  CASE WHEN event_type IN ('signup', 'error') THEN user_id END AS user_id,
  CASE event_type WHEN 'signup' THEN 's' || CAST(event_id AS STRING) WHEN 'purchase' THEN 's' || CAST(event_id - 1 - event_id % 4 AS STRING) END AS socket_id
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')"""


@query("e01_presence_sockets", f"""
WITH k AS ({SOCKETS}), u AS (SELECT user_id, arg_max(event, (ts, event_id)) AS event, max(ts) AS ts, arg_max(socket_id, (ts, event_id)) AS socket_id FROM k WHERE user_id IS NOT NULL GROUP BY 1),
l AS (SELECT u.user_id, max(k.ts) AS lost FROM u JOIN k ON k.event = 'disconnect' AND k.socket_id = u.socket_id AND k.ts >= u.ts WHERE u.event = 'connect_user' GROUP BY 1)
SELECT u.user_id, u.event = 'connect_user' AND l.lost IS NULL AS online, CASE WHEN u.event = 'connect_user' THEN coalesce(l.lost, u.ts) ELSE u.ts END AS ts
FROM u LEFT JOIN l ON l.user_id = u.user_id""")
def _(m):
    path = _stage_json(m.derive(SOCKETS), "socket-json")
    with _rocks(m.spark):
        users = _drain(presence.presence(read_socket_events(m.spark, path, files_per_batch=1).where("user_id IS NOT NULL")), "presence", "update").drop("batch_id")
        sockets = _drain(presence.connections(read_socket_events(m.spark, path, files_per_batch=1), keep="20000 days"), "connections", "update").drop("batch_id")
    return presence.presence_by_socket(users, sockets)


@query("s05_read_socket_events", f"SELECT event_id, event, ts, user_id, socket_id FROM ({SOCKETS})")
def _(m):
    events = m.derive(SOCKETS)
    noise = events.withColumn("event", F.lit("unknown"))
    read = read_socket_events(m.spark, _stage_json(events.union(noise), "socket-json"), files_per_batch=1)
    return _drain(read, "socket-events").select("event_id", "event", "ts", "user_id", "socket_id")


@query("e01_presence_notices", f"""
SELECT c.friend_user_id AS partner_id, s.user_id, CASE WHEN s.online THEN 'user_active' ELSE 'user_inactive' END AS event, s.ts
FROM ({STATE}) s JOIN (SELECT DISTINCT user_id, friend_user_id FROM chats) c ON c.user_id = s.user_id""")
def _(m):
    changed = _drain(presence.presence(_stage(m.socket_events, "sockets")), "presence", "update").drop("batch_id")
    return presence.presence_notices(presence.snapshot(changed, ["user_id"]), m.chats)


SENT = "SELECT message_id, chat_id, time AS ts, content FROM messages"
# Receivers come and go by the minute while messages are sent: every third user leaves and comes back once in between.
MOVES = """SELECT user_id * 4 + k AS event_id, CASE k WHEN 1 THEN 'disconnect_user' ELSE 'connect_user' END AS event,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(k * (user_id % 97) * 60 AS INT) * INTERVAL '1' MINUTE AS ts, user_id
  FROM users CROSS JOIN (VALUES (0),(1),(2)) AS x(k) WHERE user_id % 4 <> 3 AND (k = 0 OR user_id % 3 = 0)"""
SENT_TO = f"""SELECT m.message_id, m.chat_id, m.ts, m.content, c.room_id, c.user_id AS sender_id, c.friend_user_id AS receiver_id
  FROM ({SENT}) m JOIN chats c ON c.chat_id = m.chat_id"""
SEEN_AT = f"""t AS (SELECT user_id, ts, arg_max(event = 'connect_user', event_id) AS online FROM ({MOVES}) GROUP BY 1, 2),
a AS (SELECT s.*, t.online FROM ({SENT_TO}) s ASOF LEFT JOIN t ON t.user_id = s.receiver_id AND s.ts >= t.ts)"""


def _deliver(m, part):
    spark = m.spark
    moves = presence.transitions(m.derive(MOVES))
    out = new_path(spark, "delivery")
    flows.chat_delivery(_stage(m.derive(SENT), "messages"), lambda: m.chats, lambda: moves, out, new_path(spark, "delivery-ck")).awaitTermination()
    return spark.read.parquet(f"{out}/{part}").drop("batch_id")


@query("e02_delivered", f"WITH {SEEN_AT} SELECT message_id, chat_id, ts, content, room_id, sender_id, receiver_id FROM a WHERE online")
def _(m):
    return _deliver(m, "delivered")


@query("e02_missed", f"WITH {SEEN_AT} SELECT receiver_id AS user_id, room_id, count(*) AS new_messages FROM a WHERE NOT coalesce(online, false) GROUP BY 1, 2")
def _(m):
    return _deliver(m, "missed").groupBy("user_id", "room_id").agg(F.sum("new_messages").alias("new_messages"))


# Members read a room when they write in it, most of the times.
READ = "SELECT c.user_id AS user_id, c.room_id AS room_id, m.time AS ts FROM messages m JOIN chats c ON c.chat_id = m.chat_id WHERE m.message_id % 3 <> 0"

UNREAD = f"""
WITH r AS (SELECT user_id, room_id, max(ts) AS t FROM ({READ}) GROUP BY 1, 2), e AS (
  SELECT c.friend_user_id AS user_id, c.room_id, m.time AS ts FROM messages m JOIN chats c ON c.chat_id = m.chat_id)
SELECT k.user_id, k.room_id, (SELECT count(*) FROM e WHERE e.user_id = k.user_id AND e.room_id = k.room_id AND (r.t IS NULL OR e.ts > r.t)) AS unread
FROM (SELECT user_id, room_id FROM e UNION SELECT user_id, room_id FROM r) k LEFT JOIN r ON r.user_id = k.user_id AND r.room_id = k.room_id"""


@query("e03_unread_counters", UNREAD)
def _(m):
    with _rocks(m.spark):
        log = _drain(flows.unread_counters(_stage(flows.counter_events(m.derive(SENT), m.derive(READ), m.chats), "counters")), "unread", "update")
    return log.groupBy("user_id", "room_id").agg(F.max_by("unread", "batch_id").alias("unread"))


@query("e03_unread_counters_batch", UNREAD)
def _(m):
    return flows.unread_counters_batch(flows.counter_events(m.derive(SENT), m.derive(READ), m.chats))


def _webhooks(m):
    """Payment events as webhook JSON, every event delivered twice."""
    ev = m.derive(PAY).withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1))))
    body = F.struct(F.col("type"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created"),
                    F.struct(F.struct(F.col("transaction_id").alias("id"), "description").alias("object")).alias("data"))
    return read_payment_events(m.spark, _stage_json(ev.select(body.alias("b"), "_again").select("b.*", "_again"), "webhooks"), files_per_batch=1)


@query("e04_payment_stream", f"WITH {PAID} " + PAY_ROWS.format(t="payments", b="books", k="book_id"))
def _(m):
    out = new_path(m.spark, "payments")
    flows.payment_stream(_webhooks(m), out, new_path(m.spark, "payments-ck")).awaitTermination()
    log = m.spark.read.parquet(out).withColumn("event_id", F.col("event_id").cast("bigint"))
    return a.settle_payments(m.payments, m.payments_facility, m.books, m.book_facilities, m.users, m.facilities, log)["payments"]


ACTIONS = """SELECT event_id, 'like' AS event_type, ts, user_id AS actor_id, CAST(post_id AS STRING) AS object_id, CAST(NULL AS STRING) AS content FROM like_actions WHERE action = 'add'
UNION ALL SELECT comment_id, 'comment', time, user_id, CAST(post_id AS STRING), content FROM comments"""


@query("e05_notification_stream", f"""
SELECT e.event_id, e.event_type, p.user_id, CASE event_type WHEN 'like' THEN 'New like' ELSE 'New comment' END AS title,
  CASE event_type WHEN 'like' THEN u.first_name || ' ' || u.last_name || ' liked your post' ELSE e.content END AS content, e.ts AS time, 'no' AS read_status,
  '/api/user/post/' || object_id || '?page=1&limit=10' AS redirect
FROM ({ACTIONS}) e JOIN posts p ON CAST(p.post_id AS VARCHAR) = e.object_id JOIN users u ON u.user_id = e.actor_id""")
def _(m):
    from courtside.sources.sinks import emit_notifications

    stream = flows.notification_stream(_stage(m.derive(ACTIONS), "actions"), m.posts, m.users)
    out = new_path(m.spark, "notifications")
    emit_notifications(stream, out, new_path(m.spark, "notifications-ck")).awaitTermination()
    return m.spark.read.parquet(out).select(*stream.columns)


@query("e06_feed_stream", "SELECT user_id, post_id FROM user_unseen_posts")
def _(m):
    # the log has an array for each post and run of followers: its rows are written once, when they are read, and not twice
    log = _drain(flows.feed_stream(_stage(m.posts.select("post_id", "user_id"), "posts"), m.follows, packed=True), "feed")
    return a.unpacked(log)


# members join a room when they write in it, and leave it with every message of the other side
ROOM_EVENTS = """SELECT m.message_id * 2 AS event_id, m.time AS ts, c.user_id AS user_id, 'join_chat' AS event, c.friend_user_id AS friend_user_id, CAST(NULL AS STRING) AS room_id FROM messages m JOIN chats c ON c.chat_id = m.chat_id
UNION ALL SELECT m.message_id * 2 + 1, m.time, c.friend_user_id, 'leave_chat', CAST(NULL AS BIGINT), c.room_id FROM messages m JOIN chats c ON c.chat_id = m.chat_id"""


@query("e07_room_membership", f"""
WITH j AS (SELECT e.event_id, e.ts, e.user_id, true AS joined, c.room_id FROM ({ROOM_EVENTS}) e JOIN chats c ON c.user_id = e.user_id AND c.friend_user_id = e.friend_user_id WHERE event = 'join_chat'
  UNION ALL SELECT event_id, ts, user_id, false, room_id FROM ({ROOM_EVENTS}) e WHERE event = 'leave_chat' AND (user_id, room_id) IN (SELECT user_id, room_id FROM chats))
SELECT user_id, room_id, arg_max(joined, (ts, event_id)) AS joined, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM j GROUP BY 1, 2""")
def _(m):
    log = _drain(presence.room_membership(_stage(m.derive(ROOM_EVENTS), "rooms"), m.chats), "membership", "update").drop("batch_id")
    return presence.snapshot(log, ["user_id", "room_id"])


