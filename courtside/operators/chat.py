"""Chat lists, messages and presence views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.common import for_keys, ntz, page_by, salted_join
from courtside.operators.filters import authorized, has_prefix


def room_latest(messages, chats, asked: DataFrame | None = None) -> DataFrame:
    """Latest message of every room, or of the rooms in ``asked`` (J10/J11/T04): one pre-aggregated pick per room, then its text.

    Both mirrored chats of a room count; ties on time go to the higher message id.
    """
    rooms = for_keys(chats.select("chat_id", "room_id"), asked, "room_id")
    pick = messages.select("message_id", "chat_id", "time").join(rooms, "chat_id")
    pick = pick.groupBy("room_id").agg(F.max(F.struct("time", "message_id")).alias("m")).select("room_id", "m.message_id", "m.time")
    text = pick.select("room_id", "message_id", F.col("time").alias("last_message_time"))
    return text.join(messages.select("message_id", F.col("content").alias("latest_message_content")), "message_id")


def _face(users: DataFrame, key: str) -> DataFrame:
    return users.select(F.col("user_id").alias(key), "first_name", "last_name", "profile_picture", "img", F.col("socket_id").isNotNull().cast("int").alias("active"))


def unread_chats(unseen_messages, messages, chats, users, req=None) -> DataFrame:
    """Chats with unseen messages per reader: count, room's latest text, sender and whether online."""
    unseen = for_keys(unseen_messages, req, "user_id").select("message_id", "user_id")
    rows = unseen.join(messages.select("message_id", "chat_id", "time"), "message_id")
    rows = rows.groupBy("user_id", "chat_id").agg(F.count(F.lit(1)).alias("no_of_messages"), F.max("time").alias("last_message_time"))
    rows = rows.join(chats.select("chat_id", F.col("user_id").alias("sender_id"), "notification_status", "room_id"), "chat_id")
    rows = rows.join(_face(users, "sender_id"), "sender_id", "left")
    asked = None if req is None else rows  # a few readers: the rooms they have unseen messages in
    return rows.join(room_latest(messages, chats, asked).select("room_id", "latest_message_content"), "room_id", "left")


def chat_list(chats, messages, users, req=None, page=1, limit=10) -> DataFrame:
    """A page of each user's chats, latest message first, with seen and online state."""
    mine = for_keys(chats, req, "user_id").select("user_id", "chat_id", "room_id", "friend_user_id", "notification_status", "new_messages")
    rows = mine.join(room_latest(messages, chats, None if req is None else mine).drop("message_id"), "room_id", "left")
    rows = page_by(rows, "user_id", [F.col("last_message_time").desc_nulls_last(), F.col("chat_id")], page, limit)
    rows = rows.join(_face(users, "friend_user_id"), "friend_user_id", "left")
    seen = F.when(F.col("new_messages") > 0, 0).otherwise(1)
    return rows.withColumn("latest_message_seen_status", seen).withColumnRenamed("new_messages", "no_of_new_messages").drop("room_id")


def room_messages(messages, chats, users, req, start: str, end: str, image_prefix: str) -> DataFrame:
    """Messages of a room for its members, from the start of ``start`` to the end of ``end``."""
    asked, _ = authorized(req.select("user_id", "room_id").distinct(), chats, ["user_id", "room_id"])
    inside = messages.filter((F.col("time") >= ntz(f"{start} 00:00:00")) & (F.col("time") <= ntz(f"{end} 23:59:59")))
    sender = chats.select("chat_id", "room_id", F.col("user_id").alias("sender_id"))
    rows = inside.join(sender, "chat_id").join(users.select(F.col("user_id").alias("sender_id"), "first_name", "last_name"), "sender_id")
    rows = salted_join(has_prefix(rows, "content", image_prefix), asked, "room_id", ["message_id"])
    return rows.select("user_id", "room_id", "message_id", "content", "time", "sender_id", "first_name", "last_name", "is_img")


def contact_presence(chats, users, req=None) -> DataFrame:
    """Chat partners of each user and whether each is online."""
    rows = for_keys(chats, req, "user_id").select("user_id", F.col("friend_user_id").alias("partner_id")).distinct()
    who = users.select(F.col("user_id").alias("partner_id"), "socket_id", F.col("socket_id").isNotNull().cast("int").alias("online"))
    return rows.join(who, "partner_id", "left").fillna({"online": 0})


def message_receiver(chats, users, req=None) -> DataFrame:
    """Receiver of each chat and whether they are online."""
    rows = for_keys(chats, req, "chat_id").select("chat_id", "room_id", F.col("user_id").alias("sender_id"), F.col("friend_user_id").alias("receiver_id"))
    who = users.select(F.col("user_id").alias("receiver_id"), F.col("socket_id").isNotNull().cast("int").alias("online"))
    return rows.join(who, "receiver_id", "left").fillna({"online": 0})


def unread_counters(messages, chats, reads) -> DataFrame:
    """E03 as a batch: messages of the other side after each member's last read of the room."""
    rooms = chats.select("chat_id", "room_id", F.col("user_id").alias("sender_id"), F.col("friend_user_id").alias("user_id"))
    sent = messages.select("message_id", "chat_id", "time").join(rooms, "chat_id")
    last = reads.groupBy("user_id", "room_id").agg(F.max("ts").alias("last_read"))
    left = sent.join(last, ["user_id", "room_id"], "left").filter(F.col("last_read").isNull() | (F.col("time") > F.col("last_read")))
    counts = left.groupBy("user_id", "room_id").agg(F.count(F.lit(1)).alias("unread"))
    return chats.select("user_id", "room_id").distinct().join(counts, ["user_id", "room_id"], "left").fillna({"unread": 0})


