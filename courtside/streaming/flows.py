"""Message delivery, unread counters, payments, notifications and feeds as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from courtside.functions.common import RUN_ROWS, salted_join
from courtside.operators.applies import fan_out_posts, make_notifications
from courtside.sources.sinks import write_batch


def run_batches(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Drain a stream through ``foreachBatch``; the checkpoint and batch id make a restart safe."""
    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_of(events: DataFrame, states: DataFrame, key: str, value: str, hours: int = 24) -> DataFrame:
    """Every event (``key``, ``ts``, ...) with the ``value`` of the key's last state at or before its time; null before the first.

    ``states`` has the key, ``ts``, ``event_id`` (the larger one counts at equal times) and the value. Both meet in one sorted run per key and
    span of ``hours``, so a busy key is split by time; what a span starts with is carried over from the spans before, of which there
    is one row each. No pairs of events and states are formed.
    """
    span = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(hours * 3_600_000_000))
    own = events.withColumn("_span", span)
    changes = states.select(key, "ts", "event_id", F.col(value).alias("_value"), span.alias("_span"))
    last = changes.groupBy(key, "_span").agg(F.max_by(F.struct("_value"), F.struct("ts", "event_id")).alias("_last"))
    spans = own.select(key, "_span").distinct().join(last, [key, "_span"], "full")
    earlier = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("_held", F.last("_last", ignorenulls=True).over(earlier)).where("_held IS NOT NULL")
    row = F.struct(*events.columns)
    nothing = F.lit(None)
    run = (
        own.select(key, "_span", "ts", F.lit(2).alias("_kind"), nothing.cast("bigint").alias("_id"), nothing.cast(states.schema[value].dataType).alias("_value"), row.alias("_row"))
        .unionByName(changes.select(key, "_span", "ts", F.lit(1).alias("_kind"), F.col("event_id").cast("bigint").alias("_id"), "_value"), allowMissingColumns=True)
        .unionByName(carried.select(key, "_span", F.lit(0).alias("_kind"), F.col("_held._value").alias("_value")), allowMissingColumns=True)
    )
    # the carried state has no time and comes first; at equal times states come before events
    so_far = W.partitionBy(key, "_span").orderBy(F.col("ts").asc_nulls_first(), "_kind", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = F.last(F.when(F.col("_kind") < 2, F.struct("_value")), ignorenulls=True).over(so_far)
    return run.withColumn("_seen", seen).where("_kind = 2").select("_row.*", F.col("_seen._value").alias(value))


def split_delivery(messages: DataFrame, chats: DataFrame, presence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E02 rule: messages of known chats, split into delivered (receiver online when it was sent) and missed.

    ``messages`` has message_id, chat_id, ts, content; ``presence`` every change with user_id, ts, event_id and online. A receiver without
    a change up to then is offline.
    """
    rooms = chats.select("chat_id", "room_id", F.col("user_id").alias("sender_id"), F.col("friend_user_id").alias("receiver_id"))
    rows = as_of(messages.join(rooms, "chat_id"), presence.withColumnRenamed("user_id", "receiver_id"), "receiver_id", "online")
    return rows.filter("online").drop("online"), rows.filter("online IS NULL OR NOT online").drop("online")


def chat_delivery(messages: DataFrame, chats: Callable[[], DataFrame], presence: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Store, deliver or count each message by its receiver's presence at its time; chats and changes are read anew for every micro-batch."""

    def put(batch: DataFrame, batch_id: int) -> None:
        delivered, missed = split_delivery(batch, chats(), presence())
        write_batch(delivered, f"{out}/delivered", batch_id)
        counts = missed.groupBy("receiver_id", "room_id").agg(F.count(F.lit(1)).alias("new_messages"))
        write_batch(counts.withColumnRenamed("receiver_id", "user_id"), f"{out}/missed", batch_id)

    return run_batches(messages, checkpoint, put)


COUNTER = "user_id BIGINT, room_id STRING, unread BIGINT"
MARK = T.StructType([T.StructField("ts_us", T.LongType())])
COUNT = T.StructType([T.StructField("n", T.LongType())])


class UnreadCounter(StatefulProcessor):
    """Unread messages of one member in one room: those newer than the newest read, in whatever order both arrive.

    The state has the newest read and, by time, the messages after it; a read takes away what it covers, so a room holds
    its unread messages only. A message or a read that is older than the newest read changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.read = handle.getValueState("read", MARK)
        self.unread = handle.getValueState("unread", COUNT)
        self.times = handle.getMapState("times", MARK, COUNT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = mark = self.read.get()[0] if self.read.exists() else None
        unread = self.unread.get()[0] if self.unread.exists() else 0
        for chunk in rows:
            ts, is_read = chunk["ts_us"].to_numpy(dtype="int64"), chunk["is_read"].to_numpy(dtype=bool)
            if is_read.any():
                newest = int(ts[is_read].max())
                mark = newest if mark is None else max(mark, newest)
            times, counts = np.unique(ts[~is_read] if mark is None else ts[~is_read & (ts > mark)], return_counts=True)
            for t, n in zip(times.tolist(), counts.tolist(), strict=True):
                held = self.times.getValue((t,))[0] if self.times.containsKey((t,)) else 0
                self.times.updateValue((t,), (held + n,))
                unread += n
        if mark != before:
            covered = [(t, n) for (t,), (n,) in self.times.iterator() if t <= mark]
            for t, n in covered:
                self.times.removeKey((t,))
                unread -= n
            self.read.update((mark,))
        self.unread.update((unread,))
        yield pd.DataFrame({"user_id": [key[0]], "room_id": [key[1]], "unread": [unread]})

    def close(self) -> None:
        pass


def counter_events(messages: DataFrame, reads: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages (for the other member) and reads as one event frame; works on batches and streams."""
    rooms = chats.select("chat_id", "room_id", F.col("friend_user_id").alias("user_id"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    a = messages.select("chat_id", "ts").join(rooms, "chat_id").select("user_id", "room_id", micros.alias("ts_us"), F.lit(False).alias("is_read"))
    return a.unionByName(reads.select("user_id", "room_id", micros.alias("ts_us"), F.lit(True).alias("is_read")))


def unread_counters(events: DataFrame) -> DataFrame:
    """Changed counters per micro-batch (update mode; needs the RocksDB state store)."""
    return events.groupBy("user_id", "room_id").transformWithStateInPandas(UnreadCounter(), COUNTER, "Update", "None")


def unread_counters_batch(events: DataFrame) -> DataFrame:
    """The counters that all events together leave: messages after the newest read."""
    newest = events.groupBy("user_id", "room_id").agg(F.max(F.when(F.col("is_read"), F.col("ts_us"))).alias("_read"))
    later = salted_join(events.where("NOT is_read"), newest.where("_read IS NOT NULL"), ["user_id", "room_id"], ["ts_us"], how="left").where("_read IS NULL OR ts_us > _read")
    counts = later.groupBy("user_id", "room_id").agg(F.count(F.lit(1)).alias("unread"))
    return newest.drop("_read").join(counts, ["user_id", "room_id"], "left").fillna({"unread": 0})


def deduplicated_payments(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """Each webhook event once. Repeats are remembered for ``keep`` after arrival, so the state stays
    bounded and no event is dropped for its own age."""
    arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep)
    return arrived.dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")


def payment_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Log of verified succeeded/canceled events; ``settle_payments`` over the log is the current state."""
    known = events.filter(F.col("type").isin("payment_intent.succeeded", "payment_intent.canceled"))
    return run_batches(deduplicated_payments(known), checkpoint, lambda batch, i: write_batch(batch.drop("note"), out, i))


def notification_stream(actions: DataFrame, owners: DataFrame, actors: DataFrame) -> DataFrame:
    """Like and comment actions become notifications of the post's owner (stream-static joins, W11)."""
    target = owners.select(F.col("post_id").cast("string").alias("object_id"), F.col("user_id").alias("receiver_id"))
    return make_notifications(actions.join(target, "object_id"), actors)


def feed_stream(posts: DataFrame, follows: DataFrame, run: int = RUN_ROWS, packed: bool = False) -> DataFrame:
    """One unseen row per arriving post and follower who wants all posts; ``packed``: see :func:`fan_out_posts`, for logs that are written and read."""
    return fan_out_posts(posts, follows, run, packed)
