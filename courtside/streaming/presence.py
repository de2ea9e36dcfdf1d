"""Presence and room membership as streaming aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courtside.functions.common import salted_join

ONLINE = {"connect_user": True, "disconnect_user": False}
JOINED = {"join_chat": True, "leave_chat": False}


def _state(mapping: dict[str, bool]):
    out = F.lit(None).cast("boolean")
    for event, value in mapping.items():
        out = F.when(F.col("event") == event, F.lit(value)).otherwise(out)
    return out


def _last(events: DataFrame, keys: list[str], mapping: dict[str, bool], out: str) -> DataFrame:
    """Newest event per key by (ts, event_id): older arrivals change nothing, and a busy key is combined
    map-side before it reaches its state."""
    rows = events.filter(F.col("event").isin(*mapping)).withColumn(out, _state(mapping))
    last = rows.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", out)).alias("_last"))
    return last.select(*keys, "_last.ts", "_last.event_id", f"_last.{out}")


def presence(events: DataFrame) -> DataFrame:
    """Whether each user is online and since which event. Batch or stream (update mode)."""
    return _last(events, ["user_id"], ONLINE, "online")


def transitions(events: DataFrame) -> DataFrame:
    """Every change of presence: user_id, ts, event_id, online."""
    return events.filter(F.col("event").isin(*ONLINE) & F.col("user_id").isNotNull()).select("user_id", "ts", "event_id", _state(ONLINE).alias("online"))


SOCKET = "socket_id STRING, user_id BIGINT, opened_us BIGINT, opened_id BIGINT, lost_us BIGINT"
LOTS = 1024  # lots that sockets are dealt into by a hash: few enough for a call to be worth its round trips, and a lot to stay small
LOT = T.StructType([T.StructField("sockets", T.BinaryType())])
HELD = ["socket_id", "user_id", "opened_us", "opened_id", "lost_us", "until_ms"]
NEVER = np.iinfo("int64").min


def _pack(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held[HELD], preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


class Sockets(StatefulProcessor):
    """Who opened each socket of a lot, and when it was lost; both may arrive in any order and more than once. A socket is forgotten
    when the watermark has passed its last event; the lot's timer is set for the first of them.

    A lot is one value of the state, so a micro-batch costs a few round trips for each lot, not for each socket.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lot = handle.getValueState("lot", LOT)

    def _put(self, held: pd.DataFrame) -> None:
        self.lot.update((_pack(held),))
        self.handle.registerTimer(int(held["until_ms"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        at, lost = new["ts_us"].to_numpy("int64"), new["is_loss"].to_numpy(bool)
        opened = [np.where(lost, NEVER, new[c].to_numpy("int64")) for c in ("user_id", "ts_us", "event_id")]
        new = pd.DataFrame(dict(zip(HELD, [new["socket_id"], *opened, np.where(lost, at, NEVER), NEVER], strict=True)))
        both = pd.concat([_unpack(bytes(self.lot.get()[0])), new], ignore_index=True) if self.lot.exists() else new
        # the newest opening, the first that came of equal ones, and the latest loss
        order = np.lexsort((-np.arange(len(both)), both["opened_id"], both["opened_us"]))
        held = both.iloc[order].drop_duplicates("socket_id", keep="last")
        held = held.assign(lost_us=held["socket_id"].map(both.groupby("socket_id")["lost_us"].max()))
        changed = held["socket_id"].isin(new["socket_id"])
        until = np.maximum(held[["opened_us", "lost_us"]].max(axis=1) // 1000, timerValues.getCurrentWatermarkInMs()) + 1
        held = held.assign(until_ms=held["until_ms"].where(~changed, until))
        for (timer,) in [(t[0] if isinstance(t, tuple) else t,) for t in self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self._put(held)
        out = held[changed & (held["opened_us"] > NEVER)]
        yield out.assign(lost_us=out["lost_us"].astype("Int64").where(out["lost_us"] >= out["opened_us"])).drop(columns="until_ms")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _unpack(bytes(self.lot.get()[0]))
        held = held[held["until_ms"] > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)]
        if len(held):
            self._put(held)
        else:
            self.lot.clear()
        yield held[:0].drop(columns="until_ms")

    def close(self) -> None:
        pass


def connections(events: DataFrame, keep: str = "2 days", lots: int = LOTS) -> DataFrame:
    """Changed sockets per micro-batch (update mode; needs the RocksDB state store).

    A connection is opened by ``connect_user`` and lost by a ``disconnect`` that names its socket only. A socket is kept until all
    events have moved on by ``keep``, and events that are later than that are dropped, so the state holds recent sockets only. An event
    without a time comes neither before nor after another and is left out. Sockets are dealt into ``lots`` by a hash, whose number is fixed for a
    stream's life.
    """
    used = events.filter("socket_id IS NOT NULL AND ts IS NOT NULL")
    used = used.filter((F.col("event") == "connect_user") & F.col("user_id").isNotNull() & F.col("event_id").isNotNull() | (F.col("event") == "disconnect"))
    rows = used.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", keep).withColumn("lot", F.pmod(F.xxhash64("socket_id"), F.lit(lots)))
    rows = rows.select("lot", "socket_id", "at", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("event_id", "user_id")], (F.col("event") == "disconnect").alias("is_loss"))
    return rows.groupBy("lot").transformWithStateInPandas(Sockets(), SOCKET, "Update", "EventTime")


def presence_by_socket(changes: DataFrame, sockets: DataFrame) -> DataFrame:
    """Whether each user is online, from the logs of ``presence`` (user events) and ``connections``.

    A user is online if the last event of the user is a connection whose socket was not lost since. Losing an older socket after a
    reconnection changes nothing. ``ts`` is the time of the user's last event, or of the loss that ended it.
    """
    last = snapshot(changes, ["user_id"])
    # a socket's log only ever adds: the newest opening, and with it the latest loss
    held = sockets.groupBy("socket_id").agg(F.max(F.struct("opened_us", "opened_id", F.coalesce("lost_us", F.lit(-1)).alias("lost_us"), "user_id")).alias("s"))
    lost = held.where("s.lost_us >= 0").select(F.col("s.user_id").alias("user_id"), F.col("s.opened_id").alias("event_id"), F.col("s.lost_us").alias("lost_us"))
    lost = lost.groupBy("user_id", "event_id").agg(F.min("lost_us").alias("_lost"))
    ended = F.col("online") & F.col("_lost").isNotNull()
    out = last.join(lost, ["user_id", "event_id"], "left")
    at = F.timestamp_micros("_lost").cast("timestamp_ntz")
    return out.select("user_id", F.when(ended, F.lit(False)).otherwise(F.col("online")).alias("online"), F.when(ended, at).otherwise(F.col("ts")).alias("ts"))


def presence_notices(changed: DataFrame, chats: DataFrame) -> DataFrame:
    """Tell every chat partner of the changed users (R53): user_active or user_inactive."""
    partners = chats.select("user_id", F.col("friend_user_id").alias("partner_id")).distinct()
    kind = F.when(F.col("online"), "user_active").otherwise("user_inactive")
    return salted_join(partners, changed, "user_id", ["partner_id"], salts=4).select("partner_id", "user_id", kind.alias("event"), "ts")


def room_membership(events: DataFrame, chats: DataFrame) -> DataFrame:
    """Who is in which room. Joining names the friend and needs an existing chat; leaving names the room."""
    rooms = chats.select("user_id", "friend_user_id", F.col("room_id").alias("_room"))
    joins = events.filter(F.col("event") == "join_chat").drop("room_id").join(rooms, ["user_id", "friend_user_id"])
    joins = joins.select("event_id", "ts", "user_id", "event", F.col("_room").alias("room_id"))
    mine = chats.select("user_id", "room_id").distinct()
    leaves = events.filter(F.col("event") == "leave_chat").select("event_id", "ts", "user_id", "event", "room_id").join(mine, ["user_id", "room_id"])
    return _last(joins.unionByName(leaves.select(*joins.columns)), ["user_id", "room_id"], JOINED, "joined")


def snapshot(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current state from the change log of an update-mode stream."""
    cols = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", *[c for c in cols if c not in ("ts", "event_id")])).alias("_s"))
    return last.select(*keys, "_s.*")
