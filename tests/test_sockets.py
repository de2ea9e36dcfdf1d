"""Sockets in lots: one state for many sockets, with the results of one state for each."""

import json
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from courtside.sources.payloads import read_socket_events
from courtside.streaming import flows, presence

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, START = 3_600_000, 1_704_067_200_000  # milliseconds; 2024-01-01


class Handle:
    """A state of one key, in memory, that counts how often it is called."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter([(t,) for t in self.timers])

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_lot_of_sockets_is_a_few_calls(spark):
    handle, sockets, n = Handle(), presence.Sockets(), 2000
    sockets.init(handle)
    event = lambda i, ts, loss: {"lot": 0, "socket_id": f"s{i}", "ts_us": ts * 1000, "event_id": i, "user_id": -1 if loss else i % 7, "is_loss": loss}
    put = lambda rows, mark: pd.concat(list(sockets.handleInputRows((0,), iter([pd.DataFrame(rows[:700]), pd.DataFrame(rows[700:])]), At(mark))))
    first = put([event(i, 10 + i, False) for i in range(n)], 0)
    assert len(first) == n and first["lost_us"].isna().all()
    second = put([event(i, 5000, True) for i in range(0, n, 2)], 0)
    assert set(second["socket_id"]) == {f"s{i}" for i in range(0, n, 2)} and (second["lost_us"] == 5_000_000).all()
    assert handle.calls < 20 and handle.timers == [12]
    # the watermark passes the sockets up to s1000 that were not lost
    mark = 1012
    gone = pd.concat(list(sockets.handleExpiredTimer((0,), At(mark), At(handle.timers.pop()))))
    assert len(gone) == 0 and handle.timers == [mark]
    third = put([event(i, 6000, True) for i in range(n)], mark)
    assert set(third["socket_id"]) == {f"s{i}" for i in range(n) if i % 2 == 0 or i >= 1001}
    assert handle.calls < 40


def expected(batches, keep, forget=True):
    """The log of one state for each socket, as (batch, socket, user, opened, id, lost)."""
    held, late, mark, newest, log = {}, 0, 0, 0, []
    for k, batch in enumerate(batches):
        touched = set()
        for i, hour, name, user in batch:
            ms = START + hour * HOUR
            newest = max(newest, ms)
            if ms <= late:
                continue
            opened, lost = held.get(name, (None, None, 0))[:2]
            if user is None:
                lost = ms if lost is None else max(lost, ms)
            elif opened is None or (ms, i) > opened[:2]:
                opened = (ms, i, user)
            held[name] = (opened, lost, max(opened[0] if opened else 0, lost or 0, mark) + 1)
            touched.add(name)
        for name in touched:
            opened, lost, _ = held[name]
            if opened:
                log.append((k, name, opened[2], opened[0] * 1000, opened[1], lost * 1000 if lost is not None and lost >= opened[0] else None))
        held = {x: s for x, s in held.items() if not forget or s[2] >= mark}
        # an event is late by the watermark of the batch before
        late, mark = mark, max(mark, newest - keep * HOUR)
    return log


def test_lots_forget_sockets_as_single_states_do(spark, tmp_path):
    r, batches = random.Random(1), []
    for b in range(6):
        batches.append([(50 * b + i, max(0, 15 * b + r.randrange(-12, 15)), f"s{r.randrange(60)}", r.randrange(6) if r.random() < 0.5 else None) for i in range(50)])
    src, out = tmp_path / "src", str(tmp_path / "out")
    os.makedirs(src)
    for b, batch in enumerate(batches):
        rows = [{"event_id": i, "ts": f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00", "socket_id": name} | ({"event": "disconnect"} if user is None else {"event": "connect_user", "user_id": user}) for i, h, name, user in batch]
        rows += [{"event_id": 999, "socket_id": "s1", "event": "disconnect"}, {"event_id": 998, "socket_id": "s2", "event": "connect_user", "user_id": 3}]  # without a time
        (src / f"{b}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(src / f"{b}.json", (1_700_000_000 + b,) * 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = presence.connections(read_socket_events(spark, str(src), files_per_batch=1), keep="6 hours", lots=5)
        flows.run_batches(stream, str(tmp_path / "ck"), lambda d, n: d.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), "update").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    log = spark.read.option("basePath", out).parquet(out).select(F.col("batch_id").cast("int"), "socket_id", "user_id", "opened_us", "opened_id", "lost_us")
    want = expected(batches, 6)
    assert sorted(map(tuple, log.collect()), key=str) == sorted(want, key=str)
    # sockets were forgotten, and it shows
    assert sorted(want, key=str) != sorted(expected(batches, 6, forget=False), key=str)
