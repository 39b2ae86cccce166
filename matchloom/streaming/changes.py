"""Changes of a key's payload in a stream: told once it has been quiet for a while, and only if it is another one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Settings of the session that runs the stream.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGES = "key string, at long, tie long, payload string"


class Debounce(StatefulProcessor):
    """Holds a key's events until the watermark has passed them by the quiet time, then judges them in order.

    An event that another follows within the quiet time isn't told; nor is one whose payload is that of the last told.
    By then no event can come between the two any more, so events may come in any order as long as they aren't late.
    """

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, tie long, payload string")
        self.told = handle.getValueState("told", "payload string, some boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part[["at", "tie", "payload"]].itertuples(index=False)]
        return self._settled(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settled(key, [], timerValues.getCurrentWatermarkInMs())

    def _settled(self, key, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        events = sorted([*((int(at), int(tie), payload) for at, tie, payload in new), *((int(r[0]), int(r[1]), r[2]) for r in self.held.get())], key=lambda e: e[:2])
        last = self.told.get() if self.told.exists() else None
        out, done = [], 0
        while done < len(events) and events[done][0] + self.quiet <= watermark_ms * 1000:
            at, _, payload = events[done]
            quiet = done + 1 == len(events) or events[done + 1][0] - at >= self.quiet
            done += 1
            if quiet and (last is None or last[0] != payload):
                last = (payload, True)
                out.append((str(key[0]), *events[done - 1]))
        if done and last is not None:
            self.told.update((last[0], True))
        rest = events[done:]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(-(-(rest[0][0] + self.quiet) // 1000))
        elif done:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "tie", "payload"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, at: str, tie: str, payload: Column, quiet_s: float, late: str) -> DataFrame:
    """The stream of changes of a stream of events: (key, at in microseconds, tie, payload), as state.changes() gives them for a table.

    An event is told when the watermark, `late` behind the latest event, has passed it by `quiet_s`; timers do this also for keys
    to which nothing comes any more. State is one key's events of that span and its last told payload, not its
    history. Events later than the watermark are left out. A null payload is one of its own. Needs the settings STORE.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("tie"), payload.cast("string").alias("payload"))
    timed = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(Debounce(int(quiet_s * 1e6)), CHANGES, "Append", "EventTime")
