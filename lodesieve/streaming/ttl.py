"""Verdicts with a time to live, in a stream: hits, misses, refreshes and expiries by content.

Each key (scope and digest) has a state: when its verdict expires. A request finds it (hit), prolongs it if it has lost a certain part of its time
(refresh: half of it, but a second at least and an hour at most), or finds none (miss: it is inspected, and the verdict holds for ``ttl`` seconds from
then). A timer on event time removes a verdict once the watermark has passed its end, so the state holds what lives, not what ever was.

A content that a third of all requests hold is one key, and so one task's; so equal requests of one second are counted before the
shuffle, and cross as one row with a count.

Defined results. Requests with a null key or time are left out; those behind the watermark are dropped, as Spark does. Within a batch
requests count in the order of their times, whatever their order in the files. An expiry has the time at which the verdict ended, also if the next request is what shows it; the
result is the same however the stream is cut into batches, as long as no request is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, time bigint, what string, n bigint"
#: What transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slack_of(ttl: int) -> int:
    return max(1, min(3600, ttl // 2))


class Verdicts(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl, self.slack = ttl, slack_of(ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("verdict", "expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat([r[["time", "n"]] for r in rows]).groupby("time", sort=True)["n"].sum()
        expires = self.state.get()[0] if self.state.exists() else None
        before, out = expires, []
        for time, n in zip(seen.index.tolist(), seen.tolist(), strict=True):
            if expires is not None and expires <= time:
                out.append((expires, "expired", 1))
                expires = None
            if expires is None:
                what, expires = "miss", time + self.ttl
            elif expires - time < self.ttl - self.slack:
                what, expires = "refresh", time + self.ttl
            else:
                what = "hit"
            out.append((time, what, 1))
            if n > 1:  # the others of this second find what the first one left
                out.append((time, "hit", n - 1))
        if expires != before:
            if before is not None:
                self.handle.deleteTimer(1000 * before)
            self.handle.registerTimer(1000 * expires)
            self.state.update((expires,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "time": [o[0] for o in out], "what": [o[1] for o in out], "n": [o[2] for o in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            expires = self.state.get()[0]
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "time": [expires], "what": ["expired"], "n": [1]})

    def close(self) -> None:
        pass


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal requests of one second as one row."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by(["key", "at", "time"]).aggregate([([], "count_all")])
            yield from t.rename_columns(["key", "at", "time", "n"]).to_batches()


def verdicts(stream: DataFrame, key: str, time: str, ttl: int, delay: str = "0 seconds") -> DataFrame:
    """stream: key, time (epoch seconds) and others. key, time, what (miss, hit, refresh, expired), n."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.timestamp_seconds(F.col(time)).alias("at"), F.col(time).cast("bigint").alias("time")).where("key IS NOT NULL AND time IS NOT NULL")
    rows = rows.mapInArrow(counted, "key string, at timestamp, time bigint, n bigint").withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(Verdicts(ttl), OUT, "Append", "EventTime")
