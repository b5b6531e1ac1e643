"""Was an address seen before, within four hours: keyed state on the stream, expired by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilark.operators.activity import ACTIVITY_HOURS, sightings

OUTPUT = "log_uuid string, ip string, seen boolean"
HOUR_US = 3_600_000_000
#: What the state needs; RocksDB keeps it off the heap and writes changes only.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _rows(ip: str, found: list[tuple[str, bool]]) -> pd.DataFrame:
    # Plain objects: Arrow-backed strings cannot be put into a state's struct.
    return pd.DataFrame({"log_uuid": pd.Series([u for u, _ in found], dtype=object),
                         "ip": pd.Series([ip] * len(found), dtype=object),
                         "seen": pd.Series([s for _, s in found], dtype=bool)})


class FirstSightings(StatefulProcessor):
    """Per address: the first sighting of each hour, for as long as a row can still ask for it.

    A row is seen unless it is the first of its hour and none of the three hours before has any. So every row
    but an hour's first leaves at once; the first waits until the watermark has passed it, when no earlier row can
    come. An hour is dropped ``hours`` after its start, when the watermark gets there.
    """

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "hour bigint", "ts bigint, log_uuid string, settled boolean")

    def _wait(self, micros: int) -> None:
        # Timers count whole milliseconds; they fire when the watermark is at or behind them.
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            best: dict[int, tuple[int, str]] = {}
            ids = []
            for hour, ts, log_uuid in sorted(zip(batch["hour"].tolist(), batch["ts_us"].tolist(), batch["log_uuid"].tolist())):
                if hour not in best:
                    best[hour] = (ts, log_uuid)
                else:
                    ids.append(log_uuid)
            for hour, mine in best.items():
                held = self.first.getValue((hour,)) if self.first.containsKey((hour,)) else None
                if held is not None and (held[2] or (held[0], held[1]) < mine):
                    ids.append(mine[1])
                    continue
                if held is not None:
                    ids.append(held[1])
                self.first.updateValue((hour,), (*mine, False))
                self._wait(mine[0])
                self._wait((hour + self.hours) * HOUR_US)
            yield _rows(key[0], [(u, True) for u in ids])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = {k[0]: v for k, v in self.first.iterator()}
        out = []
        for hour, (ts, log_uuid, settled) in sorted(held.items()):
            if not settled and ts < passed:
                out.append((log_uuid, any(hour - back in held for back in range(1, self.hours))))
                self.first.updateValue((hour,), (ts, log_uuid, True))
        for hour in held:
            if (hour + self.hours) * HOUR_US < passed:
                self.first.removeKey((hour,))
        yield _rows(key[0], out)

    def close(self) -> None:
        pass


def seen_before(rows: DataFrame, delay: str = "1 hour", hours: int = ACTIVITY_HOURS) -> DataFrame:
    """(log_uuid, ip, seen) of a stream of rows, in any order within ``delay``; later rows are dropped.

    It equals :func:`vigilark.operators.activity.sightings_seen` over all rows below the watermark.
    """
    timed = rows.withWatermark("event_timestamp", delay)
    seen = sightings(timed).select("ip", "hour", F.unix_micros("ts").alias("ts_us"), "log_uuid", "ts")
    return seen.groupBy("ip").transformWithStateInPandas(
        FirstSightings(hours), OUTPUT, outputMode="Append", timeMode="EventTime")
