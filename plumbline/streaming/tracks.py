"""Streams of timestamped records: an extension; batch queries have no counterpart of it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


def sessions(stream: DataFrame, by: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Runs of records without a pause longer than gap, as islands of frames; records later than late are left out."""
    window = F.session_window(ts, gap)
    made = stream.withWatermark(ts, late).groupBy(*by, window.alias("w")).agg(F.count("*").alias("n"))
    return made.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key's first record within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class _Sight(StatefulProcessor):
    """A key's last time, in milliseconds; a timer forgets it when it has been out of sight for longer than the gap."""

    def __init__(self, by: list[str], ts: str, gap: int):
        self.by, self.ts, self.gap = by, ts, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r[self.ts]):
            now = round(row[self.ts].timestamp() * 1000)
            yield Row(**dict(zip(self.by, key, strict=True)), **{self.ts: row[self.ts], "sent": last is None or now - last > self.gap})
            last = now if last is None else max(last, now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.gap)
        self.last.update((last,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_sight(stream: DataFrame, by: list[str], ts: str, gap: int, late: str) -> DataFrame:
    """by, ts, sent of each record: sent if its key comes into sight, so was not seen for gap milliseconds before.

    As operators.tracks.first_sight on batches. A key out of sight is forgotten by a timer once the watermark has passed, so the
    state holds what is in sight only. Records of a batch are taken in the order of their times; records without a time are
    left out, and those later than late may be. It needs a state store that knows timers (RocksDB).
    """
    kinds = [stream.schema[c] for c in by]
    schema = StructType([*kinds, stream.schema[ts], StructField("sent", BooleanType())])
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(*by, ts)
    return rows.groupBy(*by).transformWithState(_Sight(by, ts, gap), schema, outputMode="Append", timeMode="EventTime")
