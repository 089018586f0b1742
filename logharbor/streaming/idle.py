"""Open segments as Spark state: partitions that fell idle and segments that stay open too long.

An archive job with ``watch`` writes, each round, one row per partition it touched: what its open
segment holds, or that nothing is open.  This job keeps the newest of them per partition and a
processing-time timer beside it.  When the timer finds that the segment has not moved for
``idle_ms``, or is older than ``max_age_ms``, it reports the segment and forgets it;
``ArchiveStream.flush`` closes what was reported, if it has not moved since.  Thresholds may
differ after a restart; they take effect within ``check_ms``.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from logharbor.schemas import IDLE_THRESHOLD_MS
from logharbor.shared import remove_folder, written_folders

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN = "topic string, partition int, first_offset bigint, last_offset bigint, rows bigint, bytes bigint, round bigint"
REPORT = "topic string, partition int, first_offset bigint, last_offset bigint, rows bigint, bytes bigint, reason string"
_STATE = "first_offset bigint, last_offset bigint, rows bigint, bytes bigint, round bigint, since bigint, moved bigint"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Segment(StatefulProcessor):
    """The open segment of a partition."""

    def __init__(self, idle_ms: int, max_age_ms: int, check_ms: int):
        self.idle_ms, self.max_age_ms, self.check_ms = idle_ms, max_age_ms, check_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _wait(self, now: int, since: int, moved: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = min(moved + self.idle_ms, since + self.max_age_ms, now + self.check_ms)
        self.handle.registerTimer(max(due, now + 1))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        newest = max(rows, key=lambda r: r["round"])
        held = self.open.get() if self.open.exists() else None
        now = timerValues.getCurrentProcessingTimeInMs()
        if held is not None and newest["round"] < held[4]:
            return
        if newest["first_offset"] is None:
            self.open.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return
        same = held is not None and held[0] == newest["first_offset"]
        since = held[5] if same else now
        moved = held[6] if same and held[1] == newest["last_offset"] else now
        kept = (newest[n] for n in ("first_offset", "last_offset", "rows", "bytes", "round"))
        self.open.update((*kept, since, moved))
        self._wait(now, since, moved)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if not self.open.exists():
            return
        held, now = self.open.get(), timerValues.getCurrentProcessingTimeInMs()
        since, moved = held[5], held[6]
        reason = "idle" if now - moved >= self.idle_ms else "old" if now - since >= self.max_age_ms else None
        if reason is None:
            self._wait(now, since, moved)
            return
        self.open.clear()
        first, last, rows, size = held[:4]
        yield Row(
            topic=key[0], partition=key[1], first_offset=first, last_offset=last, rows=rows, bytes=size, reason=reason
        )

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class IdleWatch:
    """Watches the open segments of the archive job at ``archive_root``; its own files are at ``root``."""

    root: str
    archive_root: str
    idle_ms: int = IDLE_THRESHOLD_MS
    max_age_ms: int = 24 * 3600 * 1000
    check_ms: int = 10_000

    def start(self, spark: SparkSession, trigger: str = "1 second") -> StreamingQuery:
        before = spark.conf.get(_STORE)
        spark.conf.set(_STORE, _ROCKS)  # the store that keeps timers; read when the query starts
        try:
            opened = spark.readStream.schema(OPEN).option("ignoreMissingFiles", "true").parquet(f"{self.archive_root}/open")
            return (
                opened.groupBy("topic", "partition")
                .transformWithState(
                    _Segment(self.idle_ms, self.max_age_ms, self.check_ms), REPORT, "Append", "ProcessingTime"
                )
                .writeStream.foreachBatch(self._keep)
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .trigger(processingTime=trigger)
                .start()
            )
        finally:
            spark.conf.set(_STORE, before)

    def _keep(self, reports: DataFrame, batch_id: int) -> None:
        path = f"{self.root}/reports/round_no={batch_id}"
        reports.write.mode("overwrite").parquet(path)
        if reports.sparkSession.read.schema(REPORT).parquet(path).isEmpty():
            remove_folder(reports.sparkSession, path)

    def run_until(self, spark: SparkSession, enough: Callable[[StreamingQuery], bool], seconds: float) -> bool:
        """Watch until ``enough`` holds or the time is over; whether it held."""
        query = self.start(spark, "100 milliseconds")
        try:
            end = time.monotonic() + seconds
            while time.monotonic() < end and query.isActive:
                if enough(query):
                    return True
                time.sleep(0.2)
        finally:
            query.stop()
        if query.exception() is not None:
            raise query.exception()
        return False

    def reports(self, spark: SparkSession) -> DataFrame:
        """All reports so far, one for each segment and place it had reached."""
        if not written_folders(spark, f"{self.root}/reports"):
            return spark.createDataFrame([], REPORT)
        return spark.read.schema(REPORT).parquet(f"{self.root}/reports").select(*[c.split()[0] for c in REPORT.split(", ")]).distinct()
