"""Per-key state machines on streams: request limits (T3) and repeated deliveries (T4).

State lives in RocksDB.  A micro-batch hands all its rows of a key to one task, so the size of
a micro-batch (``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the source) bounds the work
per key; the batch operators have no such bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarifflens import policies as P

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class WindowLimit(StatefulProcessor):
    """Windows that open at a key's first request; state may end two windows later in event time."""

    def __init__(self, max_requests: int, window_seconds: int, expires: bool) -> None:
        self.max_requests, self.window, self.expires = max_requests, window_seconds * 1_000_000, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "opened long, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "request_id"])
        opened, used = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for request, at in zip(batch["request_id"], batch["at"]):
            if opened is None or at >= opened + self.window:
                opened, used, allowed = int(at), 1, True
            else:
                allowed = used < self.max_requests
                used += allowed
            wait = 0 if allowed else -((at - opened - self.window) // 1_000_000)
            out.append((request, key[0], allowed, self.max_requests - used if allowed else 0, wait, opened))
        self.state.update((opened, int(used)))
        if self.expires:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((opened + 2 * self.window) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._decisions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.state.clear()
        yield self._decisions([])

    @staticmethod
    def _decisions(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            rows, columns=["request_id", "key", "allowed", "remaining", "retry_after_seconds", "opened"]
        )

    def close(self) -> None:
        pass


def limit_stream(
    requests: DataFrame, max_requests: int, window_seconds: int, late_by: str | None = None
) -> DataFrame:
    """Decisions for a stream of ``request_id, key, at`` (``at`` in microseconds, ``key`` of any type).

    By default the state of a key stays for good and the answer is that of the batch operator.  With ``late_by``
    (such as ``"1 hour"``) the stream needs a column ``ts``; a key's state ends when the watermark passes two windows
    after its last opening, and requests later than ``late_by`` are not decided any more.  The clock on the wall
    plays no part, so a backlog after a stall is decided like fresh input.
    """
    key_type = requests.schema["key"].dataType.simpleString()
    timed = requests if late_by is None else requests.withWatermark("ts", late_by)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=WindowLimit(max_requests, window_seconds, late_by is not None),
        outputStructType=f"request_id long, key {key_type}, allowed boolean, remaining long, "
        "retry_after_seconds long, opened long",
        outputMode="Append",
        timeMode="None" if late_by is None else "EventTime",
    )


class DeliveryLog(StatefulProcessor):
    """Status, lock and attempts per event.

    With a retention, deliveries wait in a list until the watermark passes them, so that they are decided in event-time
    order however they arrive, and all state of an event ends that long after its last delivery.
    """

    def __init__(self, lock_seconds: int, retain_seconds: int | None) -> None:
        self.lock, self.retain = lock_seconds * 1_000_000, retain_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("log", "at long, done long, result string, attempts int")
        if self.retain is not None:
            self.pending = handle.getListState("pending", "at long, delivery_id long, done long, result string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows))
        fresh = [
            (int(at), int(name), -1 if pd.isna(done) else int(done), result)
            for at, name, done, result in zip(batch["at"], batch["delivery_id"], batch["done"], batch["result"])
        ]
        if self.retain is None:
            yield self._decided(key[0], sorted(fresh))
            return
        waiting = [*([tuple(row) for row in self.pending.get()] if self.pending.exists() else []), *fresh]
        yield self._go_on(key[0], waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        waiting = [tuple(row) for row in self.pending.get()] if self.pending.exists() else []
        yield self._go_on(key[0], waiting, timerValues)

    def _go_on(self, event: int, waiting: list[tuple], timerValues) -> pd.DataFrame:  # noqa: ANN001, N803
        """Decide what the watermark has passed, keep the rest, and set the timer for what comes next."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out = self._decided(event, sorted(row for row in waiting if row[0] < now))
        rest = sorted(row for row in waiting if row[0] >= now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.pending.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
            return out
        self.pending.clear()
        over = self.state.get()[0] // 1000 + self.retain * 1000
        if over <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        else:
            self.handle.registerTimer(over)
        return out

    def _decided(self, event: int, rows: list[tuple]) -> pd.DataFrame:
        taken, done, result, attempts = self.state.get() if self.state.exists() else (None, -1, "", 0)
        out = []
        for at, delivery, own_done, own_result in rows:
            in_time = taken is not None and 0 <= done <= taken + self.lock
            # What was processed stays so, however late the worker was.
            finished = result == "processed" and 0 <= done <= at
            if taken is None:
                free = True
            elif finished or (result == "processed" and in_time):
                free = False
            elif result == "failed" and in_time:
                free = at >= done
            else:
                free = at >= taken + self.lock
            reason = None
            if free:
                taken, done, result, attempts = at, own_done, own_result, attempts + 1
            else:
                reason = "already_processed" if finished else "in_progress"
            out.append((delivery, event, "process" if free else "skip", reason, attempts if free else None))
        if rows:
            self.state.update((taken, done, result, attempts))
        frame = pd.DataFrame(out, columns=["delivery_id", "event_id", "action", "reason", "attempt"])
        return frame.astype({"attempt": "Int64"})

    def close(self) -> None:
        pass


def delivery_stream(
    deliveries: DataFrame,
    lock_seconds: int = P.DELIVERY_LOCK_SECONDS,
    late_by: str | None = None,
    retain_seconds: int | None = None,
) -> DataFrame:
    """Decisions for a stream of ``delivery_id, event_id, at, done, result``.

    By default the log of an event stays for good and deliveries must not arrive late across batches. With ``late_by`` (such as
    ``"1 hour"``; the stream then needs ``ts``) and ``retain_seconds``, a delivery is decided once the watermark has
    passed it, in event-time order, and the log of an event ends ``retain_seconds`` after the delivery that holds it.
    """
    if (late_by is None) != (retain_seconds is None):
        raise ValueError("late_by and retain_seconds go together")
    timed = deliveries if late_by is None else deliveries.withWatermark("ts", late_by)
    return timed.groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=DeliveryLog(lock_seconds, retain_seconds),
        outputStructType="delivery_id long, event_id long, action string, reason string, attempt long",
        outputMode="Append",
        timeMode="None" if late_by is None else "EventTime",
    )
