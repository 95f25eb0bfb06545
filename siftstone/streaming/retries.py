"""A live retry queue: failures and arriving rows as one stream, attempts by timers with back-off and a cap.

An event is (chunk_id, kind, failure_mode, at): kind `failure` says that a write of a chunk failed, kind `vector` that its vector row is there, and kind `tick` only that
time goes on. State is kept by chunk. A failure is tried `base` seconds after it came, and after each attempt that fails twice as long as before; an attempt gets through as
bookkeeping.retry does: a missing lexical row can be restored where there is a vector row, a missing vector can't. After `most` attempts the chunk is given
up until it fails anew. Timers run on the events' own time, so a stream that is replayed, or goes on after a restart, gives the same outcomes as one that never stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "chunk_id string, kind string, failure_mode string, at timestamp"
OUTCOMES = "chunk_id string, resolved boolean, attempts int, error_msg string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RetryQueue(StatefulProcessor):
    """Of a chunk: whether its vector row is there, the mode of its open failure, and the attempts made for it."""

    def __init__(self, base: int = 60, most: int = 5):
        self.base, self.most = base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chunk", "there boolean, mode string, attempts int")

    def _now(self) -> tuple[bool, str | None, int]:
        return tuple(self.state.get()) if self.state.exists() else (False, None, 0)

    def _restart(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        there, mode, attempts = self._now()
        latest = None
        for pdf in rows:
            there |= bool((pdf["kind"] == "vector").any())
            failures = pdf[pdf["kind"] == "failure"].sort_values(["at", "failure_mode"], kind="stable")
            if len(failures) and (latest is None or failures["at"].iloc[-1] >= latest):
                latest, mode = failures["at"].iloc[-1], failures["failure_mode"].iloc[-1]
        if latest is not None:
            attempts = 0
            self._restart(int(latest.timestamp() * 1000) + 1000 * self.base)
        if there or mode is not None:
            self.state.update((there, mode, attempts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        there, mode, attempts = self._now()
        if mode is None:
            return
        attempts += 1
        done = mode == "es_write" and bool(there)
        if not done and attempts < self.most:
            self.state.update((there, mode, attempts))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + 1000 * self.base * 2**attempts)
            return
        self.state.update((there, None, 0))
        yield pd.DataFrame({"chunk_id": [key[0]], "resolved": [done], "attempts": [attempts], "error_msg": [None if done else "retry failed"]})

    def close(self) -> None:
        pass


def retried(events: DataFrame, base: int = 60, most: int = 5, late: str = "0 seconds") -> DataFrame:
    """(chunk_id, resolved, attempts, error_msg) for each failure of a stream of EVENTS that got through or was given up. Needs the RocksDB state store.

    Events without a chunk or a time are left out; several failures of a chunk that are open at a time count as the last one.
    """
    fine = events.where("chunk_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return fine.groupBy("chunk_id").transformWithStateInPandas(RetryQueue(base, most), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
