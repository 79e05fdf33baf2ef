"""Call logs as a stream: one state machine a call, closed by a timer.

Events (call, seq, at, event, item) may come in any order and any number of files. The state of a call is three small values: threads, completed turns, and the
earliest event that speaks against it; each is a sum or a least, so the order of files does not matter. A call is closed when the watermark has passed its
last event by the patience given, and gives one row then, calls that never ended included.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from annolens.operators.contracts import ALLOWED_ITEMS, FAILED, NO_TURN, TOOL

EVENTS = "call string, seq long, at timestamp, event string, item string"
VERDICTS = "call string, threads long, turns long, last_at timestamp, reason string"
_STATE = "threads long, turns long, bad_seq long, bad string, last_ms long"


class CallMachine(StatefulProcessor):
    def __init__(self, patience: timedelta):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        threads, turns, bad_seq, bad, last = self.call.get() if self.call.exists() else (0, 0, None, None, None)
        for row in rows:
            threads += row.event == "thread.started"
            turns += row.event == "turn.completed"
            problem = FAILED if row.event in ("error", "turn.failed") else TOOL if row.item and row.item not in ALLOWED_ITEMS else None
            if problem and (bad_seq is None or row.seq < bad_seq):
                bad_seq, bad = row.seq, problem
            last = row.ms if last is None else max(last, row.ms)
        self.call.update((threads, turns, bad_seq, bad, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.patience // timedelta(milliseconds=1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        threads, turns, _, bad, last = self.call.get()
        self.call.clear()
        yield Row(call=key[0], threads=threads, turns=turns, last_ms=last, reason=NO_TURN if threads != 1 or not turns else bad)

    def close(self) -> None:
        pass


def call_verdicts(events: DataFrame, patience: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """A stream of (call, threads, turns, last_at, reason), one row a closed call; a null reason is a sound call. events: a stream of EVENTS."""
    timed = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    shape = "call string, threads long, turns long, last_ms long, reason string"
    closed = timed.groupBy("call").transformWithState(statefulProcessor=CallMachine(patience), outputStructType=shape, outputMode="Append", timeMode="EventTime")
    return closed.select("call", "threads", "turns", F.timestamp_millis("last_ms").alias("last_at"), "reason")


def judge_calls(spark: SparkSession, source: str, target: str, checkpoint: str, patience: timedelta = timedelta(hours=1), late: str = "10 minutes", files_a_batch: int = 1000) -> None:
    """Read the event logs that have come since the last call, write the calls that are closed, and stop.

    State and progress are in the checkpoint, and the target's own log names the files of each batch, so a run that was broken off goes on without a row lost or twice.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(source)
    verdicts = call_verdicts(events, patience, late)
    verdicts.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target).awaitTermination()
