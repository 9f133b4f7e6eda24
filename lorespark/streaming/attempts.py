"""Attempts numbered and calls matched with responses while trace events arrive.

The state of a trace is small: how often each step was seen, and the calls (or responses) that still wait for their counterpart. It
is kept by Spark with the checkpoint of the stream, so a restart goes on where the last batch ended. Events of one trace come
in order from one batch to the next, as an append-only log gives them; inside a batch they are put in order here. What a task
gathers is the share of one trace in one batch, which the number of files per trigger bounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp, trace long, step string"
NUMBERED = "event_id long, trace long, step string, attempt long, call_id long, response_id long"


class AttemptNumbers(StatefulProcessor):
    """One row per event with its attempt number; the later one of a matched call and response carries both numbers."""

    def __init__(self, call: str, response: str):
        self.call, self.response = call, response

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value per trace: each call of a state is a round trip between Python and the store. Only one side can wait.
        self.state = handle.getValueState("state", "steps array<string>, reached array<bigint>, waiting array<bigint>, calls_wait boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(rows, key=lambda row: (row.ts is None, row.ts, row.event_id is None, row.event_id))
        steps, reached, waiting, calls_wait = self.state.get() or ([], [], [], False)
        numbers, queue = dict(zip(steps, reached)), deque(waiting)
        for event, step in ((row.event_id, row.step) for row in events):
            numbers[step] = numbers.get(step, 0) + 1
            pair = (None, None)
            if step in (self.call, self.response):
                # What arrives on the other side takes the longest waiting first.
                is_call = step == self.call
                if queue and calls_wait != is_call:
                    other = queue.popleft()
                    pair = (event, other) if is_call else (other, event)
                else:
                    queue.append(event)
                    calls_wait = is_call
            yield Row(event_id=event, trace=key[0], step=step, attempt=numbers[step], call_id=pair[0], response_id=pair[1])
        self.state.update((list(numbers), list(numbers.values()), list(queue), calls_wait))

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Stateful processors need the RocksDB store; the setting of the session comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def number_attempt_stream(events: DataFrame, call: str, response: str) -> DataFrame:
    """Streamed (event_id, ts, trace, step) with attempt numbers and matched calls."""
    return events.groupBy("trace").transformWithState(AttemptNumbers(call, response), NUMBERED, "Append", "None")


def run_attempt_numbers(spark: SparkSession, folder: str, target: str, checkpoint: str, call: str, response: str, files_per_batch: int = 1) -> None:
    """Read what is new in ``folder`` and append the numbered events to ``target``; the checkpoint makes a later run go on."""
    with state_store(spark):
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        query: StreamingQuery = number_attempt_stream(events, call, response).writeStream.format("parquet").option(
            "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
        query.awaitTermination()
