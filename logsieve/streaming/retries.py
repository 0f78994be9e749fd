"""Failed messages: tried again after a pause, dead after so many failures, forgotten when they have been dead for long.

Failures are rows of a folder that any stream may add to. The state of a message, its failures and its text, lives in the
state store under its id, with one processing-time timer: before it is dead the timer sends it out to be tried again,
afterwards it ends its time in the dead-letter table. A message that was tried and did not fail again is forgotten. State and timers are part of the checkpoint, so a restart goes on
with the count it had.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logsieve.schema import CORRUPT, DOCUMENT
from logsieve.sources.json_logs import split_corrupt
from logsieve.streaming.batches import read_batches, rocks_db, start, write_batch

# Failures that make a dead letter, days it is kept.
MAX_ATTEMPTS = 3
DEAD_LETTER_DAYS = 14
RETRY_AFTER = 300           # seconds

FAILURES = "message_id string, raw string"
EVENTS = "message_id string, raw string, attempts int, action string, at timestamp"


class Attempts(StatefulProcessor):
    """Emits (message_id, raw, attempts, action, at): `retry`, `dead` or `expired`."""

    def __init__(self, max_attempts: int, retry_after: float, dead_for: float):
        self.max_attempts, self.retry_ms, self.dead_ms = max_attempts, math.ceil(retry_after * 1000), math.ceil(dead_for * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("message", "raw string, attempts int, waits boolean")

    def _row(self, key, raw: str | None, attempts: int, action: str, now: int) -> pd.DataFrame:
        return pd.DataFrame({"message_id": [key[0]], "raw": [raw], "attempts": pd.Series([attempts], dtype="int32"), "action": [action],
                             "at": pd.to_datetime([now], unit="ms")})

    def _wait(self, now: int, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + ms)

    def handleInputRows(self, key, rows, timerValues):
        now, failures, raw = timerValues.getCurrentProcessingTimeInMs(), 0, None
        for part in rows:
            failures += len(part)
            raw = part["raw"].iloc[-1]
        before = self.kept.get()[1] if self.kept.exists() else 0
        if before >= self.max_attempts:
            return                      # dead already; its time in the table goes on
        attempts = before + failures
        self.kept.update((raw, attempts, True))
        if attempts >= self.max_attempts:
            self._wait(now, self.dead_ms)
            yield self._row(key, raw, attempts, "dead", now)
        else:
            self._wait(now, self.retry_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.kept.exists():
            return
        raw, attempts, waits = self.kept.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if attempts >= self.max_attempts:
            self.kept.clear()
            yield self._row(key, raw, attempts, "expired", now)
        elif waits:
            self.kept.update((raw, attempts, False))
            self._wait(now, self.dead_ms)
            yield self._row(key, raw, attempts, "retry", now)       # a new failure comes back with its outcome, or nothing does
        else:
            self.kept.clear()                                       # no failure since it was tried: nothing to remember

    def close(self) -> None:
        pass


def add_failures(failures: DataFrame, folder: str, name: str) -> None:
    """Adds (message_id, raw) rows as a part of its own; the same name again replaces it and is not read twice."""
    failures.select("message_id", "raw").write.mode("overwrite").parquet(f"{folder}/part={name}")


def parsed_again(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the kept texts that parse now, and (message_id, raw) of those that fail once more."""
    document = F.from_json("raw", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    good, bad = split_corrupt(messages.select(F.col("message_id").alias("source_file"), document.alias("d")).select("source_file", "d.*"))
    return good, bad.select(F.col("source_file").alias("message_id"), "raw")


def start_retries(spark: SparkSession, out: str, checkpoint: str, on_recovered: Callable[[DataFrame, int], None] | None = None,
                  max_attempts: int = MAX_ATTEMPTS, retry_after: float = RETRY_AFTER, dead_days: float = DEAD_LETTER_DAYS,
                  every: str = "10 seconds", parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = parsed_again):
    """Start the stream over `{out}/failures`; messages move to `{out}/retry_events` and, parsed, to `on_recovered`.

    Every failure of a message counts, also one that a retry writes back. The stream needs the RocksDB state store,
    which is set for its own start only. A batch that runs again replaces its own folders.
    """
    failures = f"{out}/failures"
    add_failures(spark.createDataFrame([], FAILURES), failures, "none")     # a file stream needs its folder
    stream = (spark.readStream.schema(FAILURES).option("recursiveFileLookup", "true").parquet(failures))
    events = stream.groupBy("message_id").transformWithStateInPandas(
        Attempts(max_attempts, retry_after, dead_days * 86_400), EVENTS, "Append", "ProcessingTime")

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            retried = batch.filter("action = 'retry'")
            if not retried.isEmpty():
                good, bad = parse(retried)
                if on_recovered is not None:
                    on_recovered(good, batch_id)
                add_failures(bad, failures, f"retry-{batch_id}")
            write_batch(batch, f"{out}/retry_events", batch_id)
        batch.unpersist()

    with rocks_db(spark):
        return start(events, process, checkpoint, every)


def dead_letter_table(spark: SparkSession, out: str) -> DataFrame:
    """Messages that are dead and whose time is not over: (message_id, raw, attempts, at)."""
    events = read_batches(spark, f"{out}/retry_events", EVENTS)
    latest = events.filter("action <> 'retry'").groupBy("message_id").agg(F.max_by(F.struct("raw", "attempts", "action", "at"), "at").alias("e"))
    return latest.filter("e.action = 'dead'").select("message_id", "e.raw", "e.attempts", "e.at")
