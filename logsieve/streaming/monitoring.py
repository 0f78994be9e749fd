"""Monitoring streams: windowed counts with a watermark, and alerts that are not repeated too soon."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logsieve.operators.monitor import REPEAT_HOURS, decision_rate, flagged_per_window
from logsieve.streaming.batches import rocks_db, start, write_batch

LATE = "10 minutes"


def _append(df: DataFrame, out: str, checkpoint: str, every: str | None):
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_flagged_counts(flagged: DataFrame, ts: str, out: str, checkpoint: str, late: str = LATE,
                         every: str | None = None):
    """Flagged events per five minutes; a window is written once the watermark has passed it."""
    return _append(flagged_per_window(flagged, ts, late=late), out, checkpoint, every)


def start_decision_rate(decisions: DataFrame, ts: str, out: str, checkpoint: str, late: str = LATE,
                        every: str | None = None):
    return _append(decision_rate(decisions, ts, late=late), out, checkpoint, every)


class LastSent(StatefulProcessor):
    """The last time sent of a group, kept until the watermark is a gap beyond it: then any alert is sent anyway."""

    def __init__(self, gap: int, by: list[str]):
        self.gap, self.by = gap, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows, timerValues):
        times = np.unique(np.concatenate([part["micros"].to_numpy(np.int64) for part in rows]))
        at, sent = 0, []
        if self.last.exists():
            at = int(np.searchsorted(times, self.last.get()[0] + self.gap))
        while at < len(times):
            sent.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + self.gap))
        if sent:
            self.last.update((sent[-1],))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(sent[-1] + self.gap) // 1000))
            yield pd.DataFrame({**{c: [v] * len(sent) for c, v in zip(self.by, key)}, "micros": sent})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def start_alerts(spark: SparkSession, alerts: DataFrame, by: list[str], ts: str, out: str, checkpoint: str,
                 hours: float = REPEAT_HOURS, every: str | None = None, late: str = LATE):
    """Alerts to send, (`by`, `ts`) in `{out}/sent`: the first of a group, then the first `hours` after the last one.

    The last time sent of a group is keyed state, so no batch reads what earlier ones sent, and it goes when the
    watermark has passed the gap. A group's times in one micro-batch meet in one task as eight bytes each. Alerts later
    than `late` are dropped. The stream needs the RocksDB state store, which is set for its own start only.
    """
    kinds = [f"`{c}` {alerts.schema[c].dataType.simpleString()}" for c in by]
    kind = alerts.schema[ts].dataType
    timed = alerts.select(*by, F.col(ts).cast("timestamp").alias("alert_ts")).withWatermark("alert_ts", late).withColumn("micros", F.unix_micros("alert_ts"))
    sent = timed.groupBy(*by).transformWithStateInPandas(
        LastSent(int(hours * 3600 * 1_000_000), by), ", ".join([*kinds, "micros bigint"]), "Append", "EventTime")

    def process(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select(*by, F.timestamp_micros("micros").cast(kind).alias(ts)), f"{out}/sent", batch_id)

    with rocks_db(spark):
        return start(sent, process, checkpoint, every)


def unique_within(df: DataFrame, key: str, ts: str, late: str = LATE) -> DataFrame:
    """First event of a key within the watermark; the state is bounded by the delay."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
