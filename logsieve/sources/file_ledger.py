"""Ledger of log files and the event times they hold: a scan since an event time opens only files that reach it.

Files arrive late and in any order, so neither their names nor their modification times say what they hold. Every file
is read once when it is first seen (again if it is rewritten) and leaves a row with its range of event times; a scan
asks the ledger first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logsieve.schema import EVENT
from logsieve.sources.json_logs import _utc, all_events, read_documents
from logsieve.sources.tables import read_or_empty

LEDGER = ("path string, source_file string, modified timestamp, bytes bigint, first_event timestamp, last_event timestamp, "
          "events bigint")
EVENTS = StructType([StructField("source_file", StringType()), *EVENT.fields])


def event_time() -> Column:
    """The time of an event; null where it has none that can be read."""
    return F.try_to_timestamp(F.col("eventTime"))


class FileLedger:
    """The ledger at `root` of the log files under `logs`.

    `multiline` is True for one document a file, False for one a line. `refresh` appends in one write, so a run that
    dies leaves the ledger as it was and the next one reads the same files again.
    """

    def __init__(self, spark: SparkSession, root: str, logs: str, multiline: bool = True, glob: str = "*.{json,json.gz}"):
        self.spark, self.root, self.logs, self.multiline, self.glob = spark, root.rstrip("/"), logs, multiline, glob

    def rows(self) -> DataFrame:
        """The last known state of every file."""
        columns = [c.split()[0] for c in LEDGER.split(", ")]
        seen = read_or_empty(self.spark, self.root, LEDGER)
        last = seen.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("modified", "bytes", "events")).alias("r"))
        return last.select(*[f"r.{c}" for c in columns])

    def listing(self) -> DataFrame:
        """Files as they are now, but for empty ones, without reading them: only columns that the listing knows are asked for."""
        files = (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", self.glob).load(self.logs))
        return files.select("path", F.col("_metadata.file_path").alias("source_file"), F.col("modificationTime").alias("modified"),
                            F.col("length").alias("bytes"))

    def refresh(self) -> int:
        """Enter the files that are new or rewritten; returns their number. Only names of new files reach the driver."""
        new = self.listing().join(self.rows().select("path", "modified", "bytes"), ["path", "modified", "bytes"], "left_anti")
        paths = [r.path for r in new.select("path").collect()]
        if not paths:
            return 0
        times = (
            all_events(read_documents(self.spark, paths, self.multiline, self.glob)).groupBy("source_file")
            .agg(F.min(event_time()).alias("first_event"), F.max(event_time()).alias("last_event"), F.count(F.lit(1)).alias("events")))
        entered = new.join(times, "source_file", "left").withColumn("events", F.coalesce("events", F.lit(0)))
        entered.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode("append").parquet(self.root)
        return len(paths)

    def files_since(self, since: str | datetime, inclusive: bool = True) -> list[str]:
        """Files that still exist and hold an event at or after (or strictly after) `since`."""
        mark = self._mark(since)
        last = F.col("last_event")
        reaching = self.rows().filter(last >= mark if inclusive else last > mark)
        return sorted(r.path for r in reaching.join(self.listing().select("path"), "path", "left_semi").select("path").collect())

    def scan_since(self, since: str | datetime, inclusive: bool = True) -> DataFrame:
        """Events at or after (or strictly after) `since`, whenever their file came. Call `refresh` before."""
        paths = self.files_since(since, inclusive)
        if not paths:
            return self.spark.createDataFrame([], EVENTS)
        mark = self._mark(since)
        events = all_events(read_documents(self.spark, paths, self.multiline, self.glob))
        return events.filter(event_time() >= mark if inclusive else event_time() > mark)

    @staticmethod
    def _mark(since: str | datetime) -> Column:
        return F.timestamp_micros(F.lit(int(_utc(since).timestamp() * 1_000_000)))
