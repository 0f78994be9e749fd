"""A journal of a job's steps: a run that died goes on where it stopped and publishes once.

A step writes an intent row before it starts and a commit row with its outcome, a small JSON value, when it has ended.
A later run of the same name takes the outcome of a committed step from the journal and does the others. A step that
was begun but not committed may have done its work: it is told so and must either overwrite it or find it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.sources.tables import read_or_empty

JOURNAL = "run string, step string, kind string, outcome string, at timestamp"
INTENT, COMMIT = "intent", "commit"


class Journal:
    """The steps of one run, by its name, in a table that all runs share. One process writes a run at a time."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, JOURNAL).filter(F.col("run") == self.run)

    def _write(self, step: str, kind: str, outcome: str | None = None) -> None:
        row = self.spark.createDataFrame([(self.run, step, kind, outcome)], JOURNAL.rsplit(",", 1)[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def status(self) -> DataFrame:
        """One row per step: whether it was begun, whether it was committed and how often it was tried."""
        return self.rows().groupBy("step").agg(
            F.count_if(F.col("kind") == INTENT).alias("tries"), (F.count_if(F.col("kind") == COMMIT) > 0).alias("committed"))

    def step(self, name: str, work: Callable[[bool], object]):
        """The outcome of `work(again)`, or that of an earlier run which committed the step.

        `again` says that an earlier run began the step and did not commit it. What `work` returns must be a JSON value.
        """
        seen = {r.kind: r.outcome for r in self.rows().filter(F.col("step") == name).orderBy("at").collect()}     # a row per try of one step
        if COMMIT in seen:
            return json.loads(seen[COMMIT])
        self._write(name, INTENT)
        outcome = json.dumps(work(INTENT in seen))
        self._write(name, COMMIT, outcome)
        return json.loads(outcome)
