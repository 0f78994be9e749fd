"""Scoring stream: new log files to features, scores and two outputs; broken documents to the failures that are retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators.features import CANONICAL, CLOUDTRAIL, Dialect, feature_columns
from logsieve.operators.forest import Forest, score_forest
from logsieve.operators.labels import check_drift
from logsieve.operators.triage import flagged_events, scored_message
from logsieve.schema import CORRUPT, DOCUMENT
from logsieve.sources.json_logs import split_corrupt, stream_new_files, wrapped_events
from logsieve.streaming.batches import start, write_batch
from logsieve.streaming.retries import DEAD_LETTER_DAYS, MAX_ATTEMPTS, add_failures

# Threshold, cadence, files per run.
THRESHOLD = -0.1
POLL_EVERY = "5 minutes"
MAX_FILES = 10

ATTEMPTS = "message_id string, raw string, attempts int, at timestamp"


def score_events(events: DataFrame, forest: Forest, dialect: Dialect = CANONICAL) -> DataFrame:
    """Events with `score` and `prediction`; features are computed on the way and not kept."""
    columns = feature_columns(events, dialect, CLOUDTRAIL)
    table = events.select("*", *[F.coalesce(c, F.lit(0)).cast("float").alias(n) for n, c in columns.items()])
    return score_forest(table, forest).drop(*columns)


def start_scoring(spark: SparkSession, logs: str, out: str, checkpoint: str, forest: Forest,
                  registered_hash: str | None = None, threshold: float = THRESHOLD, max_files: int = MAX_FILES,
                  every: str | None = None):
    """Start the stream; a model with other features stops it before the first file.

    Documents that do not parse go to `{out}/failures`, which `start_retries` reads.
    """
    check_drift(registered_hash, forest.features)

    def process(batch: DataFrame, batch_id: int) -> None:
        documents = batch.persist()
        good, bad = split_corrupt(documents)
        scored = score_events(wrapped_events(good), forest).persist()
        if not scored.isEmpty():
            write_batch(scored_message(scored), f"{out}/events-raw", batch_id)
            write_batch(flagged_events(scored, threshold), f"{out}/anomalies-flagged", batch_id)
        if not bad.isEmpty():
            add_failures(bad.select(F.col("source_file").alias("message_id"), "raw"), f"{out}/failures", f"scoring-{batch_id}")
        scored.unpersist()
        documents.unpersist()

    return start(stream_new_files(spark, logs, max_files), process, checkpoint, every)


# Failed messages -----------------------------------------------------------------------------------------------


def record_attempts(failures: DataFrame, prior: DataFrame) -> DataFrame:
    """One row per message that failed now, with the number of its failures so far."""
    now = failures.groupBy("message_id").agg(F.first("raw").alias("raw"), F.count("*").cast("int").alias("failed"))
    before = prior.groupBy("message_id").agg(F.max("attempts").alias("earlier"))
    return now.join(before, "message_id", "left").select(
        "message_id", "raw", (F.coalesce("earlier", F.lit(0)) + F.col("failed")).cast("int").alias("attempts"),
        F.current_timestamp().alias("at"))


def attempt_status(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Latest state per message: its attempts and whether it is a dead letter."""
    latest = attempts.groupBy("message_id").agg(
        F.max("attempts").alias("attempts"), F.max_by("raw", "attempts").alias("raw"),
        F.max_by("at", "attempts").alias("at"))
    return latest.withColumn("dead", F.col("attempts") >= max_attempts)


def dead_letters(attempts: DataFrame, now, days: int = DEAD_LETTER_DAYS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Messages that failed too often, for as long as they are kept."""
    dead = attempt_status(attempts, max_attempts).filter("dead")
    return dead.filter(F.col("at") > now - F.make_dt_interval(F.lit(days))).drop("dead")


def retry_messages(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """Parse the kept text of failed messages again: documents that parse now, and those that fail once more."""
    open_messages = attempt_status(attempts, max_attempts).filter(~F.col("dead"))
    parsed = F.from_json("raw", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    documents = open_messages.select(F.col("message_id").alias("source_file"), parsed.alias("d")).select("source_file", "d.*")
    good, bad = split_corrupt(documents)
    return good, bad.withColumnRenamed("source_file", "message_id")


def partitioned(df: DataFrame, n: int, key: str, order_by: str) -> DataFrame:
    """Messages of one key in one partition and in order, in n partitions."""
    return df.repartition(n, key).sortWithinPartitions(key, order_by)
