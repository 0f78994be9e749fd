"""Triage stream: flagged events to context, prompt, verdict, payload rows and an idempotent decision log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.scalars import non_empty
from logsieve.operators.labels import split_by_rule, valid_decision
from logsieve.operators.triage import (
    chat_payload, context_block, decision_rows, pager_payload, parse_verdict, prompt, retrieve_context, unprocessed,
)
from logsieve.operators.upsert import first_per_key
from logsieve.schema import DECISION_LOG, EVENT
from logsieve.sources.keyed_log import KeyedLog
from logsieve.streaming.batches import start, write_batch

SMALL_BATCH = 1_000_000

Respond = Callable[[DataFrame], DataFrame]

FLAGGED = EVENT.simpleString()[len("struct<"):-1]


def responses_from(table: DataFrame, key: str = "event_id", response: str = "response") -> Respond:
    """Take the response of an event from a table; an event without one gets null and so the safe default."""
    known = table.select(F.col(key).alias("_rk"), F.col(response).alias("response"))

    def respond(df: DataFrame) -> DataFrame:
        return df.join(known, F.col("eventID") == F.col("_rk"), "left").drop("_rk")

    return respond


def first_of_each(events: DataFrame, order_by: str) -> DataFrame:
    """One row per event id; events without an id all stay."""
    keyed = events.withColumn("_k", non_empty("eventID"))
    with_id = first_per_key(keyed.filter("_k is not null"), "_k", F.col(order_by))
    return with_id.unionByName(keyed.filter("_k is null")).drop("_k")


def classify(events: DataFrame, log: DataFrame, chunks: DataFrame, since_ts: str, vectoriser,
             respond: Respond, order_by: str = "kafka_offset") -> DataFrame:
    """Everything the triage adds to events that the log does not have yet: context, prompt, response, verdict."""
    fresh = unprocessed(first_of_each(events, order_by), log.select(F.col("event_id").alias("eventID")), "eventID",
                        SMALL_BATCH)
    since = F.to_timestamp(F.lit(since_ts))
    known = retrieve_context(fresh, chunks, since, vectoriser)
    event = F.struct(*[F.col(c) for c in EVENT.fieldNames() if c in known.columns], F.col("score"))
    asked = known.withColumn("prompt", prompt(event, F.lit(since_ts), context_block(F.col("retrieved_ctx"))))
    return parse_verdict(respond(asked))


def start_triage(spark: SparkSession, flagged: DataFrame, out: str, checkpoint: str, chunks: Callable[[], DataFrame],
                 since_ts: str, vectoriser, respond: Respond, every: str | None = None):
    """Start the stream over flagged events that carry a `kafka_offset`.

    A batch that runs again reads the log of earlier batches only and overwrites its own folders, so its rows are
    the same and no event is logged or announced twice. Of the log only files that may hold an event of the batch are
    read.
    """
    decisions = KeyedLog(spark, f"{out}/agent_log", DECISION_LOG, "event_id")

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        asked = batch.select(F.col("eventID").alias("key")).union(spark.range(1).select(F.lit("").alias("key")))
        log = decisions.rows_for(asked, batch_id).persist()
        done = classify(batch, log, chunks(), since_ts, vectoriser, respond).persist()
        if not done.isEmpty():
            rows = decision_rows(done).filter(F.col("event_id").isNotNull())
            blank = rows.filter("event_id = ''").orderBy("kafka_offset", "created_at").limit(1)
            named = rows.filter("event_id <> ''")
            if not log.filter("event_id = ''").isEmpty():
                blank = blank.limit(0)
            valid, rejected = split_by_rule(named.unionByName(blank), valid_decision(F.col("decision")))
            write_batch(pager_payload(done), f"{out}/pager", batch_id)
            write_batch(chat_payload(done), f"{out}/chat", batch_id)
            write_batch(rejected, f"{out}/quarantine", batch_id)
            decisions.append(valid, batch_id)
        done.unpersist()
        log.unpersist()
        batch.unpersist()

    return start(flagged, process, checkpoint, every)
