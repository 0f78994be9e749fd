"""Triage of flagged events as table operations: unprocessed events, context, prompt, verdict, routing, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.scalars import non_empty, text
from logsieve.operators.features import CLOUDTRAIL, member_columns, retrieval_query
from logsieve.operators.retrieval import nearest, with_payload
from logsieve.operators.upsert import anti_join
from logsieve.schema import CONTEXT

CONTEXT_SIZE = 5

# The sentence that stands for an empty context, and defaults of a verdict.
NO_CONTEXT = "No infrastructure changes found since last model training."
DEFAULT_DECISION, DEFAULT_CONFIDENCE, DEFAULT_SEVERITY = "genuine_bug", 0.5, "P3"
REASON_CHARS = 500

# Severities of the pager and looks of the chat message per decision.
PAGER_SEVERITY = {"P1": "critical", "P2": "error", "P3": "warning"}
CHAT_LOOK = {
    True: (":rotating_light:", "#FF0000", "Genuine Anomaly"),
    False: (":white_check_mark:", "#36a64f", "Known Change"),
}

PROMPT = """Classify a flagged audit-log event.

Event:
%s

Infrastructure changes since the last model training (%s):
%s

Decide between genuine_bug (a security problem) and known_change (explained by a change above).
Answer with one JSON object: decision, confidence (0.0 to 1.0), reasoning, severity (P1, P2 or P3)."""


def unprocessed(events: DataFrame, log: DataFrame, key: str = "event_id", small_batch: int | None = None) -> DataFrame:
    """Events the decision log does not have yet. An event without an id is never processed already.

    For a micro-batch set `small_batch`: while the batch has at most that many ids they are broadcast to the log, so
    a log of any size is only scanned for its key and not shuffled.
    """
    keyed = events.withColumn("_k", non_empty(key))
    known = log.select(F.col(key).alias("_k"))
    if small_batch is not None:
        ids = keyed.select("_k").filter("_k is not null").distinct()
        if ids.limit(small_batch + 1).count() <= small_batch:
            known = known.join(F.broadcast(ids), "_k", "left_semi")
    return anti_join(keyed, known, "_k").drop("_k")


# Context -------------------------------------------------------------------------------------------------------


def context_struct() -> Column:
    return F.struct("raw_text", "event_name", F.col("event_time").cast("string").alias("event_time"),
                    "resource", "principal")


def retrieve_context(events: DataFrame, chunks: DataFrame, since: Column, vectoriser, k: int = CONTEXT_SIZE,
                     layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """Add `retrieved_ctx`: the k changes after `since` that are nearest to what the event says.

    Events that say the same share one search: only distinct query texts are embedded and matched, then joined back.
    A query without a vector gets an empty context.
    """
    asked = events.withColumn("_query", retrieval_query(member_columns(events, layout)))
    distinct = asked.select("_query").distinct()
    queries = vectoriser.transform(distinct, "_query", "_vector").filter(F.col("_vector").isNotNull())
    recent = chunks.filter(F.col("event_time") > since)
    hits = nearest(queries, recent, k, "_query", "event_id", query_vector="_vector")
    found = with_payload(hits, recent, "event_id",
                         ["raw_text", "event_name", "event_time", "resource", "principal"])
    ranked = F.array_sort(F.collect_list(F.struct("rank", context_struct().alias("chunk"))))
    contexts = found.groupBy("_query").agg(F.transform(ranked, lambda r: r["chunk"]).alias("retrieved_ctx"))
    none = F.array().cast(CONTEXT)
    return (
        asked.join(contexts, "_query", "left")
        .withColumn("retrieved_ctx", F.coalesce(F.col("retrieved_ctx").cast(CONTEXT), none))
        .drop("_query")
    )


def context_block(ctx: Column) -> Column:
    """One line per retrieved change, or the sentence that says there is none."""
    def line(c: Column) -> Column:
        return F.concat(F.lit("- ["), text(c["event_time"]), F.lit("] "), text(c["event_name"]), F.lit(" on "),
                        F.coalesce(c["resource"], F.lit("?")), F.lit(" by "),
                        F.coalesce(c["principal"], F.lit("?")), F.lit(": "), text(c["raw_text"]))

    empty = F.coalesce(F.size(ctx), F.lit(0)) <= 0
    return F.when(empty, F.lit(NO_CONTEXT)).otherwise(F.array_join(F.transform(ctx, line), "\n"))


def prompt(event: Column, since_text: Column, context: Column, template: str = PROMPT) -> Column:
    """The template filled with the event as JSON, the training time and the context."""
    return F.format_string(template, F.to_json(event), since_text, context)


# Verdict -------------------------------------------------------------------------------------------------------


def parse_verdict(df: DataFrame, response: str = "response") -> DataFrame:
    """Add decision, confidence, reasoning, severity and `parse_ok` from the JSON text of a response.

    Absent members take their defaults. Text that is not a JSON object, or a confidence that is not a number, gives
    the safe default with the start of the response as the reason.
    """
    parsed = F.try_parse_json(F.col(response))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))

    def member(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(parsed, path, kind)

    stated = F.coalesce(member("$.decision"), member("$.verdict"))
    confidence = member("$.confidence").try_cast("double")
    # A null confidence is a member that is present and not a number.
    present = F.array_contains(F.json_object_keys(F.to_json(parsed)), "confidence")
    ok = is_object & (~F.coalesce(present, F.lit(False)) | confidence.isNotNull())
    return (
        df.withColumn("parse_ok", ok)
        .withColumn("decision", F.when(ok, F.coalesce(stated, F.lit(DEFAULT_DECISION))).otherwise(DEFAULT_DECISION))
        .withColumn("confidence",
                    F.when(ok, F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE))).otherwise(DEFAULT_CONFIDENCE))
        .withColumn("reasoning",
                    F.when(ok, F.coalesce(member("$.reasoning"), member("$.reason"), F.lit("")))
                    .otherwise(F.substring(text(response), 1, REASON_CHARS)))
        .withColumn("severity",
                    F.when(ok, F.coalesce(member("$.severity"), F.lit(DEFAULT_SEVERITY))).otherwise(DEFAULT_SEVERITY))
    )


# Routing and payloads ------------------------------------------------------------------------------------------


def pager_events(df: DataFrame) -> DataFrame:
    """Only genuine findings go to the pager; the chat gets every decision."""
    return df.filter(F.col("decision") == DEFAULT_DECISION)


def pager_severity(severity: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in PAGER_SEVERITY.items() for v in kv])
    return F.coalesce(F.try_element_at(known, text(severity)), F.lit(PAGER_SEVERITY[DEFAULT_SEVERITY]))


# The member names, titles and lead words of the payloads below, which the receivers read.


def pager_payload(df: DataFrame, layout: dict[str, str] = CLOUDTRAIL, source: str = "logsieve") -> DataFrame:
    """`(event_id, severity, payload)` for the pager; the event id is its dedup key, `source` names the sender."""
    m = member_columns(df, layout)
    summary = F.concat(F.lit("Anomaly: "), F.coalesce(m["event_name"], F.lit("?")), F.lit(" by "),
                       F.coalesce(m["principal"], F.lit("unknown")))
    body = F.struct(
        F.lit("trigger").alias("event_action"),
        m["event_id"].alias("dedup_key"),
        F.struct(
            summary.alias("summary"),
            pager_severity(F.col("severity")).alias("severity"),
            F.lit(source).alias("source"),
            m["event_time"].cast("string").alias("timestamp"),
            F.struct(F.col("score"), F.col("reasoning"), m["region"].alias("region"),
                     m["error_code"].alias("error")).alias("custom_details"),
        ).alias("payload"),
    )
    return pager_events(df).select(m["event_id"].alias("event_id"), pager_severity(F.col("severity")).alias("severity"),
                                   F.to_json(body).alias("payload"))


def chat_look(decision: Column, part: int) -> Column:
    return F.when(decision == DEFAULT_DECISION, CHAT_LOOK[True][part]).otherwise(CHAT_LOOK[False][part])


def chat_payload(df: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """`(event_id, color, header, payload)` for the chat; a missing score shows as `?`."""
    m = member_columns(df, layout)
    decision = F.col("decision")
    header = F.concat_ws(" ", chat_look(decision, 0), F.concat(chat_look(decision, 2), F.lit(":")),
                         F.coalesce(m["event_name"], F.lit("?")))
    score = F.coalesce(F.format_string("%.4f", F.col("score")), F.lit("?"))
    score = F.when(F.col("score").isNull(), F.lit("?")).otherwise(score)

    def field(title: str, value: Column) -> Column:
        return F.struct(F.lit("mrkdwn").alias("type"),
                        F.concat(F.lit(f"*{title}:*\n"), F.coalesce(value, F.lit("?"))).alias("text"))

    blocks = [
        F.struct(F.lit("header").alias("type"),
                 F.struct(F.lit("plain_text").alias("type"), header.alias("text")).alias("text"),
                 F.lit(None).cast("array<struct<type:string,text:string>>").alias("fields")),
        F.struct(F.lit("section").alias("type"),
                 F.lit(None).cast("struct<type:string,text:string>").alias("text"),
                 F.array(field("Score", score), field("Time", m["event_time"].cast("string")),
                         field("Principal", m["principal"]), field("Region", m["region"])).alias("fields")),
        F.struct(F.lit("section").alias("type"),
                 F.struct(F.lit("mrkdwn").alias("type"),
                          F.concat(F.lit("*Reasoning:*\n"), F.coalesce(F.col("reasoning"), F.lit("n/a"))).alias("text"),
                          ).alias("text"),
                 F.lit(None).cast("array<struct<type:string,text:string>>").alias("fields")),
    ]
    body = F.struct(F.array(F.struct(chat_look(decision, 1).alias("color"),
                                     F.array(*blocks).alias("blocks"))).alias("attachments"))
    return df.select(m["event_id"].alias("event_id"), chat_look(decision, 1).alias("color"),
                     header.alias("header"), F.to_json(body).alias("payload"))


def decision_rows(df: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """The row of the decision log for every classified event."""
    m = member_columns(df, layout)
    has = set(df.columns)

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in has else F.lit(None)).cast(kind)

    return df.select(
        column("kafka_offset", "bigint").alias("kafka_offset"),
        m["event_id"].alias("event_id"),
        (F.col("event_ts") if "event_ts" in has else F.try_to_timestamp(m["event_time"])).cast("timestamp").alias("event_time"),
        F.col("score").cast("double").alias("anomaly_score"),
        F.col("retrieved_ctx").cast(CONTEXT).alias("retrieved_ctx"),
        F.col("prompt").alias("bedrock_prompt"),
        F.col("response").alias("bedrock_response"),
        "decision", "confidence",
        F.when(F.col("decision") == DEFAULT_DECISION, m["event_id"]).alias("pagerduty_id"),
        column("slack_ts", "string").alias("slack_ts"),
        F.current_timestamp().alias("created_at"),
    )


def audit_view(log: DataFrame, scored: DataFrame, key: str = "event_id") -> DataFrame:
    """Score and outcome side by side for every logged event."""
    return scored.join(log.select(key, "decision", "confidence"), key)


# Message projections -------------------------------------------------------------------------------------------


def scored_message(df: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """The 4-member message of every scored event, as a keyed JSON value."""
    m = member_columns(df, layout)
    return df.select(m["event_id"].alias("key"), F.to_json(F.struct(
        m["event_id"].alias("eventID"), m["event_time"].alias("eventTime"), m["event_name"].alias("eventName"),
        F.col("score"))).alias("value"))


FLAGGED_MEMBERS = ["eventID", "eventTime", "eventName", "eventSource", "awsRegion", "userIdentity",
                   "requestParameters", "responseElements", "errorCode", "score", "raw"]


def flagged_events(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """The 11 members of a flagged message: only events strictly below the threshold, with the whole event."""
    event = [c for c in df.columns if c in {
        "eventID", "eventTime", "eventName", "eventSource", "awsRegion", "userAgent", "sourceIPAddress", "eventType",
        "eventVersion", "errorCode", "managementEvent", "readOnly", "userIdentity", "requestParameters",
        "responseElements"}]
    return df.filter(F.col(score) < threshold).withColumn("raw", F.struct(*event)).select(*FLAGGED_MEMBERS)


def flagged_message(df: DataFrame, threshold: float) -> DataFrame:
    flagged = flagged_events(df, threshold)
    return flagged.select(F.col("eventID").alias("key"), F.to_json(F.struct(*FLAGGED_MEMBERS)).alias("value"))
