"""The index of infrastructure changes, and the ad-hoc lookup of changes since the last training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.scalars import epoch_ms, non_empty
from logsieve.operators.features import (
    CLOUDTRAIL, change_document, change_line, change_summary, changed_resource, event_timestamp, member_columns,
)
from logsieve.operators.labels import is_infra_change, is_named_change
from logsieve.operators.retrieval import (
    TextVectoriser, embedded, first_documents, nearest, split_by_dimension, with_payload,
)
from logsieve.operators.vocabulary import Vocabulary
from logsieve.operators.upsert import rows_to_insert, upsert_counts, upsert_replace
from logsieve.schema import CHUNKS, INDEXED_CHANGE_NAMES, LOOKUP_CHANGE_NAMES
from logsieve.sources.json_logs import scan_since
from logsieve.sources.bucketed import BucketedTable

LOOKUP_LIMIT = 500
LOOKUP_TOP = 3
DOCUMENT_LIMIT = 10


def change_chunks(events: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """Change events as chunks without their vector: id, time, name, resource, principal and summary text."""
    m = member_columns(events, layout)
    changes = events.filter(is_infra_change(m["management_event"], m["read_only"], m["event_name"]))
    return changes.select(
        m["event_id"].alias("event_id"),
        event_timestamp(events, layout).cast("timestamp").alias("event_time"),
        m["event_name"].alias("event_name"),
        changed_resource(m["request_parameters"]).alias("resource"),
        F.coalesce(non_empty(m["principal"]), non_empty(m["user_name"])).alias("principal"),
        change_summary(m, m["event_time"].cast("string")).alias("raw_text"),
    )


def named_change_chunks(events: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """The same for the events on the training job's list of names, with the shorter summary line."""
    m = member_columns(events, layout)
    changes = events.filter(is_named_change(m["event_name"], INDEXED_CHANGE_NAMES))
    return changes.select(
        m["event_id"].alias("event_id"),
        event_timestamp(events, layout).cast("timestamp").alias("event_time"),
        m["event_name"].alias("event_name"),
        changed_resource(m["request_parameters"]).alias("resource"),
        F.coalesce(m["principal"], F.lit("")).alias("principal"),
        change_line(m, m["event_time"].cast("string")).alias("raw_text"),
    )


def build_change_index(spark: SparkSession, logs: str, since_ts: str, table: BucketedTable,
                       vectoriser: TextVectoriser | None = None, replace: bool = True,
                       vocabulary: Vocabulary | None = None) -> tuple[TextVectoriser, DataFrame]:
    """Index the changes in files written after `since_ts`; returns the vectoriser and the upsert counts.

    `replace` overwrites text and vector of a known event, otherwise known events stay as they are. Only the buckets of
    the table that the changes touch are read and rewritten. With a `vocabulary` the chunks are its increment of this
    time, counted once however often the job runs, and nothing is fitted.
    """
    events = scan_since(spark, logs, since_ts, inclusive=False, require_rows=False)
    chunks = change_chunks(events)
    if vocabulary is not None:
        vectoriser = vocabulary.vectoriser(vocabulary.add(chunks, "raw_text", since_ts))
    vectoriser = vectoriser or TextVectoriser().fit(chunks, "raw_text")
    good, _ = embedded(vectoriser.transform(chunks, "raw_text"))
    good, _ = split_by_dimension(good, vectoriser.dim)
    rows = good.filter(F.col("event_id").isNotNull() & F.col("event_time").isNotNull()).withColumn(
        "indexed_at", F.current_timestamp()).select(*CHUNKS.fieldNames()).persist()
    counts = upsert_counts(table.read(buckets=table.touched(rows)), rows, "event_id")
    report = counts.first()
    order = F.struct("event_time", "raw_text")

    def merge(target: DataFrame, source: DataFrame) -> DataFrame:
        if replace:
            return upsert_replace(target, source, "event_id", ["raw_text", "embedding"], order, ("indexed_at", F.current_timestamp()))
        return target.unionByName(rows_to_insert(target, source, "event_id", order))

    table.upsert(rows, merge)
    rows.unpersist()
    return vectoriser, spark.createDataFrame([tuple(report)], counts.schema)


def lookup_changes(events: DataFrame, start: Column, limit: int = LOOKUP_LIMIT, names: list[str] = LOOKUP_CHANGE_NAMES,
                   layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """Write events since `start`: the newest `limit` of them, then those on the list of names.

    The limit comes before the names, as it bounds what the lookup fetches.
    """
    m = member_columns(events, layout)
    ts = event_timestamp(events, layout)
    newest = (
        events.filter(~F.coalesce(m["read_only"], F.lit(False)) & (ts >= start))
        .orderBy(ts.desc(), m["event_id"].asc()).limit(limit)
    )
    m = member_columns(newest, layout)
    return newest.filter(is_named_change(m["event_name"], names))


def change_documents(changes: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    m = member_columns(changes, layout)
    time_text = F.date_format(event_timestamp(changes, layout), "yyyy-MM-dd'T'HH:mm:ss")
    return changes.select(m["event_id"].alias("event_id"), event_timestamp(changes, layout).alias("event_time"),
                          change_document(m, time_text).alias("document"))


def question(event_source: str = "") -> str:
    if event_source:
        return f"recent changes around {event_source}"
    return "recent changes of the environment"


def last_training(runs: DataFrame, experiment: str) -> Column:
    """Start of the newest run of an experiment, as a literal."""
    newest = runs.filter(F.col("experiment") == experiment).agg(F.max("start_time").alias("ms")).first()["ms"]
    if newest is None:
        raise ValueError("no training run: the window of changes has no start")
    return epoch_ms(F.lit(newest))


def relevant_changes(events: DataFrame, start: Column, event_source: str = "", k: int = LOOKUP_TOP,
                     vectoriser: TextVectoriser | None = None, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """The k changes since `start` that fit the question best; without any vector the first documents.

    At most LOOKUP_LIMIT documents get this far, so the search index is small by definition.
    """
    documents = change_documents(lookup_changes(events, start, layout=layout), layout)
    vectoriser = vectoriser or TextVectoriser().fit(documents, "document")
    vectors, _ = embedded(vectoriser.transform(documents, "document"))
    asked = events.sparkSession.createDataFrame([(0, question(event_source))], "query_id int, text string")
    query, _ = embedded(vectoriser.transform(asked, "text"))
    if vectors.isEmpty() or query.isEmpty():
        return first_documents(documents, F.col("event_id"), DOCUMENT_LIMIT).select("event_id", "document")
    hits = nearest(query, vectors, k, "query_id", "event_id", metric="inner")
    return with_payload(hits, vectors, "event_id", ["document"]).orderBy("rank").select("rank", "event_id", "document")

