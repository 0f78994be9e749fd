"""Audit-log files: JSON documents, NDJSON lines, file watermarks, broken input, new-file and topic streams.

A multi-line document is one unsplittable unit for the reader, so parallelism comes from the number of files;
line-mode input splits by bytes.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.schema import CORRUPT, DOCUMENT, EVENT

EVENT_FIELDS = EVENT.fieldNames()


class EmptyInputError(ValueError):
    """A scan that must not be empty returned no record."""


def read_documents(spark: SparkSession, path, multiline: bool = True, glob: str = "*.{json,json.gz}",
                   **options) -> DataFrame:
    """Every document under `path` with all members a document may have, plus the text of broken ones."""
    reader = (
        spark.read.schema(DOCUMENT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def _texts(lists: bool) -> Column:
    """The events of a document that does not fit the schema as a whole, each as its own text.

    One member of a wrong kind makes the reader give up a document; its other events are still good.
    """
    wrapped = F.from_json(F.col(CORRUPT), "Records array<string>")["Records"]
    return F.coalesce(wrapped, F.from_json(F.col(CORRUPT), "array<string>")) if lists else wrapped


def _events(bare: bool) -> Column:
    """All events of a document; with `bare` also a document that is one event, or a list of them."""
    objects = F.filter(_texts(bare), lambda t: t.startswith("{"))
    rescued = F.transform(objects, lambda t: F.from_json(t, EVENT))
    events = F.when(F.col("Records").isNotNull(), F.col("Records")).when(F.col(CORRUPT).isNotNull(), rescued)
    return events.otherwise(F.array(F.struct(*EVENT_FIELDS))) if bare else events


def _is_broken(lists: bool = True) -> Column:
    return F.col("Records").isNull() & F.col(CORRUPT).isNotNull() & _texts(lists).isNull()


def split_corrupt(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with readable events, and the rest as `(source_file, raw)` for the dead-letter table."""
    bad = documents.filter(_is_broken()).select("source_file", F.col(CORRUPT).alias("raw"))
    return documents.filter(~_is_broken()), bad


def _exploded(documents: DataFrame, bare: bool) -> DataFrame:
    return (
        documents.select("source_file", F.explode(_events(bare)).alias("event"))
        .filter(F.col("event").isNotNull())
        .select("source_file", "event.*")
    )


def wrapped_events(documents: DataFrame) -> DataFrame:
    """The members of every `Records` array, one row each."""
    return _exploded(documents, bare=False)


def all_events(documents: DataFrame) -> DataFrame:
    """Wrapped and flat documents in one pass: a flat one is read as a list of one."""
    return _exploded(documents, bare=True)


def read_records_json(spark: SparkSession, path) -> DataFrame:
    """Files of the form `{"Records": [...]}`; a file that does not parse is left out."""
    return wrapped_events(read_documents(spark, path))


def read_ndjson(spark: SparkSession, path, path_contains: str | None = "aws|cloudtrail") -> DataFrame:
    """One event or one `Records` document per line; only files whose path matches, ignoring case."""
    documents = read_documents(spark, path, multiline=False, glob="*.{json,ndjson,json.gz,ndjson.gz}")
    if path_contains:
        documents = documents.filter(F.lower("source_file").rlike(path_contains))
    return all_events(documents)


def read_json_any(spark: SparkSession, path) -> DataFrame:
    """Files that hold a list of events, a `Records` document or one bare event."""
    return all_events(read_documents(spark, path))


def _utc(since: str | datetime) -> datetime:
    at = datetime.fromisoformat(since.replace("Z", "+00:00")) if isinstance(since, str) else since
    return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)


def modified_since(since: str | datetime, inclusive: bool) -> Column:
    at = F.timestamp_micros(F.lit(int(_utc(since).timestamp() * 1_000_000)))
    stamp = F.col("_metadata.file_modification_time")
    return stamp >= at if inclusive else stamp > at


def scan_since(spark: SparkSession, path, since: str | datetime, inclusive: bool = True,
               glob: str = "*.{json,json.gz}", require_rows: bool = True) -> DataFrame:
    """Events of the files modified at or after (or strictly after) a high-water mark.

    `modifiedAfter` drops old files while listing, one second early; the exact bound is a filter on the file
    metadata.
    """
    early = (_utc(since) - timedelta(seconds=1)).strftime("%Y-%m-%dT%H:%M:%S")
    reader = (
        spark.read.schema(DOCUMENT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("modifiedAfter", early)
        .option("timeZone", "UTC")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    documents = (
        reader.json(path)
        .filter(modified_since(since, inclusive))
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    events = wrapped_events(documents)
    if require_rows and events.isEmpty():
        raise EmptyInputError(f"no log records since {since}: nothing to train on")
    return events


def stream_new_files(spark: SparkSession, path, max_files: int = 10) -> DataFrame:
    """Documents of files as they arrive, at most `max_files` per micro-batch, broken ones included."""
    return (
        spark.readStream.schema(DOCUMENT)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,json.gz}")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def stream_topic(spark: SparkSession, schema, brokers: str | None = None, topic: str = "anomalies-flagged",
                 path: str | None = None, **options) -> DataFrame:
    """Messages of a topic from the earliest on, parsed from JSON; the checkpoint is the committed offset.

    With `path` the same messages are read from NDJSON files, which needs no connector on the class path.
    """
    if path is not None:
        return spark.readStream.schema(schema).options(**options).json(path)
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
        .select(F.col("offset").alias("kafka_offset"),
                F.from_json(F.col("value").cast("string"), schema).alias("message"))
        .select("kafka_offset", "message.*")
    )
