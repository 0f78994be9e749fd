"""Offline dataset build: labelled sources to one feature table, node datasets and a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.scalars import text
from logsieve.operators.encode import encode
from logsieve.operators.features import CATEGORICAL, CLOUDTRAIL, OFFLINE, Dialect, conform, flatten_events, member_columns
from logsieve.operators.labels import constant_label, rule_label
from logsieve.operators.quality import node_report, quality_report, union_sources, verdict
from logsieve.operators.split import NODE_PATTERNS, node_split
from logsieve.schema import FEATURES, LABEL
from logsieve.session import store
from logsieve.sources.tables import write_features, write_node_splits

KEYS = ("event_id", "raw_source")


def labelled_rule(events: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    m = member_columns(events, layout)
    return events.withColumn(LABEL, rule_label(m["error_code"], m["event_name"], m["identity_type"]))


def labelled_constant(events: DataFrame, value: int = 1) -> DataFrame:
    return events.withColumn(LABEL, constant_label(value))


def feature_table(sources: dict[str, DataFrame], dialect: Dialect = OFFLINE,
                  layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """Union of labelled sources as `event_id, raw_source, source, features, label`.

    Dictionary codes are fitted on the union. `raw_source` stays so that the node split needs no realignment.
    """
    flat = {}
    for name, events in sources.items():
        m = member_columns(events, layout)
        keyed = events.withColumn("event_id", m["event_id"]).withColumn("raw_source", text(m["event_source"]))
        flat[name] = flatten_events(keyed, dialect, {**layout, "event_id": "event_id"}, (*KEYS, LABEL))
    table = union_sources(flat)
    if dialect.encode == "dictionary":
        table = store(table)        # parse the logs once: the dictionaries need a pass of their own
        table = encode(table, {f"{c}_raw": f"{c}_enc" for c in CATEGORICAL})
    return conform(table, keep=(*KEYS, "source"), label=LABEL)


def build_dataset(sources: dict[str, DataFrame], out: str, min_rows: int, min_node_rows: int,
                  dialect: Dialect = OFFLINE, layout: dict[str, str] = CLOUDTRAIL) -> DataFrame:
    """Write the feature table and the node datasets, then check what was written.

    Returns the report of both; `verdict` of it says whether the next step may run.
    """
    spark = next(iter(sources.values())).sparkSession
    table = feature_table(sources, dialect, layout)
    write_features(table, f"{out}/processed")
    stored = spark.read.parquet(f"{out}/processed")
    nodes = node_split(stored, "raw_source", "event_id", NODE_PATTERNS, min_node_rows)
    write_node_splits(nodes.select("event_id", "node", *FEATURES, LABEL), f"{out}/federated")
    written = spark.read.parquet(f"{out}/federated")
    return quality_report(stored, min_rows).unionByName(node_report(written, list(NODE_PATTERNS), min_node_rows))


def require_passed(report: DataFrame) -> None:
    """Stop the run when a check failed."""
    if verdict(report).first()["failed"]:
        failed = [r["check"] for r in report.filter(~F.col("passed")).select("check").collect()]
        raise ValueError(f"quality gate failed: {failed}")
