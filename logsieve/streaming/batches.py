"""Output that survives replay: every micro-batch owns one folder per table and overwrites it when it runs again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.session import path_exists


def write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def read_batches(spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, so that a repeated batch does not meet its own rows."""
    if not path_exists(spark, table):
        return spark.createDataFrame([], schema)
    columns = schema.fieldNames() if hasattr(schema, "fieldNames") else [c.split()[0] for c in schema.split(",")]
    stored = spark.read.schema(schema).option("basePath", table).parquet(table)
    if "batch_id" not in stored.columns:
        return stored
    rows = stored if before is None else stored.filter(F.col("batch_id").cast("bigint") < before)
    return rows.select(*columns)


def start(stream: DataFrame, process, checkpoint: str, every: str | None = None):
    """Run `process(batch, batch_id)` per micro-batch; the offset is committed only after it returns.

    Without `every` the query works off what is there and stops.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for the streams that start inside."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)
