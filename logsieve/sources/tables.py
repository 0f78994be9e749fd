"""Table readers and sinks: feature tables, run and version listings, versioned tables, state values."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.schema import FEATURES, LABEL
from logsieve.session import path_exists, store

STATE = "name string, value string, at timestamp"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The 18 features and the label; a missing column fails when the plan is analysed."""
    return spark.read.parquet(path).select(*FEATURES, LABEL)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_node_splits(df: DataFrame, path: str, node: str = "node") -> None:
    """One directory per node; a row that belongs to two nodes is in both."""
    df.write.mode("overwrite").partitionBy(node).parquet(path)


def read_runs(runs: DataFrame, experiment: str, n: int = 5) -> DataFrame:
    """Newest runs of an experiment."""
    return (
        runs.filter(F.col("experiment") == experiment)
        .orderBy(F.desc("start_time"), "run_id")
        .limit(n)
    )


def read_model_versions(versions: DataFrame, name: str) -> DataFrame:
    return versions.filter(F.col("name") == name).select("version", "stage", "run_id")


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows when nothing was written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def spread(scan: DataFrame, again: bool = False) -> DataFrame:
    """Spread a scan over all cores before CPU-heavy work when its files give fewer partitions than that.

    Only for a plain scan. A large table has many more partitions than there are cores and is returned as it is. With
    `again` the spread rows are stored, for work that scans them several times.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    wide = scan.repartition(cores)
    return store(wide) if again else wide


# State values -------------------------------------------------------------------------------------------------


def put_state(spark: SparkSession, path: str, name: str, value: str) -> None:
    """Append one value; readers take the latest, so a failed job never leaves a half-written value."""
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(value).alias("value"),
                                F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(path)


def get_state(spark: SparkSession, path: str, name: str, default: str | None = None) -> str | None:
    state = read_or_empty(spark, path, STATE).filter(F.col("name") == name)
    found = state.agg(F.max_by("value", "at").alias("value")).first()["value"]
    return default if found is None else found


def advance_watermark(spark: SparkSession, path: str, name: str = "last_train_ts",
                      at: datetime | None = None) -> str:
    """Store the time of the last complete run. Call it after every other step of the run."""
    value = (at or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    put_state(spark, path, name, value)
    return value


# Versioned tables ---------------------------------------------------------------------------------------------


class VersionedTable:
    """A Parquet table that is rewritten to a new folder and then switched over by a state value.

    Readers of the old version are not disturbed, and a job that dies before the switch changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def version(self) -> int:
        return int(get_state(self.spark, f"{self.root}/state", "version", "0"))

    def read(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/v={self.version()}", self.schema)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        version = self.version() + 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/v={version}")
        put_state(self.spark, f"{self.root}/state", "version", str(version))
        return version


# Retention ----------------------------------------------------------------------------------------------------


def retained(df: DataFrame, ts: Column | str, days: int, now: Column | None = None) -> DataFrame:
    """Rows younger than the retention period."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return df.filter(ts > (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))


def expired_partitions(spark: SparkSession, root: str, days: int, today: datetime,
                       column: str = "date") -> list[str]:
    """Folders `column=yyyy-mm-dd` under `root` that are past the retention period."""
    jroot = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jroot.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(jroot) if s.isDirectory()]
    limit = (today - timedelta(days=days)).strftime("%Y-%m-%d")
    return sorted(n for n in names if n.startswith(f"{column}=") and n.split("=", 1)[1] < limit)


def drop_expired_partitions(spark: SparkSession, root: str, days: int, today: datetime,
                            column: str = "date") -> list[str]:
    """Remove the folders that `expired_partitions` names; returns them."""
    expired = expired_partitions(spark, root, days, today, column)
    for name in expired:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    return expired
