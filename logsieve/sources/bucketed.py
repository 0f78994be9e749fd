"""A keyed table that an upsert rewrites in part: copy on write, a folder per bucket, a manifest per version.

A row's bucket is a hash of its key. An upsert reads and writes the buckets that its source touches; the manifest of the
new version names their new folders and the old ones of all others. A version is switched over by a state value, so a
reader of an earlier manifest sees no change and a job that dies before the switch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.session import path_exists
from logsieve.sources.tables import get_state, put_state

BUCKETS = 256
MANIFEST = "bucket int, folder string"


class BucketedTable:
    """`schema` is that of the rows; `key` is the column whose hash, in `buckets` parts, tells a row's bucket."""

    def __init__(self, spark: SparkSession, root: str, schema, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        return int(get_state(self.spark, f"{self.root}/state", "version", "0"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows: at most as many entries as buckets."""
        path = f"{self.root}/manifest/v={self.version() if version is None else version}"
        if not path_exists(self.spark, path):
            return {}
        return {r.bucket: r.folder for r in self.spark.read.schema(MANIFEST).parquet(path).collect()}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(folders))

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the current one by default, or those of some buckets."""
        found = self.manifest(version)
        return self._rows([f for b, f in found.items() if buckets is None or b in buckets])

    def touched(self, source: DataFrame) -> set[int]:
        return {r.b for r in source.select(self.bucket().alias("b")).distinct().collect()}      # a row per bucket at most

    def upsert(self, source: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Makes `merge(target, source)` the rows of the buckets that `source` touches; returns those buckets.

        `target` are the rows of these buckets. The merge must not move a row to another key. Rows are shuffled by
        bucket once, so that a bucket is one folder; a bucket that is left without rows leaves the manifest.
        """
        buckets = self.touched(source)
        if not buckets:
            return []
        old, version = self.manifest(), self.version()
        target = self._rows([f for b, f in old.items() if b in buckets])
        folder = f"{self.root}/data/{version + 1:09d}-{uuid.uuid4().hex}"
        merged = merge(target, source).withColumn("_bucket", self.bucket())
        merged.repartition(min(len(buckets), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(folder)
        self._switch({b: f for b, f in old.items() if b not in buckets} | self._written(folder), version + 1)
        return sorted(buckets)

    def _written(self, folder: str) -> dict[int, str]:
        found = self.spark.read.schema("_bucket int").parquet(folder).distinct().collect()      # a row per bucket at most
        return {r._bucket: f"{folder}/_bucket={r._bucket}" for r in found}

    def _switch(self, manifest: dict[int, str], version: int) -> None:
        rows = self.spark.createDataFrame(sorted(manifest.items()), MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        put_state(self.spark, f"{self.root}/state", "version", str(version))

    def write(self, df: DataFrame) -> int:
        """Replaces all rows."""
        version = self.version()
        folder = f"{self.root}/data/{version + 1:09d}-{uuid.uuid4().hex}"
        df.withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(folder)
        self._switch(self._written(folder), version + 1)
        return version + 1
