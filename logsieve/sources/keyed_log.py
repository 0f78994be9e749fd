"""A log of batches that is asked for keys without being read whole: a key range and a Bloom filter for every file.

A batch is range-partitioned by its key into files, and each file has a row in the index: its name, its least and greatest
key and a filter of its keys. Asked for some keys, the index is probed in tasks, and only files that may hold one of them
are opened. What the files hold decides; the index never does, so an answer is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.session import path_exists

FILE_ROWS = 100_000
BITS_PER_KEY, HASHES = 12, 6
SENT_BYTES = 1 << 26        # of the keys that are asked for; beyond, every file may hold one
INDEX = "file string, n bigint, least string, greatest string, filter binary"


def _places(keys: list[str], bits: int) -> np.ndarray:
    digest = np.array([np.frombuffer(hashlib.blake2b(k.encode(), digest_size=16).digest(), "<u8") for k in keys], np.uint64).reshape(-1, 2)
    step = digest[:, 1] | np.uint64(1)
    return np.stack([(digest[:, 0] + np.uint64(j) * step) % np.uint64(bits) for j in range(HASHES)], axis=1).astype(np.int64)


def filter_of(keys: list[str]) -> bytes:
    """A Bloom filter of a file's keys, sized by their number."""
    bits = max(64, 8 * -(-len(keys) * BITS_PER_KEY // 8))
    flags = np.zeros(bits, bool)
    flags[_places(keys, bits).ravel()] = True
    return np.packbits(flags, bitorder="little").tobytes()


def may_hold(filter_: bytes, keys: list[str]) -> bool:
    bits = np.frombuffer(filter_, np.uint8)
    at = _places(keys, 8 * len(bits))
    return bool((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1).any())


class KeyedLog:
    """Rows of `schema`, in `{root}/batch_id=N`; `key` is a string column. Files end at `file_rows` rows."""

    def __init__(self, spark: SparkSession, root: str, schema, key: str, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.schema, self.key, self.file_rows = spark, root.rstrip("/"), schema, key, file_rows

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Writes a batch and its index; the same batch again replaces both. Rows without a key are in no filter."""
        folder = f"{self.root}/batch_id={batch_id}"
        rows = rows.persist()
        parts = max(1, -(-rows.count() // self.file_rows))
        sorted_ = rows.repartitionByRange(parts, self.key).sortWithinPartitions(self.key)
        sorted_.write.mode("overwrite").option("maxRecordsPerFile", self.file_rows).parquet(folder)
        rows.unpersist()
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        written = self.spark.read.schema(self.schema).parquet(folder).select(name.alias("file"), F.col(self.key).alias("key")).filter("key is not null")

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys: dict[str, set[str]] = {}
            for batch in batches:
                for f, k in zip(batch.column("file").to_pylist(), batch.column("key").to_pylist()):
                    keys.setdefault(f, set()).add(k)        # a file's rows, FILE_ROWS at most
            for f, own in keys.items():
                yield pa.RecordBatch.from_pydict({"file": [f], "n": pa.array([len(own)], pa.int64()), "least": [min(own)], "greatest": [max(own)],
                                                  "filter": pa.array([filter_of(sorted(own))], pa.binary())})

        files = written.repartition(max(1, min(parts, self.spark.sparkContext.defaultParallelism)), "file").sortWithinPartitions("file")
        files.mapInArrow(index, INDEX).write.mode("overwrite").parquet(f"{self.root}_index/batch_id={batch_id}")

    def files_for(self, keys: DataFrame, before: int | None = None) -> list[str]:
        """Names of the files of batches below `before` that may hold one of the `keys` (a string column `key`)."""
        if not path_exists(self.spark, f"{self.root}_index"):
            return []
        index = self.spark.read.schema(INDEX).option("basePath", f"{self.root}_index").parquet(f"{self.root}_index")
        if "batch_id" not in index.columns:
            return []
        index = index.filter(F.col("batch_id") < before) if before is not None else index
        asked = keys.select("key").filter("key is not null").distinct().persist()
        bytes_ = asked.agg(F.sum(F.octet_length("key") + 56)).first()[0] or 0
        if bytes_ <= SENT_BYTES:
            sent = self.spark.sparkContext.broadcast(sorted(r.key for r in asked.collect()))

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = np.array(sent.value, object)
                for batch in batches:
                    hit = []
                    for least, greatest, filter_ in zip(*(batch.column(c).to_pylist() for c in ("least", "greatest", "filter"))):
                        inside = own[np.searchsorted(own, least):np.searchsorted(own, greatest, side="right")]
                        hit.append(len(inside) > 0 and may_hold(filter_, inside.tolist()))
                    yield pa.RecordBatch.from_arrays([batch.column("batch_id"), batch.column("file")], names=["batch_id", "file"]).filter(pa.array(hit))

            index = index.withColumn("batch_id", F.col("batch_id").cast("bigint")).mapInArrow(probe, "batch_id bigint, file string")
        found = [f"{self.root}/batch_id={r.batch_id}/{r.file}" for r in index.select("batch_id", "file").collect()]     # a name per file
        asked.unpersist()
        return sorted(found)

    def rows_for(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of earlier batches whose key is among `keys`: only files that may hold one are read."""
        files = self.files_for(keys, before)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        held = self.spark.read.schema(self.schema).parquet(*files)
        wanted = keys.select(F.col("key").alias("_asked")).distinct()
        return held.join(wanted, F.col(self.key) == F.col("_asked"), "left_semi")
