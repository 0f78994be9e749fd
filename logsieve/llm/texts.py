"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"           # the characters [\x20\x09-\x0D]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of `value` and of the classes it is made of, so that workers need no copy of this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def longest_within(rows: DataFrame, column: str, total: int) -> int:
    """The length in bytes up to which all texts of `rows`, few by construction, have `total` bytes together at most."""
    spent, longest = 0, 0
    for length in sorted(r.n for r in rows.select(F.octet_length(column).alias("n")).filter("n is not null").collect()):
        spent += length
        if spent > total:
            return longest
        longest = length
    return longest


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `_row`, so that no name of an input column can clash with one of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", bytes_each: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice holds about `bytes_each` of the text column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * bytes_each / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def release_memory() -> None:
    """Gives back what Arrow and the C library keep of freed memory: a worker may have run other stages before this one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc alone has it
    if trim is not None:
        trim(0)
