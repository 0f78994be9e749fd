"""Corpora as files of token ids: frequency-ranked, byte-aligned variable length, with separate control bytes.

Ids are replaced by their rank in the corpus, so that frequent ones take one byte. A value takes one to four bytes;
two bits say how many, four values share a control byte, and control and data bytes are kept apart. A decoder looks
four lengths up at once for each control byte and gathers all values without a loop.

A file is a sequence of blocks, each with consecutive documents in ascending order of their id:
    magic `RIDS`, version u4, bytes of control and data u8, documents u4, tokens u8, ids before the first document u8,
    a null flag (u1) and an id (i8) per document, its tokens u8 per document, control bytes, data bytes;
all numbers little-endian. `ranks` beside the files holds the id (u4) of each rank.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logsieve.llm.bpe import encoder, release_encoders
from logsieve.llm.texts import slices
from logsieve.session import shared_dir

FILE_TOKENS = 4_000_000     # a file ends with the block that reaches this
BLOCK_TOKENS = 250_000      # a block ends with the document that reaches this: what a task holds
FILES_PER_TASK = 4          # that a task reads, about
_HEAD = "<4sIQIQQ"
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    values = values.astype("<u4")
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros((n, 4), np.uint8)
    for j in range(4):
        has = lengths > j
        out[has, j] = padded[starts[has] + j]
    return out.view("<u4").ravel()


def write_block(ids: list[int | None], counts: np.ndarray, ranks: np.ndarray, before: int) -> bytes:
    control, data = encode_values(ranks)
    head = struct.pack(_HEAD, b"RIDS", 2, len(control) + len(data), len(ids), len(ranks), before)
    nulls = np.array([i is None for i in ids], np.uint8)
    return b"".join([head, nulls.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), counts.astype("<u8").tobytes(), control, data])


def read_blocks(file: BinaryIO, id_of_rank: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, int]]:
    """(document ids, tokens per document, token ids, ids before the first document) of each block of an open file."""
    while head := file.read(struct.calcsize(_HEAD)):
        magic, version, size, docs, n, before = struct.unpack(_HEAD, head)
        if magic != b"RIDS" or version != 2:
            raise ValueError("not a file of ranked ids")
        nulls = np.frombuffer(file.read(docs), np.uint8)
        ids = np.frombuffer(file.read(8 * docs), "<i8")
        counts = np.frombuffer(file.read(8 * docs), "<u8").astype(np.int64)
        coded, controls = file.read(size), -(-n // 4)
        yield [None if null else int(i) for null, i in zip(nulls, ids)], counts, id_of_rank[decode_values(coded[:controls], coded[controls:], n)], before


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def tokenised(docs: DataFrame, path: str, kind: str, end_id: int, wide: str) -> DataFrame:
    """(shard, before, doc_id, n, ids): documents in ascending order; `before` counts the ids before them in the shard."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(1, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, before = encoder(path, kind).encode, TaskContext.get().partitionId(), 0
        for batch in slices(batches, bytes_each=8_000_000):
            ids, bounds = encode(batch.column("text"))
            own = [np.append(ids[a:b], end_id).astype(wide) for a, b in zip(bounds[:-1], bounds[1:])]
            counts = np.array([len(o) for o in own], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), shard, np.int32)), pa.array(before + np.cumsum(counts) - counts), batch.column("doc_id"),
                 pa.array(counts), pa.array([o.tobytes() for o in own], pa.binary())], names=["shard", "before", "doc_id", "n", "ids"])
            before += int(counts.sum())

    return docs.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).mapInArrow(
        ids_of, "shard int, before bigint, doc_id bigint, n bigint, ids binary")


def write_tokens(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 2) -> str:
    """Writes the texts of `docs` as files of ids into a new folder of the shared directory; returns the folder.

    A null text is empty; every document ends with `end_id`. Documents stand in ascending order of their id, a null id
    first; rows with the same id stand side by side. A file is written under a name of its own by each attempt of a
    task, and `manifest` lists those that count. The driver holds one number per shard and one per vocabulary entry, a
    task a block of a file. Ids must be integers. Only doc_id and text are read, so extra columns cannot clash; very
    long texts are whole; an empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    wide = "<u2" if size <= 1 << 16 else "<u4"
    tokenised(docs, path, kind, end_id, wide).write.option("compression", "zstd").parquet(f"{folder}/stage")
    stage = spark.read.schema("shard int, before bigint, doc_id bigint, n bigint, ids binary").parquet(f"{folder}/stage")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column("ids"):
                total += np.bincount(np.frombuffer(blob.as_buffer(), wide), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in stage.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.id] = row.n
    id_of_rank = np.argsort(-counts, kind="stable").astype("<u4")
    rank_of_id = np.argsort(id_of_rank, kind="stable").astype("<u4")
    system, base = _open(folder)
    with system.open_output_stream(f"{base}/ranks") as out:
        out.write(id_of_rank.tobytes())
    shards = sorted((r.shard, r.n) for r in stage.groupBy("shard").agg(F.sum("n").alias("n")).toLocalIterator())
    first = dict(zip([s for s, _ in shards], np.cumsum([0, *(n for _, n in shards)]).tolist()))
    sent = spark.sparkContext.broadcast((rank_of_id, first))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        rank_of, start_of = sent.value
        files, root = _open(folder)
        attempt = TaskContext.get().taskAttemptId()

        def block(before: int, ids: list, blobs: list) -> bytes:
            own = [np.frombuffer(b, wide) for b in blobs]
            return write_block(ids, np.array([len(o) for o in own]), rank_of[np.concatenate(own)], before)

        def done(name: str, docs: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [name], "docs": [docs]}, pa.schema([("name", pa.string()), ("docs", pa.int64())]))

        out, name, docs, begin = None, "", 0, 0         # the open file, and where it begins
        shard, first, next_, ids, blobs = -1, 0, 0, [], []
        try:
            for batch in batches:
                for s, before, doc_id, n, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "before", "doc_id", "n", "ids"))):
                    apart = s != shard or before != next_
                    if ids and (apart or next_ - first >= BLOCK_TOKENS):
                        out.write(block(start_of[shard] + first, ids, blobs))
                        docs, ids, blobs = docs + len(ids), [], []
                    if out is not None and not ids and (apart or next_ - begin >= FILE_TOKENS):
                        out.close()
                        out = None
                        yield done(name, docs)
                    if out is None:
                        name, docs, begin = f"{s:06d}-{before:015d}-{attempt}.ids", 0, before
                        out = files.open_output_stream(f"{root}/{name}")
                    if not ids:
                        shard, first = s, before
                    ids.append(doc_id)
                    blobs.append(blob)
                    next_ = before + n
            if ids:
                out.write(block(start_of[shard] + first, ids, blobs))
            if out is not None:
                out.close()
                out = None
                yield done(name, docs + len(ids))
        finally:
            if out is not None:
                out.close()

    stage.mapInArrow(write, "name string, docs bigint").write.parquet(f"{folder}/manifest")
    return folder


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids array) of the files that the folder's manifest names, or the ids' count and crc32 instead.

    A manifest without files gives no rows.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        with files.open_input_file(f"{root}/ranks") as f:
            id_of_rank = np.frombuffer(f.read(), "<u4")
        for name in (n for batch in batches for n in batch.column("name").to_pylist()):
            with files.open_input_file(f"{root}/{name}") as f:
                for ids, counts, tokens, before in read_blocks(f, id_of_rank):
                    ends = np.cumsum(counts)
                    columns = {"doc_id": pa.array(ids, pa.int64()), "start": pa.array(before + ends - counts)}
                    if digest:
                        parts = np.split(tokens.astype("<u4"), ends[:-1])
                        columns |= {"n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
                    else:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(columns)

    manifest = spark.read.schema("name string, docs bigint").parquet(f"{folder}/manifest").select("name")
    manifest = manifest.repartition(max(1, manifest.count() // FILES_PER_TASK), "name")     # a few small files hold all names
    return manifest.mapInArrow(read, "doc_id bigint, start bigint, " + ("n_tokens bigint, ids_crc32 bigint" if digest else "ids array<bigint>"))
