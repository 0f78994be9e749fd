"""Lines that many documents share, dropped everywhere but in one document.

Two Bloom filters find the suspects: a bit of the first is set by keys seen in one document, a bit of the second by
keys that found their bits in the first already. Every task fills its own pair and pairs merge as
(once | once', twice | twice' | once & once'), so a key held by two documents has all its bits in the merged second
filter whichever tasks read them. Only suspects leave the scan; they are counted exactly by their text, so a wrong
suspect costs a shuffled row and never a wrong result. The filters have a fixed size. Where a corpus outgrows it more
lines count as suspects; `bits` is the parameter to raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from logsieve.llm.texts import SPACE, packed, shipped, slices
from logsieve.session import store

BITS = 1 << 27              # of each filter: 16 MB, the size of what is broadcast
HASHES = 4
SEGMENT = 1 << 20           # bits that merge together
MOST_SENT = 1 << 18         # repeated keys whose digests are sent to the tasks, 24 bytes each
FAN_IN = 64                 # partial filters that one merge step reads
_STRIP = SPACE.encode()


def line_keys(text: str | None) -> list[bytes]:
    """Keys of the lines in order: both ends stripped of [\\x20\\x09-\\x0D], A-Z in lower case; UTF-8."""
    return [line.strip(_STRIP) for line in (text or "").encode().lower().split(b"\n")]


def long_keys(text: str | None, min_chars: int) -> set[bytes]:
    """The distinct keys that have at least `min_chars` code points."""
    return {k for k in line_keys(text) if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)}


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of each hash, one column per hash function."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(j) * high) % np.uint64(bits) for j in range(HASHES)], axis=1).astype(np.int64)


class Pair:
    """A once-seen and a twice-seen filter."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    @staticmethod
    def put(filter_: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(filter_, at.ravel() >> 3, (1 << (at.ravel() & 7)).astype(np.uint8))

    @staticmethod
    def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        """Adds keys; a key of two documents is there twice."""
        one, counts = np.unique(hashes, return_counts=True)
        at = places(one, self.bits)
        self.put(self.twice, at[(counts > 1) | self.has(self.once, at)])
        self.put(self.once, at)


def _pack(part: np.ndarray) -> bytes:
    """A segment as the places of its bits where few are set, else as it is."""
    at = np.flatnonzero(np.unpackbits(part, bitorder="little")).astype("<u4")
    return b"s" + at.tobytes() if at.nbytes < part.nbytes else b"d" + part.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"d":
        return np.frombuffer(data, np.uint8, offset=1)
    part = np.zeros(SEGMENT >> 3, np.uint8)
    Pair.put(part, np.frombuffer(data, "<u4", offset=1).astype(np.int64))
    return part


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> bytes:
    """The merged twice-seen filter of `docs` (doc_id, text)."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = Pair(bits), TaskContext.get().partitionId()
        for batch in slices(batches):
            hashes = [xxhash.xxh3_64_intdigest(k) for t in batch.column("text").to_pylist() for k in long_keys(t, min_chars)]
            if hashes:
                pair.add(np.array(hashes, np.uint64))
        step = SEGMENT >> 3
        for s in range(bits // SEGMENT):
            once, twice = (f[s * step:(s + 1) * step] for f in (pair.once, pair.twice))
            if once.any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([s], pa.int32()), "task": pa.array([task], pa.int32()),
                    "once": pa.array([_pack(once)], pa.binary()), "twice": pa.array([_pack(twice)], pa.binary())})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT >> 3, np.uint8), np.zeros(SEGMENT >> 3, np.uint8)
        for o, t in zip(parts["once"], parts["twice"]):
            o = _unpack(o)
            twice |= _unpack(t) | (once & o)
            once |= o
        return pd.DataFrame({"segment": parts["segment"][:1], "task": parts["task"][:1] // FAN_IN,
                             "once": [_pack(once)], "twice": [_pack(twice)]})

    schema = "segment int, task int, once binary, twice binary"
    tasks, parts = docs.rdd.getNumPartitions(), docs.select("text").mapInArrow(fill, schema)
    while tasks > FAN_IN:
        parts = parts.groupBy("segment", F.floor(F.col("task") / FAN_IN).alias("_to")).applyInPandas(merge, schema)
        tasks = -(-tasks // FAN_IN)
    parts = parts.groupBy("segment").applyInPandas(merge, schema)
    merged = np.zeros(bits >> 3, np.uint8)
    for row in parts.select("segment", "twice").toLocalIterator(prefetchPartitions=True):   # bits / 8 bytes in all
        merged[row.segment * (SEGMENT >> 3):(row.segment + 1) * (SEGMENT >> 3)] = _unpack(bytes(row.twice))
    return merged.tobytes()


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Suspects (key, doc_id), and (repeated, keeper): the keys that `min_docs` documents hold and the largest id of them."""
    if bits % SEGMENT:
        raise ValueError(f"bits must be a multiple of {SEGMENT}")
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    id_type = docs.schema["doc_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, min_chars, bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(sent.value, np.uint8)
        for batch in slices(batches):
            at, keys = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = long_keys(text, min_chars)
                keys += own
                at += [i] * len(own)
            if not keys:
                continue
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            hit = np.flatnonzero(Pair.has(twice, places(hashes, bits)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i].decode() for i in hit], pa.string()), batch.column("doc_id").take(pa.array([at[i] for i in hit], pa.int64()))],
                names=["key", "doc_id"])

    suspects = store(docs.mapInArrow(probe, f"key string, doc_id {id_type.simpleString()}").distinct())
    repeated = store(
        suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select(F.col("key").alias("repeated"), "keeper"))
    return suspects, repeated


def _without(text: str | None, goes: Callable[[bytes], bool]) -> tuple[str, int, int]:
    """(text, lines, dropped lines) of a text whose lines go where `goes` says so of their key."""
    text = text or ""
    lines = text.split("\n")
    kept = [line for line, key in zip(lines, line_keys(text)) if not goes(key)]
    return (text if len(kept) == len(lines) else "\n".join(kept)), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int = BITS, most_sent: int = MOST_SENT) -> DataFrame:
    """`docs` as struct `_row` and struct `_cut` (text, n_lines, n_dropped): the text without repeated lines.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z in lower case. Keys of `min_chars`
    code points or more that `min_docs` documents or more hold lose all their lines, save in the document with the
    largest id that holds them. A null or empty text is one empty line, and a text that loses all its lines is empty.
    Rows without an id keep their text and count for no key. Rows with the same id are one document. Extra columns,
    whatever their names, stay in `_row`; an empty table gives an empty result.

    Where ids are integers and `most_sent` or fewer keys repeat, their digests and keepers are sent to the tasks and
    texts are cut where they are read; else each document is joined with the keys that it loses.
    """
    suspects, repeated = repeated_lines(docs, min_chars, min_docs, bits)
    schema = "text string, n_lines bigint, n_dropped bigint"
    if isinstance(docs.schema["doc_id"].dataType, IntegralType) and repeated.count() <= most_sent:
        rows = repeated.select(F.unhex(F.md5("repeated")).alias("digest"), "keeper").toLocalIterator()
        sent = shipped(docs.sparkSession, {bytes(r.digest): str(r.keeper) for r in rows})

        @F.pandas_udf(schema)
        def cut_here(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            keepers = sent()
            for texts, ids in parts:
                out = []
                for text, own in zip(texts, ids):
                    def goes(key: bytes, own: str | None = own) -> bool:
                        return len(key) >= min_chars and own is not None and keepers.get(hashlib.md5(key).digest(), own) != own
                    out.append(_without(text, goes))
                yield pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

        return packed(docs).select("_row", cut_here("_row.text", F.col("_row.doc_id").cast("string")).alias("_cut"))

    drops = (
        suspects.join(repeated, F.col("key") == F.col("repeated")).filter("doc_id <> keeper")
        .groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("key").alias("_drops")))

    @F.pandas_udf(schema)
    def cut(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        out = [_without(text, (set() if gone is None else {k.encode() for k in gone}).__contains__) for text, gone in zip(texts, dropped)]
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    joined = packed(docs).join(drops, F.col("_row.doc_id") == F.col("_id"), "left")
    return joined.select("_row", cut("_row.text", "_drops").alias("_cut"))
