"""SimHash fingerprints and near-duplicate classes by Golay-code fuzzy hashing.

The perfect binary Golay code puts every 23-bit word within three bits of exactly one codeword. A word's keys are the
information bits of the codewords within four bits: one key where the nearest codeword is at most two bits away, else
six. Words that differ in at most one bit then share a key (in fact at most two; `tests/llm` checks every case). A
fingerprint has three segments. Where two fingerprints differ in two bits at most, some segment is equal and the one
after it differs in one bit at most, so both emit the same (segment, its bits, Golay key of the next segment). Equal
keys are joined and every pair is verified on all 64 bits.

A key that many different fingerprints share would make a quadratic number of pairs. Its fingerprints are linked
through midpoints instead: two fingerprints are within two bits exactly if some word is within one bit of both, and at
most 65 fingerprints are within one bit of a word. So groups stay small and no link is lost, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.components import components
from logsieve.llm.texts import packed, slices
from logsieve.session import store

SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 2
SEGMENTS = [(0, 22), (22, 21), (43, 21)]      # first bit and width; narrower than 23, the rest is zero
PAIR_BUCKET = 64                              # fingerprints under one key that are compared in pairs
GENERATOR = 0b101011100011                    # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def key_errors() -> np.ndarray:
    """For each syndrome the error patterns of weight at most four, six a row, -1 where there are fewer."""
    patterns = [0]
    for i in range(23):
        patterns.append(1 << i)
        for j in range(i):
            patterns.append(1 << i | 1 << j)
            for k in range(j):
                patterns.append(1 << i | 1 << j | 1 << k)
                patterns += [1 << i | 1 << j | 1 << k | 1 << m for m in range(k)]
    patterns = np.array(sorted(patterns))
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for s, e in zip(_syndrome(patterns), patterns):
        table[s, used[s]] = e
        used[s] += 1
    return table


def golay_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The 12-bit codeword indices near each 23-bit word: (n, 6), -1 where there are fewer than six."""
    errors = table[_syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fuzzy_keys(fingerprints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each 64-bit fingerprint; at most eighteen a row."""
    words = [(fingerprints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for s, word in enumerate(words):
        near = golay_keys(words[(s + 1) % 3], table)
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((s << 34) | (word[row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str | None, n: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of the text's shingles of n words: A-Z in lower case, runs of [\\x20\\x09-\\x0D] as separators."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-n]).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1:] - 1).tolist())]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """A bit is set if it is set in over half of the text's hashes; no words: zero."""
    out = np.zeros(len(texts), np.uint64)
    hashes = [np.array(shingle_hashes(t), "<u8") for t in texts]
    for i, h in enumerate(hashes):
        if len(h):
            counts = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                part = h[at:at + (1 << 16)]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint of each whole text, the 64 bits read as a signed number."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints_of(batch.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {id_type}, fp bigint")


def _differ(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def links(fps: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a < b) between the distinct fingerprints of `fps` (fp) that differ in two bits at most.

    Every such pair is connected by links, if not always by one of its own: the fingerprints around a midpoint are
    linked to the smallest of them.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = key_errors()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fp.view(np.uint64), table)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    keyed = store(fps.select("fp").mapInArrow(emit, "key bigint, fp bigint"))
    shared = store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("shared"), "n"))
    met = store(keyed.join(shared, F.col("key") == F.col("shared")).select("key", "fp", "n"))

    few = met.filter(F.col("n") <= pair_bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = few.select(F.explode(F.flatten(F.transform("fps", lambda x: F.transform(
        F.filter("fps", lambda y: (y > x) & (_differ(x, y) <= DISTANCE)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e"))

    many = met.filter(F.col("n") > pair_bucket).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"))
    stars = (
        around.groupBy("midpoint").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b")).filter("a < b"))
    return pairs.select("e.a", "e.b").union(stars.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links of at most two bits.

    Texts without words, null texts among them, have fingerprint zero and link like any other. A row without an id is
    kept with the class of its fingerprint; a class in which no row has an id has a null one. Equal rows are equal
    members. Only doc_id and text are read, so extra columns cannot clash; an empty table gives an empty result.
    """
    prints = store(with_fingerprint(docs))
    same = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(same.select("fp"), pair_bucket))
    classes = same.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("class"), "least")
    least = store(classes.groupBy("class").agg(F.min("least").alias("component_id")))
    classes = store(classes.select(F.col("fp").alias("print"), F.col("class").alias("of")))
    by_print = store(classes.join(least, F.col("of") == F.col("class")).select("print", "component_id"))
    return prints.join(by_print, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """One document of each class of `near_duplicates`, that with its smallest id, with its columns.

    Of rows that share the id, those whose own fingerprint is the least in the class are one document, and the one with
    the least text stays; texts of other classes under the same id are not lost, as their class keeps a row of its own.
    Texts without words, null texts among them, are one class. Rows without an id all stay, as no class can name them.
    Very long texts are read whole, extra columns stay whatever their names, an empty table gives an empty result.
    """
    prints = store(with_fingerprint(docs.filter("doc_id is not null")))
    roots = components(links(prints.select("fp").distinct(), pair_bucket))
    same = prints.groupBy("fp").agg(F.min("doc_id").alias("_id"))
    lead = (
        same.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("class"))
        .agg(F.min(F.struct("_id", "fp")).alias("l")).select(F.col("l._id").alias("_lead"), F.col("l.fp").alias("_print")))
    # an id with texts of several fingerprints: which of its rows lead is told by the text
    mixed = prints.groupBy(F.col("doc_id").alias("_id")).agg((F.min("fp") < F.max("fp")).alias("_mixed"))
    lead = store(lead.join(mixed, F.col("_lead") == F.col("_id")).select("_lead", "_print", "_mixed"))

    @F.pandas_udf("boolean")
    def leads(texts: pd.Series, prints: pd.Series) -> pd.Series:      # needs both sides of the join, so only its rows get here
        return pd.Series(fingerprints_of(texts.tolist()).view(np.int64) == prints.to_numpy(), index=texts.index)

    rows = packed(docs)
    led = rows.join(lead, F.col("_row.doc_id") == F.col("_lead"))
    told = led.filter("_mixed").filter(leads(F.coalesce("_row.text", F.lit("")), F.col("_print")))
    first = (
        led.filter("not _mixed").union(told).groupBy("_lead", "_print")
        .agg(F.min_by("_row", F.coalesce("_row.text", F.lit(""))).alias("_row")).select("_row"))
    return first.union(rows.filter("_row.doc_id is null")).select("_row.*")
