"""Fill-in-middle transformation of whole texts, a batch of Arrow columns at a time.

A text is cut into units: a run of white space with the word after it, or the white space at the end. Every step is an
Arrow kernel over a slice of the table: a mark behind each unit, a split at the marks, one flat array of all units with
the number of their text, ordinals in the text, a filter by role, lists rebuilt per role, and their pieces joined. UTF-8
has no byte 0xFF, so the mark cannot stand in a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.texts import slices

MARK = b"\xff"
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Plan:
    """Which texts are cut, how often the suffix comes first, and the control strings."""

    seed: int = 42
    rate: int = 50              # per cent of the texts that are cut
    spm: int = 80               # per cent of those whose suffix comes first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the id alone: a row is cut alike wherever and however often it is read."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def units_of(texts: pa.Array) -> pa.ListArray:
    """The units of each text (large_binary). The last element is what follows the last word and may be empty."""
    return pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\1" + MARK), MARK)


def joined(units: pa.Array, parent: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept units of each row, one after the other."""
    ends = np.cumsum(np.bincount(parent[keep], minlength=rows), dtype=np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), units.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def arranged(texts: pa.Array, h: list[np.ndarray], plan: Plan) -> dict[str, pa.Array]:
    """The columns n, form, prefix_chars, middle_chars, output for texts (large_binary) and their four numbers."""
    rows, marks = len(texts), [m.encode() for m in (plan.prefix, plan.suffix, plan.middle)]
    lists = units_of(texts)
    units, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.binary_length(units).to_numpy(zero_copy_only=False) > 0
    units, parent = units.filter(pa.array(real)), parent[real]
    n = np.bincount(parent, minlength=rows)
    ordinal = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
    a, b = (np.asarray(x, np.int64) % (n + 1) for x in h[:2])
    first, last = np.minimum(a, b)[parent], np.maximum(a, b)[parent]
    prefix, middle, suffix = (
        joined(units, parent, role, rows) for role in (ordinal < first, (first <= ordinal) & (ordinal < last), last <= ordinal))

    own = np.zeros(rows, bool)
    for mark in marks:
        own |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = own | (n == 0) | (np.asarray(h[2]) % 100 >= plan.rate)
    spm = np.asarray(h[3]) % 100 < plan.spm
    p, s, m, none = (pa.scalar(x, pa.large_binary()) for x in (*marks, b""))
    output = pc.if_else(
        pa.array(plain), texts,
        pc.if_else(pa.array(spm), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                   pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)))

    def chars(pieces: pa.Array) -> pa.Array:
        return pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(pieces.cast(pa.large_string())).cast(pa.int64()))

    form = pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM)), pa.string())
    return {"n": pa.array(n.astype(np.int64)), "form": form, "prefix_chars": chars(prefix), "middle_chars": chars(middle),
            "output": output.cast(pa.large_string()).cast(pa.string())}


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each whole text of `docs` (doc_id, text).

    `n` counts the units. A text that is null, empty or holds a control string stays as it is, in form plain, and so do
    those that the rate leaves out; their lengths are null. The cuts come from the id alone, so rows with equal ids are
    cut at the same numbers; a missing id counts as the empty text. Every row gives a row, repeated rows included. A
    slice of Arrow rows is handled at a time, a very long text by itself. Only doc_id and text are read, so extra
    columns cannot clash; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(drawn(F.col("doc_id"), plan.seed))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            out = arranged(texts, [batch.column(f"h{k}").to_numpy() for k in range(4)], plan)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.values()], names=["doc_id", *out])

    return numbered.mapInArrow(apply, f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output was made of. Its three pieces hold no control string, so each stands there once."""
    parts = F.split(output, "|".join("\\Q" + m + "\\E" for m in (plan.prefix, plan.suffix, plan.middle)))
    return (F.when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
            .when(form == SPM, F.concat(parts[2], parts[3], parts[1])).otherwise(output))
