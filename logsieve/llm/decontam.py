"""Documents that contain a benchmark item, whole, within an edit budget.

A budget of k edits leaves one of k + 1 disjoint pieces of an item untouched, wherever the edits fall. An automaton
finds all exact hits of all pieces in one walk over a text, and each hit is verified around its place with Myers' bit
parallel edit distance, the item's characters being the bits of one integer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from logsieve.llm.texts import packed, shipped, slices
from logsieve.session import shared_dir, store

CHARS_PER_EDIT = 16         # an item may differ in one character of so many
BLOCK_CHARS = 1_000_000     # of items that one pass over the documents searches: the bound on what is sent out

#: Every ASCII character but letters and digits becomes a space.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> str:
    """Lower case, runs of ASCII punctuation and white space as one space, none at the ends."""
    return b" ".join((text or "").lower().encode().translate(_PLAIN).split()).decode()


def budget(item: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return len(item) // chars_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): `edits` + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def least_distance(item: str, text: str) -> int:
    """Smallest edit distance between `item` and any part of `text`."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) >> 1
    up, down, score, best = full, 0, len(item), len(item)
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(horizontal | up)), up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return best


class Searcher:
    """All places where one of the items may stand, verified."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(item_id, text, budget(text, chars_per_edit)) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least number of edits) for each item within its budget."""
        starts: dict[int, list[int]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for n, offset in at:
                starts.setdefault(n, []).append(end + 1 - length - offset)
        found = []
        for n, near in starts.items():
            item_id, item, edits = self.items[n]
            if item in text:
                found.append((item_id, 0))
                continue
            best, reach = edits + 1, -1
            windows: list[list[int]] = []
            for s in sorted(near):              # overlapping windows are one
                a, b = max(0, s - edits), s + len(item) + edits
                if a <= reach:
                    windows[-1][1] = reach = max(reach, b)
                else:
                    windows.append([a, b])
                    reach = b
            best = min([best, *(least_distance(item, text[a:b]) for a, b in windows)])
            if best <= edits:
                found.append((item_id, best))
        return sorted(found)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    for row in rows.toLocalIterator(prefetchPartitions=True):
        item = plain(row.text)
        if not item:
            continue
        if block and chars + len(item) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row.item_id, item))
        chars += len(item)
    if block:
        yield block


def _search(docs: DataFrame, block: Callable[[], list[tuple[int, str]]], item_type: DataType, chars_per_edit: int) -> DataFrame:
    """(doc_id, item_id, edits) of one block of items."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, edits int"
    arrow = to_arrow_type(item_type)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block(), chars_per_edit)
        for batch in slices(batches):
            at, items, edits = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for item_id, e in searcher.find(plain(text)) if text else ():
                    at.append(i)
                    items.append(item_id)
                    edits.append(e)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), pa.array(items, arrow), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "edits"])

    return docs.select("doc_id", "text").mapInArrow(apply, schema)


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits): every document and item that stands in it within the item's budget.

    Texts and items are compared whole, in lower case, with runs of ASCII punctuation and white space as one space; an
    item of n such characters may differ by n // `chars_per_edit` edits. Null or empty texts contain nothing, null or
    empty items are in nothing. Equal rows give equal results; a benchmark with the same id twice gives a row for each
    of its texts. The items are searched in blocks of `block_chars`, one pass over the documents for each; where there
    are several, a pass is written before the next block is read, so the driver holds one at a time. Ids may be of any
    type. Only doc_id, item_id and text are read, so extra columns cannot clash; an empty table on either side gives no
    rows.
    """
    spark, item_type = docs.sparkSession, benchmark.schema["item_id"].dataType
    blocks = _blocks(benchmark, block_chars)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return _search(docs.filter(F.lit(False)), list, item_type, chars_per_edit)
    if after is None:
        return _search(docs, shipped(spark, block), item_type, chars_per_edit)
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    while block:
        out = _search(docs, shipped(spark, block), item_type, chars_per_edit)
        out.write.mode("append").parquet(path)
        block, after = after, next(blocks, None)
    return spark.read.schema(out.schema).parquet(path)


def without_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no item, with their columns.

    A row is judged by its text alone, so rows without an id or with the same one are kept or go like any other. Null
    and empty texts stay; very long texts are searched whole; extra columns stay whatever their names; an empty table
    gives an empty result, an empty benchmark all rows. The distinct digests of leaking texts are written, a block of
    the benchmark at a time, and rows are taken out by them; the join broadcasts them only where their table is small.
    """
    digest = F.unhex(F.sha2("text", 256))
    found = store(matches(docs.select(digest.alias("doc_id"), "text").filter("text <> ''"), benchmark, chars_per_edit, block_chars)
                  .select(F.col("doc_id").alias("_dirty")).distinct())
    return packed(docs).join(found, F.unhex(F.sha2("_row.text", 256)) == F.col("_dirty"), "left_anti").select("_row.*")
