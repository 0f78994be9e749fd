"""Token sequences of bounded length filled with documents, by best fit and swap-based local search.

A scan turns documents into pieces and keeps of each its length and checksum only. Tasks pack chunks of pieces as they
read them: best fit in falling order starts, then moves, one-for-one and two-for-one exchanges between underfull bins
raise the sum of squared fills, always from an emptier bin to a fuller one, until bins run empty or no exchange is
left. What is underfull then takes part in the next chunk of the task. No piece leaves its task, so there is no
shuffle and no group that could grow; a task ends with a part of a sequence unfilled at most where one exists that fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logsieve.llm.bpe import encoder
from logsieve.llm.texts import release_memory, slices
from logsieve.session import store

SEQUENCE = 2048
CHUNK = 16_384              # pieces packed together
CARRY = 512                 # underfull bins, the emptiest, whose pieces go on to the next chunk


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: falling lengths, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0                                        # bit g: a bin with gap g exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = some >> n
        if above:
            gap = n + (above & -above).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                some ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = size, len(bins)
            bins.append([i])
        by_gap[gap - n].append(b)
        some |= 1 << (gap - n)
    return bins


def _give(lengths: np.ndarray, own: list[int], fill: int, others: np.ndarray, at: np.ndarray, gaps: np.ndarray, fills: np.ndarray):
    """The exchange that takes most out of a bin: (items out, item back or None, receiving bin), or None.

    `others` are the items of the other bins and `at` their bins.
    """
    best, found = 0, None
    able = fills >= fill
    groups = [(x,) for x in dict.fromkeys(own)]
    sizes = {lengths[x]: x for x in own}
    if len(sizes) < len(own):
        groups = [(x,) for x in sizes.values()]
    groups += [(x, y) for i, x in enumerate(own) for y in own[:i]]
    seen = set()
    for out in groups:
        n = int(sum(lengths[x] for x in out))
        if n <= best or (len(out), n) in seen:
            continue
        seen.add((len(out), n))
        fits = able & (gaps >= n)
        if fits.any():                              # all of it moves, to where it leaves the least room
            r = int(np.argmin(np.where(fits, gaps, np.iinfo(np.int64).max)))
            best, found = n, (out, None, r)
            continue
        gain = n - lengths[others]
        gain = np.where((gain > best) & (gain <= gaps[at]) & able[at], gain, 0)
        if len(gain) and gain.max() > best:
            k = int(gain.argmax())
            best, found = int(gain[k]), (out, int(others[k]), int(at[k]))
    return found


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills; no bin is ever overfull."""
    fills = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    full = [b for b, f in zip(bins, fills) if f == size]
    bins, fills = [b for b, f in zip(bins, fills) if f < size], fills[fills < size]
    for donor in np.argsort(fills, kind="stable").tolist():
        if (size - fills[fills > 0]).sum() < size:  # the room left is less than a bin: none can be saved
            break
        while bins[donor]:
            alive = (fills > 0) & (fills < size)
            alive[donor] = False
            where = np.flatnonzero(alive)
            others = np.array([i for b in where for i in bins[b]], np.int64)
            at = np.repeat(where, [len(bins[b]) for b in where])
            gaps = np.where(alive, size - fills, -1)
            give = _give(lengths, bins[donor], int(fills[donor]), others, at, gaps, np.where(alive, fills, -1))
            if give is None:
                break
            out, back, to = give
            moved = int(sum(lengths[x] for x in out)) - (int(lengths[back]) if back is not None else 0)
            bins[donor] = [x for x in bins[donor] if x not in out] + ([back] if back is not None else [])
            bins[to] = [x for x in bins[to] if x != back] + list(out)
            fills[donor] -= moved
            fills[to] += moved
    return full + [b for b in bins if b]


def pieces(docs: DataFrame, path: str, kind: str = "word", end_id: int = 0, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids with an end id, cut where longer than `size`."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode = encoder(path, kind).encode
        for batch in slices(batches):
            ids, bounds = encode(batch.column("text"))
            rows, out = [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i]:bounds[i + 1]], end_id).astype("<u4")
                for p, a in enumerate(range(0, len(own), size)):
                    part = own[a:a + size]
                    rows.append(i)
                    out.append((p, a, len(part), zlib.crc32(part.tobytes())))
            p, a, n, crc = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(p, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, kind: str = "word", end_id: int = 0, size: int = SEQUENCE) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: their place in a sequence of at most `size` ids.

    A null or empty text is its end id alone, so every row has a piece; longer documents are cut into pieces of `size`
    ids, the last maybe shorter, and nothing else is cut. Rows with equal or null ids are documents of their own.
    Offsets of a sequence follow each other without gaps from 0. Only doc_id and text are read, so extra columns cannot
    clash; an empty table gives no rows.
    """
    cut = store(pieces(docs, path, kind, end_id, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        rest = None

        def emit(table: pa.Table, bins: list[list[int]], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if bins:
                order = np.array([i for b in bins for i in b])
                counts = np.array([len(b) for b in bins])
                ends = np.cumsum(lengths[order])
                firsts = np.cumsum(counts) - counts
                offset = ends - lengths[order] - np.repeat((ends - lengths[order])[firsts], counts)
                out = table.take(pa.array(order))
                out = out.append_column("sequence_id", pa.array(np.repeat(np.arange(number, number + len(bins)), counts)))
                yield from out.append_column("offset", pa.array(offset)).combine_chunks().to_batches()
                number += len(bins)

        def settle(table: pa.Table, last: bool):
            lengths = table.column("length").to_numpy()
            bins = local_search(best_fit(lengths, size), lengths, size)
            fills = np.array([lengths[b].sum() for b in bins])
            open_ = set() if last else set(np.argsort(fills, kind="stable")[:CARRY][np.sort(fills, kind="stable")[:CARRY] < size].tolist())
            later = sorted(i for n in open_ for i in bins[n])
            return emit(table, [b for n, b in enumerate(bins) if n not in open_], lengths), table.take(pa.array(later, pa.int64()))

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                waiting.append(batch.slice(a, CHUNK))
                if sum(b.num_rows for b in waiting) >= CHUNK:
                    table = pa.Table.from_batches(waiting)
                    out, rest = settle(table if rest is None else pa.concat_tables([rest, table]), False)
                    yield from out
                    waiting = []
        tables = ([] if rest is None else [rest]) + ([pa.Table.from_batches(waiting)] if waiting else [])
        if tables:
            yield from settle(pa.concat_tables(tables), True)[0]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(
        place, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
