"""The trie of conversation prefixes, summed from its leaves to its root by time-forward processing.

A node is a sequence of first turns, named by a chained 128-bit digest. Nodes are sorted by reverse level order, and a
node's totals travel to its parent as a message in a priority queue that is ordered alike: when a node's turn comes,
the messages of its children are at the queue's head. The sort is Spark's external one, the queue writes sorted runs
to the task's disk when it is full, so memory stays bounded whatever the size of a shard.

A shard is a subtree of few conversations: its root is the first node on a path that `light` or fewer share, and its
nodes go to one task together, many shards to a task. Nodes above, the heavy ones, are few: those of a depth have more
than `light` conversations each and share none, so there are fewer than turns / `light` of them, and `light` grows with
the table so that they never pass `HEAVY_NODES`. They take the totals of the shards' roots, added up before they are
shuffled, and are processed in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.session import store

LIGHT = 64                  # conversations that a shard's root has, at most
HEAVY_NODES = 1 << 18       # nodes above the shards, at most: the bound on what is sent out and on the last task
QUEUE = 1 << 17             # messages that a queue holds in memory
CHUNK = 1 << 16             # conversation ids that are joined into one text

_NODE = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n_convs bigint, bytes bigint"
_MESSAGE = "<5q"


class SpillingQueue:
    """A priority queue of (-depth, k1, k2, leaves, saved); what does not fit in memory waits in sorted runs on disk."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.heads, self.files = max(1, limit), [], [], []

    def _next(self, run: int) -> None:
        data = self.files[run].read(struct.calcsize(_MESSAGE))
        if data:
            heapq.heappush(self.heads, (struct.unpack(_MESSAGE, data), run))

    def push(self, message: tuple[int, ...]) -> None:
        if len(self.heap) >= self.limit:
            file = tempfile.TemporaryFile()
            for m in sorted(self.heap):
                file.write(struct.pack(_MESSAGE, *m))
            file.seek(0)
            self.heap = []
            self.files.append(file)
            self._next(len(self.files) - 1)
        heapq.heappush(self.heap, message)

    def head(self) -> tuple[int, ...] | None:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, ...]:
        if self.heads and (not self.heap or self.heads[0][0] <= self.heap[0]):
            message, run = heapq.heappop(self.heads)
            self._next(run)
            return message
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for file in self.files:
            file.close()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation and depth, the root's first, from turns sorted by conversation and place."""
    names = ["conv_id", "depth", "k1", "k2", "p1", "p2", "bytes", "last"]
    schema = pa.schema([(n, pa.bool_() if n == "last" else pa.int64()) for n in names])
    row = None                          # the latest, which waits to know whether it is its conversation's last
    for batch in batches:
        rows = []
        for conv_id, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "bytes"))):
            if row is None or row[0] != conv_id:
                if row is not None:
                    rows.append((*row, True))
                row = (conv_id, 0, 0, 0, None, None, 0)
            if digest is not None:
                rows.append((*row, False))
                _, depth, k1, k2 = row[:4]
                key = struct.unpack("<2q", hashlib.blake2b(struct.pack("<2q", k1, k2) + digest, digest_size=16).digest())
                row = (conv_id, depth + 1, *key, k1, k2, size)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*row, True), schema)], schema=schema)


def _forward(queue: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds n_children, n_leaves and saved to nodes in reverse level order; `top` marks those that pass nothing on.

    The columns in_children, in_leaves and in_saved are what a node has from children that are processed elsewhere.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue)
        try:
            for batch in batches:
                out = []
                columns = ("k1", "k2", "p1", "p2", "depth", "n_convs", "bytes", "top", "in_children", "in_leaves", "in_saved")
                for k1, k2, p1, p2, depth, n, size, top, children, leaves, saved in zip(*(batch.column(c).to_pylist() for c in columns)):
                    saved += (n - 1) * size
                    while (head := waiting.head()) is not None and head[:3] == (-depth, k1, k2):
                        waiting.pop()
                        children += 1
                        leaves += head[3]
                        saved += head[4]
                    if head is not None and head[:3] < (-depth, k1, k2):
                        raise ValueError("a message's node is not in this shard")
                    leaves += not children
                    out.append((children, leaves, saved))
                    if not top:
                        waiting.push((1 - depth, p1, p2, leaves, saved))
                if out:
                    more = [pa.array(c, pa.int64()) for c in zip(*out)]
                    kept = batch.schema.names[:9]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, "n_children", "n_leaves", "saved"])
            if waiting.head() is not None:
                raise ValueError("a message's node is not in this shard")
        finally:
            waiting.close()
    return apply


def _summed(nodes: DataFrame, queue: int) -> DataFrame:
    """`nodes` is partitioned by shard; the first nine columns stay."""
    ready = nodes.sortWithinPartitions(F.desc("depth"), "k1", "k2").select(
        *[c.split()[0] for c in _NODE.split(", ")], "top", "in_children", "in_leaves", "in_saved")
    return ready.mapInArrow(_forward(queue), _NODE + ", top boolean, n_children bigint, n_leaves bigint, saved bigint")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node and id, comma-joined in texts of CHUNK ids at most."""
    def row(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"k1": pa.array([key[0]], pa.int64()), "k2": pa.array([key[1]], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    key, ids = None, []
    for batch in batches:
        for *own, conv_id in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
            if ids and (own != key or len(ids) == CHUNK):
                yield row(key, ids)
                ids = []
            key = own
            ids.append(conv_id)
    if ids:
        yield row(key, ids)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, which come sorted by node and first id; one text is held at a time."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"e1": pa.array([key[0]], pa.int64()), "e2": pa.array([key[1]], pa.int64()), "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        for a, b, ids in zip(batch.column("k1"), batch.column("k2"), batch.column("ids")):
            if key != (a.as_py(), b.as_py()):
                if key is not None:
                    yield row()
                key, digest = (a.as_py(), b.as_py()), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_buffer())
    if key is not None:
        yield row()


def _ends(paths: DataFrame, heavy: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256) of the nodes where conversations end; a heavy node's ids are joined in many tasks."""
    ends = paths.filter("last").select("k1", "k2", "conv_id")
    few = (
        ends.join(F.broadcast(heavy), ["k1", "k2"], "left_anti").groupBy(F.col("k1").alias("e1"), F.col("k2").alias("e2"))
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ","), 256).alias("ends_sha256")))
    many = ends.join(F.broadcast(heavy), ["k1", "k2"], "left_semi").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    joined = many.mapInArrow(_joined_ids, "k1 bigint, k2 bigint, first bigint, ids string")
    digests = joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "e1 bigint, e2 bigint, ends_sha256 string")
    return few.union(digests)


def digest_of(role: Column, text: Column) -> Column:
    """128 bits that name a turn; null role and text are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, light: int = LIGHT, heavy_nodes: int = HEAVY_NODES, queue: int = QUEUE) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id bigint, turn, role, text); `conversations` (conv_id) may name some that have none.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest
    conversation that begins with the node, its depth, its parent's smallest conversation (null for the root), its
    conversations, its children, the childless nodes of its subtree, the sum over its subtree of (n_convs - 1) times
    the bytes of the node's last text, and the digest of the ids of the conversations that end there, ascending and
    comma-joined. A conversation's turns stand in order of `turn`, null first; equal turns by role and text digest.
    Null role and text are empty. Repeated rows are turns of their own. Rows without a conversation id belong to none
    and are left out. Only digests of texts are shuffled, so their length does not matter. The turns of one
    conversation and the nodes that few conversations share pass through one task, a row at a time. Extra columns are
    not read; a table without conversations gives no rows.
    """
    rows = turns.select("conv_id", "turn", digest_of(F.col("role"), F.col("text")).alias("digest"),
                        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    if conversations is not None:
        none = conversations.select("conv_id").distinct()
        rows = rows.union(none.select("conv_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "digest", "bytes")]))
    rows = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "digest", "bytes")
    paths = store(
        rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("digest"))
        .mapInArrow(_paths, "conv_id bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, bytes bigint, last boolean"))
    nodes = store(paths.groupBy("k1", "k2", "p1", "p2", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    light = max(light, -(-total // heavy_nodes))
    heavy = store(nodes.filter((F.col("n_convs") > light) | (F.col("depth") == 0)))
    keys = heavy.select("k1", "k2")

    # Where each path leaves the heavy nodes: the root of its shard.
    above = F.broadcast(heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")))
    tops = (
        paths.join(above, ["p1", "p2"], "left_semi").join(F.broadcast(keys), ["k1", "k2"], "left_anti")
        .select(F.col("conv_id").alias("of"), F.col("k1").alias("t1"), F.col("k2").alias("t2")))
    no = F.lit(0).cast("long")
    shards = (
        nodes.filter((F.col("n_convs") <= light) & (F.col("depth") > 0)).join(tops, F.col("conv_id") == F.col("of"))
        .withColumns({"top": (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")), "in_children": no, "in_leaves": no, "in_saved": no}))
    low = store(_summed(shards.repartition("t1", "t2"), queue))

    # The totals of the shards' roots, then the nodes above them.
    passed = low.filter("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    high = heavy.join(passed, ["k1", "k2"], "left").withColumn("top", F.col("depth") == 0).fillna(0, ["in_children", "in_leaves", "in_saved"])
    high = store(_summed(high.repartition(1), queue))

    # Parents: heavy ones have any number of children and are few, light ones have few children.
    heavy_parents = F.broadcast(heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    light_parents = low.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    below = low.filter("not top").join(light_parents, ["p1", "p2"])
    at_top = low.filter("top").unionByName(high).join(heavy_parents, ["p1", "p2"], "left")
    found = below.unionByName(at_top).join(_ends(paths, keys), (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def heads_exchanged(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation with the first turns of the one whose id is the next lower multiple of `every`.

    Of conversation c those are the first h, h being the crc32 of its decimal id modulo `most`; its own turns after
    the first h follow. Turns are numbered by turn (null first), role and text; null role and text are empty.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    own = turns.filter("conv_id is not null").select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).withColumn("turn", F.row_number().over(order) - 1)
    own = store(own)
    conversations = store(own.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most))
    with_h = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    tail = with_h.filter((F.col("conv_id") % every == 0) | (F.col("turn") >= F.col("h"))).select("conv_id", "turn", "role", "text")
    takers = conversations.filter(F.col("conv_id") % every != 0).select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = own.filter((F.col("conv_id") % every == 0) & (F.col("turn") < most - 1)).select(F.col("conv_id").alias("base"), "turn", "role", "text")
    head = takers.join(heads, "base").filter(F.col("turn") < F.col("h")).select("conv_id", "turn", "role", "text")
    return tail.union(head), conversations.select("conv_id")
