"""Text vectors, exact nearest neighbours and an inverted-file index.

A search scans the index once: every Arrow batch is multiplied with the broadcast query matrix and only the best k
rows per query and task leave Python. Pairs are never materialised and index rows are never shuffled. Queries beyond
the broadcast bound search an index of lists and rings, and the triangle inequality tells which of those they must meet.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.scalars import text
from logsieve.operators.labels import split_by_rule, valid_dimension
from logsieve.session import materialise, shared_dir, store

MAX_QUERY_VALUES = 4_000_000       # numbers in the broadcast query matrix: 32 MB as doubles
MAX_PAIRS = 4_000_000              # distances in memory at a time
BLOCK_ROWS = 20_000
LISTS = 100
TRAIN_ROWS_PER_LIST = 10_000
MAX_EXACT_LISTS = 1024
CENTRE_SAMPLE = 32                 # different vectors a list from which the centres of an exact index come
RINGS = 16                         # per unit of distance; unit vectors are at most 2 apart
LIST_FILES = 16
FIRST_RINGS = 2                    # a query asks for in its first round
LEAST_BLOCK = 256
PAIRS_PER_TASK = 200_000_000
SALTS = 16
SLACK = 1e-6                       # more than what distances of unit vectors lose in floating point

# Vector functions ----------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null when one of the vectors is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a.cast("array<double>"), lambda x: F.try_divide(x, norm))


# Text to vector ------------------------------------------------------------------------------------------------


class TextVectoriser:
    """Hashed, frequency-weighted words as a unit vector of `dim` numbers; whole texts, built-in stages only."""

    def __init__(self, dim: int = 256, max_chars: int | None = None):
        self.dim, self.max_chars, self.model = dim, max_chars, None

    def words(self, df: DataFrame, column: str) -> DataFrame:
        """Add `_text` and its lower-case words, `_words`."""
        t = text(column)
        cut = df.withColumn("_text", F.substring(t, 1, self.max_chars) if self.max_chars else t)
        return RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(cut)

    def _stages(self, weigh) -> Pipeline:
        return Pipeline(stages=[
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.dim),
            weigh,
            Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
        ])

    def fit(self, corpus: DataFrame, column: str) -> TextVectoriser:
        words = self.words(corpus, column).select("_words")
        self.model = self._stages(IDF(inputCol="_tf", outputCol="_tfidf")).fit(words)
        return self

    def weighted(self, spark: SparkSession, weights: list[float]) -> TextVectoriser:
        """With given weights of the hashed words, as those of a vocabulary's version, nothing is fitted."""
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_tfidf")
        self.model = self._stages(weigh).fit(spark.createDataFrame([], "_words array<string>"))
        return self

    def transform(self, df: DataFrame, column: str, output: str = "embedding") -> DataFrame:
        """Add the vector; a text without words has none (null) and counts as failed."""
        done = self.model.transform(self.words(df, column))
        return (
            done.withColumn(output, F.when(F.size("_words") > 0, vector_to_array("_unit", "float32")))
            .drop("_text", "_words", "_tf", "_tfidf", "_unit")
        )


def embedded(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that have a vector, and those whose embedding failed; a failed row never stops the others."""
    return split_by_rule(df, F.col(vector).isNotNull())


# Search --------------------------------------------------------------------------------------------------------


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / norm[:, None]


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.empty((0, 0))
    return _unit_rows(m) if metric == "cosine" and len(m) else m


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """The smaller the nearer; rounding is fixed so that equal vectors tie in every engine."""
    similarity = queries @ rows.T
    return np.round(1.0 - similarity if metric == "cosine" else -similarity, 9) + 0.0


class _Best:
    """The k nearest rows per query seen so far; ties go to the smaller id, unknown distances come last."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.bound = np.full(n_queries, np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.distance = np.empty(0)
        self.ids = np.empty(0, dtype=object)

    def offer(self, queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, metric: str) -> None:
        """Match `vectors`, the vectors of `queries`, with a batch, a bounded number of pairs at a time."""
        if not len(rows):
            return
        step = max(1, MAX_PAIRS // len(rows))
        for start in range(0, len(queries), step):
            part = queries[start:start + step]
            distance = _distances(vectors[start:start + step], rows, metric)
            distance[np.isnan(distance)] = np.inf
            bound = self.bound[part]
            if distance.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
            q, r = np.nonzero(distance <= bound[:, None])
            self._merge(part[q], distance[q, r], ids[r])

    def _merge(self, query: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        distance = np.concatenate([self.distance, distance])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, distance, query))
        query, distance, ids = query[order], distance[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.distance, self.ids = query[keep], distance[keep], ids[keep]
        full = place[keep] == self.k - 1
        self.bound[self.query[full]] = self.distance[full]

    def frame(self, names) -> pd.DataFrame:
        return pd.DataFrame({
            "_q": np.asarray(names)[self.query],
            "_i": self.ids,
            "distance": pd.Series(self.distance).replace(np.inf, np.nan).astype("Float64"),
        })


def _final(partial: DataFrame, k: int, query_id: str, row_id: str) -> DataFrame:
    """Best k of the per-task winners; the rank filter also runs before the shuffle."""
    order = W.partitionBy("_q").orderBy(F.col("distance").asc_nulls_last(), F.col("_i"))
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(query_id), F.col("_i").alias(row_id), "distance", "rank")


def _query_frame(queries: DataFrame, query_id: str, vector: str, dim: int) -> pd.DataFrame | None:
    """The queries on the driver when they stay within the broadcast bound."""
    most = max(1, MAX_QUERY_VALUES // max(dim, 1))
    frame = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).limit(most + 1).toPandas()
    return frame if len(frame) <= most else None


def _dimension(df: DataFrame, vector: str) -> int:
    first = df.select(F.size(vector).alias("n")).filter("n > 0").limit(1).collect()
    return first[0]["n"] if first else 0


def nearest(queries: DataFrame, index: DataFrame, k: int, query_id: str, row_id: str,
            query_vector: str = "embedding", vector: str = "embedding", metric: str = "cosine",
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k index rows nearest to every query: `(query_id, row_id, distance, rank)`.

    `metric` is `cosine` (1 - cos) or `inner` (negative inner product). Filter the index by time first: the filter
    reaches its scan. Vectors of a wrong length are left out by the caller (`split_by_dimension`).
    """
    spark = index.sparkSession
    q_type = queries.schema[query_id].dataType.simpleString()
    i_type = index.schema[row_id].dataType.simpleString()
    schema = f"_q {q_type}, _i {i_type}, distance double"
    frame = _query_frame(queries, query_id, query_vector, _dimension(queries, query_vector))
    if frame is None:
        return nearest_exact(queries, exact_index(index, row_id, vector, metric), k, query_id, row_id, query_vector, block_rows)
    shared = spark.sparkContext.broadcast((frame["q"].to_numpy(), _matrix(frame["v"], metric)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        best = _Best(len(names), k)
        for batch in batches:
            if len(batch) and len(names):
                best.offer(np.arange(len(names)), matrix, _matrix(batch["v"], metric), batch["i"].to_numpy(), metric)
        if len(names):
            yield best.frame(names)

    partial = index.select(F.col(row_id).alias("i"), F.col(vector).alias("v")).mapInPandas(scan, schema)
    return _final(partial, k, query_id, row_id)


# Exact search of large query sets ------------------------------------------------------------------------------


@dataclass
class ExactIndex:
    """Index rows as `(list, ring, i, v)`, stored by list, and what decides which of them a query must meet.

    `rings` holds the least and greatest distance to the centre and the rows of every ring. Distances are those of
    unit vectors: cosine compares directions, and for inner products rows are divided by the longest one and given a
    further number that makes them unit vectors, so the nearest is the one with the largest product.
    """

    rows: DataFrame
    rings: pd.DataFrame
    centres: np.ndarray
    scale: float
    metric: str


def _on_sphere(m: np.ndarray, metric: str, scale: float, rows: bool) -> np.ndarray:
    """Unit vectors in which the nearest by `metric` is the nearest by distance; nan where there is no direction."""
    if metric == "cosine":
        return _unit_rows(m)
    if not rows:
        return np.hstack([_unit_rows(m), np.zeros((len(m), 1))])
    m = m / scale
    return np.hstack([m, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", m, m)))[:, None]])


def _to_centres(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", m, m)[:, None] + np.einsum("ij,ij->i", centres, centres) - 2.0 * (m @ centres.T)
    return np.sqrt(np.maximum(0.0, squares))


def _centres(index: DataFrame, vector: str, n: int, lists: int, metric: str, scale: float) -> np.ndarray:
    """Centres by a few rounds of k-means over a sample of about CENTRE_SAMPLE different vectors a list."""
    wanted, v = lists * CENTRE_SAMPLE, F.col(vector).cast("array<double>")
    share, found = min(1.0, wanted / max(n, 1)), []
    place = F.pmod(F.xxhash64(v), F.lit(2**40))
    while True:
        # Copies share a hash and count once, so the sample stays small whatever repeats; it is widened if too few differ.
        some = index.filter(place < int(share * 2**40)).groupBy(place.alias("h")).agg(F.first(v).alias("v"))
        found = some.orderBy("h").limit(wanted).collect()
        if share >= 1.0 or 4 * len(found) >= wanted:
            break
        share = min(1.0, 8 * share)
    if not found:
        return np.empty((0, 0))
    m = _on_sphere(np.array([r.v for r in found], dtype=float), metric, scale, rows=True)
    m = m[~np.isnan(m).any(axis=1)]
    centres = m[:lists]
    for _ in range(8 if len(m) > lists else 0):
        own = _to_centres(m, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        size = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres


def exact_index(index: DataFrame, row_id: str, vector: str = "embedding", metric: str = "cosine",
                lists: int | None = None) -> ExactIndex:
    """Every row with the list of its nearest centre and its ring, the distance to that centre in steps of 1 / RINGS.

    Centres come from a bounded sample and only decide how much a search can leave out, never what it finds. A row
    without a direction has list -1. An empty table has no rings.
    """
    spark, v = index.sparkSession, F.col(vector).cast("array<double>")
    longest = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(dot(v, v))).alias("m")).first()
    scale = longest["m"] or 1.0
    lists = lists or max(1, min(MAX_EXACT_LISTS, math.isqrt(longest["n"])))
    centres = _centres(index, vector, longest["n"], lists, metric, scale)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = _on_sphere(np.stack(batch["v"].to_numpy()).astype(float), metric, scale, rows=True)
            lost = np.isnan(m).any(axis=1)
            m[lost] = 0.0
            if len(shared.value):
                far = _to_centres(m, shared.value)
                own = far.argmin(axis=1)
                r = far[np.arange(len(m)), own]
            else:
                own, r = np.zeros(len(m), dtype=int), np.zeros(len(m))
            ring = (r * RINGS).astype(int)
            yield pd.DataFrame({"list": np.where(lost, -1, own), "ring": np.where(lost, 0, ring), "r": np.where(lost, 0.0, r),
                                "i": batch["i"], "v": batch["v"]})

    i_type = index.schema[row_id].dataType.simpleString()
    placed = index.select(F.col(row_id).alias("i"), v.alias("v")).mapInPandas(place, f"list int, ring int, r double, i {i_type}, v array<double>")
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    # A list is dealt over several tasks, so that one that holds much of the table is written by many.
    placed.repartition("list", F.pmod(F.xxhash64("i"), F.lit(LIST_FILES))).write.partitionBy("list").parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    rings = rows.groupBy("list", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"))
    frame = rings.orderBy("list", "ring").toPandas()        # at most a few rings a list
    frame["number"] = np.arange(len(frame))
    return ExactIndex(rows, frame, centres, scale, metric)


def _next_rings(ix: ExactIndex, step: int):
    """A function over open queries: the next `step` rings of each that may hold one of its k nearest.

    A row at distance r of its centre is at least |r - d| from a query at distance d of it. Rings are taken in the
    order of that bound, and a query is done when the bound of the next one is beyond its k-th neighbour.
    """
    metric, scale = ix.metric, ix.scale
    shared = ix.rows.sparkSession.sparkContext.broadcast(
        (ix.centres, ix.rings["list"].to_numpy(), ix.rings["low"].to_numpy(), ix.rings["high"].to_numpy()))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, lists, low, high = shared.value
        size = max(1, MAX_PAIRS // max(1, len(lists)))
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start:start + size]
                raw = np.stack(part["v"].to_numpy()).astype(float)
                m = _on_sphere(raw, metric, scale, rows=False)
                blind = np.isnan(m).any(axis=1)         # as near to all rows
                far = _to_centres(np.where(blind[:, None], 0.0, m), centres)[:, np.maximum(lists, 0)] if len(centres) else np.zeros((len(m), len(lists)))
                bound = np.maximum(0.0, np.maximum(far - high, low - far))
                bound[blind] = 0.0
                bound[:, lists < 0] = np.inf
                worst = part["tau"].to_numpy() + 1e-9   # distances are rounded to nine places
                with np.errstate(divide="ignore", invalid="ignore"):
                    over = worst if metric == "cosine" else 1.0 + worst / (scale * np.sqrt(np.einsum("ij,ij->i", raw, raw)))
                    reach = np.where(blind | np.isinf(worst), np.inf, np.sqrt(np.maximum(0.0, 2.0 * over)) + SLACK)
                order = np.argsort(bound, axis=1, kind="stable")
                n_open = (bound <= reach[:, None]).sum(axis=1)
                reached = part["reached"].to_numpy()
                until = np.minimum(n_open, reached + step)
                left = np.flatnonzero(until > reached)
                yield pd.DataFrame({"qid": part["qid"].to_numpy()[left], "v": part["v"].to_numpy()[left], "reached": until[left],
                                    "asked": pd.Series([order[j, reached[j]:until[j]] for j in left], dtype=object)})

    return ask


def _match_blocks(k: int, metric: str, schema: str):
    """A function over rows sorted by block, index rows first: a block is held, the queries that ask for it pass by."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, held = None, [], [], None
        for batch in batches:
            number, sub, kind = (batch.column(c).to_numpy() for c in ("number", "sub", "kind"))
            changes = (np.diff(number) != 0) | (np.diff(sub) != 0) | (np.diff(kind) != 0)
            starts = [0, *(np.flatnonzero(changes) + 1), batch.num_rows] if batch.num_rows else []
            for a, b in zip(starts, starts[1:]):
                part = batch.slice(a, b - a)
                if block != (number[a], sub[a]):
                    block, ids, vectors, held = (number[a], sub[a]), [], [], None
                m = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                m = _unit_rows(m) if metric == "cosine" else m
                if kind[a] == 0:
                    ids.append(np.array(part.column("i").to_pylist(), dtype=object))
                    vectors.append(m)
                elif ids:
                    held = held or (np.concatenate(ids), np.vstack(vectors))
                    best = _Best(b - a, k)
                    best.offer(np.arange(b - a), m, held[1], held[0], metric)
                    frame = best.frame(part.column("qid").to_numpy())
                    out = pa.schema([("qid", pa.int64()), ("i", batch.schema.field("i").type), ("distance", pa.float64())])
                    yield pa.RecordBatch.from_pandas(frame.set_axis(out.names, axis=1), schema=out, preserve_index=False)

    return match


def nearest_exact(queries: DataFrame, ix: ExactIndex, k: int, query_id: str, row_id: str, query_vector: str = "embedding",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest rows of any number of queries, exactly: `(query_id, row_id, distance, rank)`.

    Queries of one vector search together. In every round an open query asks for its next rings, only the lists that
    hold one are read, and the queries go to the rows: an index row goes to one block, of at most about `block_rows`
    rows, fewer where many queries ask for it, and a query to the blocks of its rings. Rounds take four times
    the rings of the one before, and end when no ring left can hold a nearer row.
    """
    spark = ix.rows.sparkSession
    salt = F.pmod(F.xxhash64(query_id), F.lit(SALTS))       # copies of one vector are some groups, not one
    named = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), salt.alias("s"))
    groups = store(named.groupBy("v", "s").agg(F.count(F.lit(1)).alias("n")).select("v", "s", F.monotonically_increasing_id().alias("qid")))
    rows = ix.rows.join(F.broadcast(spark.createDataFrame(ix.rings[["list", "ring", "number"]], "list int, ring int, number int")), ["list", "ring"]) if len(ix.rings) else None
    i_type = ix.rows.schema["i"].dataType.simpleString()
    schema = f"qid bigint, i {i_type}, distance double"
    best = spark.createDataFrame([], schema)
    nearest_first = W.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), F.col("i"))
    state = groups.select("qid", "v", F.lit(0).alias("reached"), F.lit(math.inf).alias("tau"))
    step = FIRST_RINGS
    while rows is not None:
        asked = store(state.mapInPandas(_next_rings(ix, step), "qid bigint, v array<double>, reached int, asked array<int>"))
        probes = asked.select("qid", "v", F.explode("asked").alias("number"))
        counts = {r["number"]: r["n"] for r in probes.groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()}    # a row per ring
        if not counts:
            break
        plan = []
        for number, n in counts.items():
            size = int(ix.rings["n"].iat[number])
            plan.append((number, max(1, -(-size // block_rows), min(-(-size // LEAST_BLOCK), -(-size * n // PAIRS_PER_TASK)))))
        plan = F.broadcast(spark.createDataFrame(plan, "number int, subs int"))
        lists = sorted({int(ix.rings["list"].iat[number]) for number in counts})
        sides = ["number", "sub", "kind", "qid", "i", "v"]
        held = (
            rows.filter(F.col("list").isin(lists)).join(plan, "number")
            .withColumn("sub", F.pmod(F.xxhash64("i"), F.col("subs")).cast("int"))
            .withColumns({"kind": F.lit(0), "qid": F.lit(-1).cast("bigint")}).select(sides))
        passing = (
            probes.join(plan, "number").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
            .withColumns({"kind": F.lit(1), "i": F.lit(None).cast(i_type)}).select(sides))
        met = (
            held.unionByName(passing).repartition("number", "sub").sortWithinPartitions("number", "sub", "kind")
            .mapInArrow(_match_blocks(k, ix.metric, schema), schema))
        best = store(best.unionByName(met).withColumn("_r", F.row_number().over(nearest_first)).filter(F.col("_r") <= k).drop("_r"))
        worst = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("distance", F.lit(math.inf))).alias("far"))
        state = asked.join(worst, "qid", "left").select("qid", "v", "reached", F.when(F.col("n") >= k, F.col("far")).otherwise(math.inf).alias("tau"))
        step *= 4
    ranked = best.withColumn("rank", F.row_number().over(nearest_first))
    members = named.join(groups, ["v", "s"]).select("q", "qid")
    return members.join(ranked, "qid").select(F.col("q").alias(query_id), F.col("i").alias(row_id), "distance", "rank")


def split_by_dimension(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Vectors of the table's dimension, and those to reject."""
    return split_by_rule(df, valid_dimension(F.col(vector), dim))


# Inverted file -------------------------------------------------------------------------------------------------


def train_lists(df: DataFrame, row_id: str, vector: str = "embedding", lists: int = LISTS, seed: int = 42,
                ) -> DataFrame:
    """Centres of the lists as `(list_id, centre)`: k-means over unit vectors.

    The centres are trained on about TRAIN_ROWS_PER_LIST rows per list, chosen by key hash; every row is indexed.
    """
    n = df.count()
    share = min(1.0, lists * TRAIN_ROWS_PER_LIST / max(n, 1))
    rows = df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(2**40)) < int(share * 2**40))
    unit = rows.select(array_to_vector(normalised(F.col(vector))).alias("features"))
    centres = KMeans(k=min(lists, max(n, 1)), seed=seed, maxIter=10).fit(unit).clusterCenters()
    return df.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_id int, centre array<double>")


def assign_lists(df: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add the `list_id` of the nearest centre by cosine, ties to the lower id. Store the index partitioned by it."""
    frame = centres.orderBy("list_id").toPandas()       # lists x dim numbers, fixed by the index definition
    shared = df.sparkSession.sparkContext.broadcast(
        (frame["list_id"].to_numpy(), _matrix(frame["centre"], "cosine")))

    @F.pandas_udf("int")
    def nearest_list(vectors: pd.Series) -> pd.Series:
        ids, matrix = shared.value
        if not len(vectors):
            return pd.Series([], dtype="int32")
        distance = _distances(_matrix(vectors, "cosine"), matrix, "cosine")
        return pd.Series(ids[np.where(np.isnan(distance), np.inf, distance).argmin(axis=1)])

    return df.withColumn("list_id", nearest_list(vector))


def nearest_in_lists(queries: DataFrame, index: DataFrame, centres: DataFrame, k: int, query_id: str, row_id: str,
                     query_vector: str = "embedding", vector: str = "embedding", probes: int = 1) -> DataFrame:
    """Approximate search: a query meets only the rows of its `probes` nearest lists, ranked exactly.

    The filter on `list_id` prunes folders of an index that is stored partitioned by it. With all lists probed the
    result is exact. Queries beyond the broadcast bound run in slices by nearest list, so that each slice still
    reads few folders.
    """
    spark = index.sparkSession
    dim = _dimension(queries, query_vector)
    frame = _query_frame(queries, query_id, query_vector, dim)
    if frame is None:
        routed = assign_lists(queries, centres, query_vector)
        most = max(1, MAX_QUERY_VALUES // max(dim, 1))
        slices = max(2, -(-queries.count() * 2 // most))
        place = F.pmod(F.xxhash64("list_id", F.pmod(F.xxhash64(query_id), F.lit(slices))), F.lit(slices))
        parts = [
            nearest_in_lists(routed.filter(place == s).drop("list_id"), index, centres, k, query_id, row_id,
                             query_vector, vector, probes)
            for s in range(slices)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    q_type = queries.schema[query_id].dataType.simpleString()
    i_type = index.schema[row_id].dataType.simpleString()
    schema = f"_q {q_type}, _i {i_type}, distance double"
    lists = centres.orderBy("list_id").toPandas()
    matrix = _matrix(frame["v"], "cosine")
    asked: dict[int, np.ndarray] = {}
    if len(frame):
        to_centres = _distances(matrix, _matrix(lists["centre"], "cosine"), "cosine")
        order = np.argsort(np.where(np.isnan(to_centres), np.inf, to_centres), axis=1, kind="stable")[:, :probes]
        for place, list_id in enumerate(lists["list_id"]):
            hits = np.flatnonzero((order == place).any(axis=1))
            if len(hits):
                asked[int(list_id)] = hits
    shared = spark.sparkContext.broadcast((frame["q"].to_numpy(), matrix, asked))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries_matrix, by_list = shared.value
        best = _Best(len(names), k)
        for batch in batches:
            for list_id, part in batch.groupby("l"):
                hits = by_list.get(int(list_id))
                if hits is None:
                    continue
                best.offer(hits, queries_matrix[hits], _matrix(part["v"], "cosine"), part["i"].to_numpy(), "cosine")
        if len(names):
            yield best.frame(names)

    probed = index.filter(F.col("list_id").isin(list(asked)))
    partial = probed.select(F.col(row_id).alias("i"), F.col(vector).alias("v"),
                            F.col("list_id").alias("l")).mapInPandas(scan, schema)
    return _final(partial, k, query_id, row_id)


def with_payload(hits: DataFrame, index: DataFrame, row_id: str, columns: list[str], small: int = 1_000_000,
                 ) -> DataFrame:
    """Add the columns of the winners. The hits are broadcast while there are at most `small` of them."""
    hits = materialise(hits)
    few = hits.count() <= small
    return index.select(row_id, *columns).join(F.broadcast(hits) if few else hits, row_id)


def first_documents(df: DataFrame, order_by: Column, n: int = 10) -> DataFrame:
    """What is shown when no vectors exist: the first n documents."""
    return df.orderBy(order_by).limit(n)
