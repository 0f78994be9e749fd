"""Isolation forest whose model is a table of tree nodes.

Fitting: Spark draws the per-tree samples by row-key hash and shuffles only sampled rows, then each tree is built in
its own task. For large samples a row is kept once, with its weight and its node in every tree; nodes too large for one
task are split level by level with distributed aggregations until every open node fits. Scoring: a forest of few nodes is
broadcast and rows pass through a vectorised Arrow UDF; of others, tasks meet some of the packed trees with some of the
different rows, and the model never reaches the driver; a tree beyond a bound is walked by joins with the node table.

Model, tree and node seed every random draw and rows are chosen by key hash, so partitioning never changes a result.
"""

from __future__ import annotations

import math
import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.operators.labels import check_feature_schema
from logsieve.operators.quantiles import contamination_threshold, order_statistics
from logsieve.schema import FEATURES
from logsieve.session import materialise, store
from logsieve.sources.tables import spread

AUTO_SAMPLES = 256
SUBTREE_ROWS = 50_000
RANKED_ROWS = 1_000                # of a sample that is found by ranks; Spark limits those where rows are read
MAX_BROADCAST_NODES = 4_000_000    # of a tree, 22 bytes each, that a task holds
CHUNK_NODES = 250_000              # of a chunk of trees, as far as one tree has no more
CHUNKS_AT_ONCE = 1                 # that are broadcast: trees of more are scored in tasks
DRIVER_NODES = 131_072             # of a forest that the driver packs: there a node takes some hundred bytes for a moment
MAX_BROADCAST_SPLITS = 500_000
LEVELS_PER_CHECKPOINT = 4
LEVELS_PER_STORE = 8               # of large samples: rows walk that many levels again sooner than they are rewritten
SCORE_ROWS = 1024                  # rows scored at a time: the arrays of all trees stay in the cache
LARGE_TREE = 4096                  # nodes of a tree on average, above which trees are walked one after the other
SCORE_VALUES = 1 << 23             # path lengths that a task makes for a chunk of trees
BLOCK_VALUES = 1024                # of a record of several rows with their weights and places
COMBINE_ROWS = 65_536              # rows among which a task looks for equal ones
SUBTREE_MB = 32                    # of rows of nodes that a task finishes
ONE_MODEL = "all"

NODES = ("model string, tree_id int, node_id bigint, depth int, is_leaf boolean, feature int, threshold double, "
         "left bigint, right bigint, n_samples bigint")
_NODE_TYPES = pa.schema([("model", pa.string()), ("tree_id", pa.int32()), ("node_id", pa.int64()), ("depth", pa.int32()), ("is_leaf", pa.bool_()),
                         ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int64()), ("right", pa.int64()), ("n_samples", pa.int64())])
_PACKED = {"feature": np.int16, "threshold": np.float64, "left": np.int32, "path": np.float64}
_HASH_RANGE = 2**53
_ON_DRIVER = threading.Lock()      # forests are scored side by side


@dataclass
class Forest:
    """Fitted forests, one per model name, sharing their features and number of trees."""

    nodes: DataFrame
    samples: dict[str, int]
    n_estimators: int
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    offsets: dict[str, float] = field(default_factory=dict)
    by: str | None = None


# Tree building -------------------------------------------------------------------------------------------------


def average_path(n):
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3.0)
    long = 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def height_limit(samples: int) -> int:
    return math.ceil(math.log2(max(samples, 2)))


def _uniform(seed: int, model, tree, node, draw: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the place in the forest (a 64-bit mix of its coordinates)."""
    word = lambda v: np.atleast_1d(np.asarray(v)).astype(np.uint64)
    x = (word(node) * np.uint64(0xD6E8FEB86659FD93) + word(tree) * np.uint64(0x165667B19E3779F9)
         + word(model) * np.uint64(0xC2B2AE3D27D4EB4F) + word(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(draw))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _model_number(model: str) -> int:
    return zlib.crc32(model.encode())


def _choose_splits(low: np.ndarray, high: np.ndarray, seed: int, model, tree, node):
    """Per node a uniform feature among those that vary (-1 when none does) and a uniform threshold in its range."""
    varying = high > low
    n_varying = varying.sum(axis=1)
    pick = (_uniform(seed, model, tree, node, 1) * n_varying).astype(np.int64)
    feature = (varying.cumsum(axis=1) > pick[:, None]).argmax(axis=1)
    at = np.arange(len(feature))
    a, b = low[at, feature].astype(float), high[at, feature].astype(float)
    threshold = a + _uniform(seed, model, tree, node, 2) * (b - a)
    return np.where(n_varying > 0, feature, -1), np.where(threshold < b, threshold, a)


def build_subtree(x: np.ndarray, seed: int, model: str, tree: int, limit: int, root: int = 1,
                  depth: int = 0, weights: np.ndarray | None = None) -> pd.DataFrame:
    """Node rows of the tree below `root` for the rows of one (bounded) sample, a whole level at a time.

    A row with weight w stands for w equal rows.
    """
    levels = []
    weights = np.ones(len(x), dtype=np.int64) if weights is None else weights.astype(np.int64)
    nodes, rows, starts = np.array([root], dtype=np.int64), np.arange(len(x)), np.array([0])
    while len(nodes):
        part = x[rows]
        counts = np.diff(starts, append=len(rows))
        n = np.add.reduceat(weights[rows], starts)
        low, high = np.minimum.reduceat(part, starts, axis=0), np.maximum.reduceat(part, starts, axis=0)
        feature, threshold = _choose_splits(low, high, seed, _model_number(model), tree, nodes)
        splits = (feature >= 0) & (n > 1) & (depth < limit)
        levels.append((nodes, np.full(len(nodes), depth), splits, feature, threshold, n))
        # Rows of split nodes, grouped by child; the least and the greatest value make both children non-empty.
        place = np.repeat(np.arange(len(nodes)), counts)
        inside = splits[place]
        place, rows, part = place[inside], rows[inside], part[inside]
        goes_right = part[np.arange(len(rows)), feature[place]] > threshold[place]
        child = 2 * place + goes_right
        order = np.argsort(child, kind="stable")
        rows, child = rows[order], child[order]
        starts = np.flatnonzero(np.diff(child, prepend=-1))
        nodes = 2 * nodes[child[starts] // 2] + child[starts] % 2
        depth += 1
    return _node_frame(model, tree, *[np.concatenate(c) for c in zip(*levels)])


def _node_frame(model, tree, nodes, depth, splits, feature, threshold, counts) -> pd.DataFrame:
    """Node rows; what only a split has is missing for a leaf."""
    blank = lambda v, kind: pd.Series(v).astype(kind).mask(~splits)
    return pd.DataFrame({
        "model": model, "tree_id": tree, "node_id": nodes, "depth": depth, "is_leaf": ~splits,
        "feature": blank(feature, "Int32"), "threshold": blank(threshold, "Float64"),
        "left": blank(2 * nodes, "Int64"), "right": blank(2 * nodes + 1, "Int64"), "n_samples": counts,
    })


# Sampling ------------------------------------------------------------------------------------------------------


def _hash(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(_HASH_RANGE))


def samples_per_tree(n: int, max_samples: str | float) -> int:
    """Rows per tree: `auto` is min(256, n), a fraction is that share of the rows."""
    if max_samples == "auto":
        return min(AUTO_SAMPLES, n)
    return max(1, min(n, int(float(max_samples) * n)))


def _rows(df: DataFrame, key: str, features: list[str], by: str | None) -> DataFrame:
    model = F.col(by).cast("string") if by else F.lit(ONE_MODEL)
    return df.select(model.alias("model"), F.col(key).cast("string").alias("key"),
                     *[F.col(f).cast("float").alias(f) for f in features])


def _own(rows: DataFrame) -> Column:
    """A hash of the whole row, which orders the copies of a key."""
    return F.pmod(F.xxhash64(*rows.columns), F.lit(_HASH_RANGE))


def tree_samples(rows: DataFrame, sizes: dict[str, int], samples: dict[str, int], trees: int, seed: int) -> DataFrame:
    """Exactly `samples` rows per tree, without replacement, as `(model, tree_id, key, features)`; at most RANKED_ROWS each.

    A tree's sample are the rows with its least hashes of the key, those of the same key by a hash of the whole row, and
    copies of a row are as good as each other: `_tree_rows` has the same rule, so samples depend on the tree, not on how
    many there are or how large they are. Only rows below a cut are ranked. Where keys repeat a tree may find too few
    there; it tries again with a wider cut until its sample is full. Ranks are limited in the tasks that read the rows,
    so the shuffle holds as many rows of a tree as there are such tasks, times its sample, whatever shares a key.
    """
    spark = rows.sparkSession
    most = max(samples.values())
    share = {m: min(1.0, (samples[m] + 6 * math.sqrt(samples[m]) + 10) / n) for m, n in sizes.items()}
    open_trees = {m: list(range(trees)) for m in sizes}
    parts, kept = [], [F.col(c) for c in [*rows.columns, "tree_id"]]
    rank = F.row_number().over(W.partitionBy("model", "tree_id").orderBy("_h", "_own"))
    while open_trees:
        tries = spark.createDataFrame([(m, t, int(share[m] * _HASH_RANGE)) for m, t in open_trees.items()], "_m string, _trees array<int>, _cut bigint")    # a number per tree
        drawn = (
            rows.join(F.broadcast(tries), F.col("model") == F.col("_m"))
            .withColumn("tree_id", F.explode("_trees"))         # in generated code, so faster than a function over the array
            .withColumn("_h", _hash(F.lit(seed), F.col("key"), F.col("tree_id"))).filter(F.col("_h") < F.col("_cut"))
            .withColumn("_own", _own(rows))
            .withColumn("_r", rank).filter(F.col("_r") <= most))
        sized = spark.createDataFrame(list(samples.items()), "_s string, psi bigint")
        found = store(drawn.join(F.broadcast(sized), F.col("model") == F.col("_s")).filter("_r <= psi").select(*kept))
        full = {(r.model, r.tree_id) for r in found.groupBy("model", "tree_id").agg(F.count(F.lit(1)).alias("n")).collect()     # a row per tree
                if r.n >= samples[r.model] or share[r.model] >= 1.0}
        if len(full) < sum(map(len, open_trees.values())):
            done = spark.createDataFrame(sorted(full), "_m string, _i int")
            found = found.join(F.broadcast(done), (F.col("model") == F.col("_m")) & (F.col("tree_id") == F.col("_i"))).select(*kept)
        parts.append(found)
        left = {m: [t for t in own if (m, t) not in full] for m, own in open_trees.items()}
        open_trees = {m: own for m, own in left.items() if own}
        share = {m: min(1.0, 4 * s) for m, s in share.items()}
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # A given number of partitions keeps adaptive execution from merging these small but CPU-heavy groups.
    return out.repartition(min(trees * len(sizes), 2 * spark.sparkContext.defaultParallelism), "model", "tree_id")


def _tree_cuts(rows: DataFrame, sizes: dict, samples: dict, trees: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their hashes for every tree, and (_m, _i, cut, cut_own, row, copies): where the sample of a tree ends.

    As in `tree_samples` the least hashes of a tree are its sample. Copies of a key share that hash, and are told apart
    by a second one, of the whole row. Where keys are unique the cut of a tree lies within a few standard deviations
    of its expected place and is found among the few rows there and a count of those below. A tree whose cut lies
    elsewhere, or with too many rows there, gets it from order statistics. Of equal rows at the cut as many are taken
    as the sample has room for.
    """
    spark = rows.sparkSession
    own = _own(rows)
    around = []
    for m, n in sizes.items():
        psi = samples[m]
        slack = (8 * math.sqrt(psi * (1 - psi / n)) + 10) / n
        around.append((m, int(max(0.0, psi / n - slack) * _HASH_RANGE), int(min(1.0, psi / n + slack) * _HASH_RANGE), psi, int(2 * slack * n) + SUBTREE_ROWS))
    near = spark.createDataFrame(around, "model string, lo bigint, hi bigint, psi bigint, most bigint")
    placed = (
        rows.join(F.broadcast(near), "model").withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))     # in generated code, as above
        .select(F.struct(*rows.columns).alias("row"), "model", "lo", "hi", "tree_id", _hash(F.lit(seed), F.col("key"), F.col("tree_id")).alias("h"), own.alias("own")))
    counts = placed.groupBy(F.col("model").alias("_m"), F.col("tree_id").alias("_i")).agg(F.count_if(F.col("h") < F.col("lo")).alias("below"), F.count_if(F.col("h") < F.col("hi")).alias("upto"))
    counts = store(
        counts.join(F.broadcast(near), F.col("_m") == F.col("model"))
        .select("_m", "_i", "psi", "below", ((F.col("below") < F.col("psi")) & (F.col("psi") <= F.col("upto")) & (F.col("upto") - F.col("below") <= F.col("most"))).alias("inside")))
    same_tree = (F.col("model") == F.col("_m")) & (F.col("tree_id") == F.col("_i"))

    # Per tree the cut, the row there and how many of its copies belong to the sample.
    window = placed.filter("h >= lo and h < hi").join(F.broadcast(counts.filter("inside")), same_tree)     # a row per tree
    by_place = W.partitionBy("_m", "_i").orderBy("h", "own")
    cuts = (
        window.withColumn("_r", F.row_number().over(by_place)).withColumn("_first", F.rank().over(by_place))
        .filter(F.col("_r") == F.col("psi") - F.col("below"))
        .select("_m", "_i", F.col("h").alias("cut"), F.col("own").alias("cut_own"), "row", (F.col("_r") - F.col("_first") + 1).alias("copies")))
    elsewhere = counts.filter("not inside")
    if not elsewhere.isEmpty():
        cuts = cuts.unionByName(_cuts_elsewhere(placed.join(F.broadcast(elsewhere), same_tree)))
    return placed, store(cuts)


def _tree_rows(rows: DataFrame, sizes: dict, samples: dict, trees: int, seed: int) -> DataFrame:
    """The samples of `_tree_cuts` as rows: exactly `samples` per tree, each row once per tree that takes it."""
    placed, cuts = _tree_cuts(rows, sizes, samples, trees, seed)
    same_tree = (F.col("model") == F.col("_m")) & (F.col("tree_id") == F.col("_i"))
    before = (F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & (F.col("own") < F.col("cut_own"))
    columns = [*[F.col(f"row.`{c}`") for c in rows.columns], "tree_id"]
    at_cut = (
        cuts.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies").cast("bigint"), F.lit(SUBTREE_ROWS).cast("bigint")))).repartition("_m", "_i", "_from")
        .withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("copies"), F.col("_from") + SUBTREE_ROWS - 1))))
        .select("row", F.col("_i").alias("tree_id")))
    return placed.join(F.broadcast(cuts.drop("row")), same_tree).filter(before).select(*columns).unionByName(at_cut.select(*columns))


def _cuts_elsewhere(placed: DataFrame) -> DataFrame:
    """(_m, _i, cut, cut_own, row, copies) of the trees of `placed`, whatever shares a hash."""
    group = F.to_json(F.struct("_m", "_i"))
    placed = placed.withColumn("_g", group)
    asked = placed.select("_g", "psi").distinct()
    cut = store(order_statistics(placed, "h", asked.select(F.col("_g").alias("g"), (F.col("psi") - 1).alias("k")), "_g").select(F.col("g").alias("_c"), F.col("value").cast("bigint").alias("cut")))
    met = placed.join(F.broadcast(cut), F.col("_g") == F.col("_c")).filter("h <= cut")      # a row per tree
    left = store(met.groupBy("_g").agg((F.first("psi") - F.count_if(F.col("h") < F.col("cut"))).alias("left")))
    here = met.filter("h = cut")
    second = store(order_statistics(here, "own", left.select(F.col("_g").alias("g"), (F.col("left") - 1).alias("k")), "_g").select(F.col("g").alias("_o"), F.col("value").cast("bigint").alias("cut_own")))
    return (
        here.join(F.broadcast(second), F.col("_g") == F.col("_o")).filter("own <= cut_own").join(F.broadcast(left.withColumnRenamed("_g", "_l")), F.col("_g") == F.col("_l"))
        .groupBy("_m", "_i", "cut", "cut_own", "left").agg(F.count_if(F.col("own") < F.col("cut_own")).alias("less"), F.min(F.when(F.col("own") == F.col("cut_own"), F.col("row"))).alias("row"))
        .select("_m", "_i", "cut", "cut_own", "row", (F.col("left") - F.col("less")).alias("copies")))


# Fitting -------------------------------------------------------------------------------------------------------


def _build_in_tasks(state: DataFrame, limits: dict[str, int], features: list[str], seed: int) -> DataFrame:
    """Finish every open node of `(model, tree_id, node_id, depth, key, features)` in a task of its own."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        model, tree = frame["model"].iloc[0], int(frame["tree_id"].iloc[0])
        node, depth = int(frame["node_id"].iloc[0]), int(frame["depth"].iloc[0])
        x = frame[features].to_numpy(dtype=np.float32)
        return build_subtree(x, seed, model, tree, limits[model], node, depth)

    return state.groupBy("model", "tree_id", "node_id").applyInPandas(build, NODES)


def _split_rows(stats: DataFrame, limits: dict[str, int], features: list[str], seed: int,
                subtree_rows: int) -> DataFrame:
    """Node rows for the open nodes that need no task: leaves, and splits of nodes too large for one task."""
    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low = frame[[f"lo_{f}" for f in features]].to_numpy(dtype=np.float32)
            high = frame[[f"hi_{f}" for f in features]].to_numpy(dtype=np.float32)
            numbers = frame["model"].map(_model_number).to_numpy()
            tree, node = frame["tree_id"].to_numpy(), frame["node_id"].to_numpy()
            feature, threshold = _choose_splits(low, high, seed, numbers, tree, node)
            depth, n = frame["depth"].to_numpy(), frame["n"].to_numpy()
            splits = (feature >= 0) & (n > 1) & (depth < frame["model"].map(limits).to_numpy())
            rows = _node_frame(frame["model"].to_numpy(), tree, node, depth, splits, feature, threshold, n)
            yield rows[~splits | (n > subtree_rows)]

    return stats.mapInPandas(decide, NODES)


def build_by_levels(state: DataFrame, limits: dict[str, int], features: list[str], seed: int,
                    subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """Node rows for tree samples of any size, given as `(model, tree_id, key, features)`.

    Per level one aggregation with map-side combine finds the ranges of the open nodes; the chosen splits route the
    rows. Nodes of at most `subtree_rows` rows wait and are finished in tasks, so no task sees a whole sample.
    """
    group = ["model", "tree_id", "node_id", "depth"]
    state = state.withColumn("node_id", F.lit(1).cast("bigint")).withColumn("depth", F.lit(0))
    done: list[DataFrame] = []
    for level in range(max(limits.values()) + 1):
        ranges = [F.count("*").alias("n")]
        for f in features:
            ranges += [F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}")]
        stats = state.filter(F.col("depth") == level).groupBy(*group).agg(*ranges)
        decided = materialise(_split_rows(stats, limits, features, seed, subtree_rows))
        n_splits = decided.filter("not is_leaf").count()
        done.append(decided)
        # Rows of finished leaves leave; rows of a split node move to a child; the rest stays where it is.
        marks = decided.select("model", "tree_id", "node_id", "is_leaf", "feature", "threshold")
        small = n_splits <= MAX_BROADCAST_SPLITS and decided.count() <= MAX_BROADCAST_SPLITS
        joined = state.join(F.broadcast(marks) if small else marks, ["model", "tree_id", "node_id"], "left")
        value = F.get(F.array(*[F.col(f) for f in features]), F.col("feature")).cast("double")
        child = 2 * F.col("node_id") + (value > F.col("threshold")).cast("bigint")
        moved = F.col("is_leaf").isNotNull()
        state = (
            joined.filter(~F.coalesce(F.col("is_leaf"), F.lit(False)))
            .withColumn("node_id", F.when(moved, child).otherwise(F.col("node_id")))
            .withColumn("depth", F.when(moved, F.lit(level + 1)).otherwise(F.col("depth")))
            .drop("is_leaf", "feature", "threshold")
        )
        if (level + 1) % LEVELS_PER_CHECKPOINT == 0:
            state = store(state)
        if n_splits == 0:
            break
    nodes = _build_in_tasks(state, limits, features, seed)
    for part in done:
        nodes = nodes.unionByName(part)
    return nodes


# Fitting large samples -----------------------------------------------------------------------------------------
#
# A row is held once for all trees: its features `x`, its weight `w` in every tree (how many equal rows of the sample it
# stands for) and its place `at`, the number of its node in a table of the nodes split so far (-1: in no open node). A
# record holds some rows, one after the other.

_BLOCKS = "x array<float>, w array<int>, at array<int>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The rows of `values` as lists that begin at the rows `starts`."""
    ends = np.append(starts, len(values)) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def _records(x: np.ndarray, w: np.ndarray, at: np.ndarray, each: int | None = None) -> pa.RecordBatch:
    each = each or max(1, BLOCK_VALUES // (x.shape[1] + 2 * w.shape[1]))
    starts = np.arange(0, len(x), each)
    return pa.RecordBatch.from_arrays([_lists(v, starts) for v in (x, w, at)], ["x", "w", "at"])


def _combine(number: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of a model become one, with the sums of their weights."""
    whole = np.column_stack([number.astype(np.float32), x])
    _, first, group = np.unique(whole.view(f"V{4 * whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    if len(first) == len(x):
        return number, x, w
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return number[first], x[first], np.add.reduceat(w[order], starts, axis=0, dtype=np.int32)


def _in_chunks(parts: Iterator[tuple], most: int, always: bool) -> Iterator[pa.RecordBatch]:
    """Records of the rows `(number of the model, x, w)`, where equal rows among `most` are one as long as that saves something."""
    held, n, worth = [], 0, True
    def release():
        nonlocal worth
        number, x, w = (np.concatenate(v) for v in zip(*held))
        if worth or always:
            before = len(x)
            number, x, w = _combine(number, x, w)
            worth = len(x) < 0.8 * before
        trees = w.shape[1]
        return _records(x, w, np.where(w > 0, (number * trees)[:, None] + np.arange(trees), -1).astype(np.int32))

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            yield release()
            held, n = [], 0
    if n:
        yield release()


def _sample_blocks(rows: DataFrame, cuts: DataFrame, models: list[str], trees: range, seed: int, features: list[str]) -> DataFrame:
    """Every row that a tree of `trees` takes, with its weights; equal rows are one as far as they meet."""
    spark, width, count = rows.sparkSession, len(features), len(trees)
    mine = cuts.filter(F.col("_i").between(trees.start, trees.stop - 1))
    cut, cut_own = np.full((len(models), count), -1), np.full((len(models), count), -1)
    for r in mine.select("_m", "_i", "cut", "cut_own").collect():      # a row per tree
        cut[models.index(r._m), r._i - trees.start], cut_own[models.index(r._m), r._i - trees.start] = r.cut, r.cut_own
    most = int(np.clip(2**24 // count, 1024, COMBINE_ROWS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                number = pc.fill_null(pc.index_in(batch.column("model"), value_set=pa.array(models)), -1).to_numpy(zero_copy_only=False)
                h, own = _matrix(batch.column("h"), count), batch.column("own").to_numpy()[:, None]
                w = (h < cut[number]) | (h == cut[number]) & (own < cut_own[number])
                some = w.any(axis=1) & (number >= 0)
                yield number[some].astype(np.int64), _matrix(batch.column("x"), width)[some].astype(np.float32), w[some].astype(np.int32)

        yield from _in_chunks((p for p in parts() if len(p[0])), most, False)

    hashes = F.array(*[_hash(F.lit(seed), F.col("key"), F.lit(t)) for t in trees])
    drawn = rows.select("model", F.array(*features).alias("x"), hashes.alias("h"), _own(rows).alias("own")).mapInArrow(weigh, _BLOCKS)
    # The row at the cut of a tree, as often as the sample has room for it.
    place = F.element_at(F.create_map(*[F.lit(v) for i, m in enumerate(models) for v in (m, i * count)]), F.col("_m"))
    each = lambda value, other: F.transform(F.sequence(F.lit(trees.start), F.lit(trees.stop - 1)), lambda t: F.when(t == F.col("_i"), value(t)).otherwise(other).cast("int"))
    at_cut = mine.select(F.array(*[F.col(f"row.`{f}`") for f in features]).alias("x"),
                         each(lambda t: F.col("copies"), 0).alias("w"), each(lambda t: place + t - trees.start, -1).alias("at"))
    blocks = store(drawn.unionByName(at_cut))
    held = blocks.agg(F.sum(F.size("x"))).first()[0] // width
    if held > 0.5 * rows.count():
        return blocks

    # Equal rows of several tasks; each of them has one for a value, so none of these groups is large.
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w, at = _matrix(batch.column("x"), width), _matrix(batch.column("w"), count), _matrix(batch.column("at"), count)
            for start in range(0, len(x), most):
                yield _records(x[start:start + most], w[start:start + most], at[start:start + most], 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                x, w, at = _matrix(batch.column("x"), width), _matrix(batch.column("w"), count), _matrix(batch.column("at"), count)
                yield at.max(axis=1).astype(np.int64) // count, x, w

        yield from _in_chunks((p for p in parts() if len(p[0])), most, True)

    tasks = max(2 * spark.sparkContext.defaultParallelism, held * (width + 2 * count) * 4 // (64 << 20))
    return store(blocks.mapInArrow(alone, _BLOCKS).repartition(tasks, "x").mapInArrow(merge, _BLOCKS))


class _Split:
    """The nodes above and among the open ones, of all models and trees, by their number."""

    def __init__(self, models: np.ndarray, trees: np.ndarray):
        n = len(trees)
        self.model, self.tree, self.node, self.depth = models, trees, np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.feature, self.threshold, self.left = np.zeros(n, dtype=np.int32), np.full(n, np.inf), np.arange(n, dtype=np.int32)
        self.waits, self.ends = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)

    def split(self, at: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> None:
        """Nodes `at` get two children each, with the next free numbers. A node without children leads to itself."""
        first, n = len(self.tree), 2 * len(at)
        self.feature[at], self.threshold[at], self.left[at] = feature, threshold, first + 2 * np.arange(len(at))
        blank = {"feature": 0, "threshold": np.inf, "waits": False, "ends": False}
        more = {"model": np.repeat(self.model[at], 2), "tree": np.repeat(self.tree[at], 2), "depth": np.repeat(self.depth[at] + 1, 2),
                "node": np.repeat(2 * self.node[at], 2) + np.tile([0, 1], len(at)), "left": np.arange(first, first + n)}
        for name, values in ({k: np.full(n, v) for k, v in blank.items()} | more).items():
            mine = getattr(self, name)
            setattr(self, name, np.concatenate([mine, values.astype(mine.dtype)]))


def _walked(batch: pa.RecordBatch, width: int, count: int, known: dict, steps: int):
    """Chunks of `(x, w, at, where, node)`: the entries of `at` that hold a node and the node `steps` levels below."""
    xs, ws, ats = _matrix(batch.column("x"), width), _matrix(batch.column("w"), count), _matrix(batch.column("at"), count)
    most = max(1, 2**19 // count)
    for start in range(0, len(xs), most):
        x, w, at = xs[start:start + most], ws[start:start + most], ats[start:start + most]
        values, where = np.ascontiguousarray(x).ravel(), np.flatnonzero(at.ravel() >= 0)
        node, row = at.ravel()[where], where // count * width
        for _ in range(steps):
            goes_right = values.take(row + known["feature"].take(node)) > known["threshold"].take(node)
            node = known["left"].take(node) + goes_right
        yield x, w, at, where, node


def _build_large(rows: DataFrame, cuts: DataFrame, models: list[str], limits: dict[str, int], trees: range, seed: int,
                 features: list[str], subtree_rows: int, samples: dict[str, int]) -> DataFrame:
    """Node rows of `trees` for samples of any size.

    Per level one pass finds the ranges of the open nodes, combined in the tasks first. The driver sees a row per open
    node, each of more than `subtree_rows` rows, and its two children. The other nodes wait and are finished in tasks.
    """
    spark, width, count = rows.sparkSession, len(features), len(trees)
    blocks = _sample_blocks(rows, cuts, models, trees, seed, features)
    known = _Split(np.repeat(np.arange(len(models)), count), np.tile(np.asarray(trees), len(models)))
    names, numbers = np.array(models, dtype=object), np.array([_model_number(m) for m in models], dtype=np.uint64)
    limit, done, first, steps = np.array([limits[m] for m in models]), [], 0, 0
    ranges = [f"{side}{j}" for side in ("lo", "hi") for j in range(width)]

    def shared():
        return spark.sparkContext.broadcast({k: getattr(known, k) for k in ("feature", "threshold", "left", "waits", "ends")})

    def measure(first: int, last: int, steps: int, table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(last - first, dtype=np.int64)
            lo, hi = np.full((width, last - first), np.inf, dtype=np.float32), np.full((width, last - first), -np.inf, dtype=np.float32)
            for batch in batches:
                for x, w, _, where, node in _walked(batch, width, count, table.value, steps):
                    mine = np.flatnonzero(node >= first)
                    if not len(mine):
                        continue
                    node, where = node[mine] - first, where[mine]
                    order = np.argsort(node.astype(np.uint16), kind="stable") if last - first < 2**16 else np.argsort(node)
                    node, where = node[order], where[order]
                    starts = np.flatnonzero(np.diff(node, prepend=-1))
                    node = node[starts]
                    n[node] += np.add.reduceat(w.ravel()[where].astype(np.int64), starts)
                    row, columns = where // count, np.ascontiguousarray(x.T)
                    for j in range(width):
                        value = columns[j].take(row)
                        lo[j, node] = np.minimum(lo[j, node], np.minimum.reduceat(value, starts))
                        hi[j, node] = np.maximum(hi[j, node], np.maximum.reduceat(value, starts))
            met = np.flatnonzero(n)
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array((met + first).astype(np.int32)), pa.array(n[met]), *[pa.array(v[met]) for v in (*lo, *hi)]], ["at", "n", *ranges])

        return run

    def advance(steps: int, table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, w, at, where, node in _walked(batch, width, count, table.value, steps):
                    moved = at.copy()
                    moved.ravel()[where] = np.where(table.value["ends"].take(node), -1, node)
                    some = (moved >= 0).any(axis=1)
                    if some.any():
                        yield _records(x[some], w[some], moved[some])

        return run

    if max(samples.values()) <= subtree_rows:
        known.waits[:] = True
    while not known.waits[first:].all():
        last = len(known.tree)
        stats = blocks.mapInArrow(measure(first, last, steps, shared()), "at int, n bigint, " + ", ".join(f"{c} float" for c in ranges))
        # A missing value makes the greatest one NaN, in the tasks and here, and such a feature is not split.
        stats = stats.groupBy("at").agg(F.sum("n").alias("n"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in ranges]).toPandas()
        at, n = stats["at"].to_numpy(), stats["n"].to_numpy()
        low, high = (stats[[f"{side}{j}" for j in range(width)]].to_numpy(dtype=np.float32) for side in ("lo", "hi"))
        model, tree, node, depth = known.model[at], known.tree[at], known.node[at], known.depth[at]
        feature, threshold = _choose_splits(low, high, seed, numbers[model], tree, node)
        splits = (feature >= 0) & (n > 1) & (depth < limit[model])
        large = splits & (n > subtree_rows)
        ready = ~splits | large
        done.append(_node_frame(names[model], tree, node, depth, splits, feature, threshold, n)[ready])
        known.ends[at], known.waits[at] = ~splits, splits & ~large
        known.split(at[large], feature[large], threshold[large])
        first = last
        if not large.any():
            break
        steps += 1
        if steps == LEVELS_PER_STORE:
            blocks, steps = store(blocks.mapInArrow(advance(steps, shared()), _BLOCKS)), 0

    table = shared()

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, w, _, where, node in _walked(batch, width, count, table.value, steps):
                mine = np.flatnonzero(table.value["waits"].take(node))
                if not len(mine):
                    continue
                mine = mine[np.argsort(node[mine])]
                node, where = node[mine], where[mine]
                starts = np.flatnonzero(np.diff(node, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[starts].astype(np.int32)), _lists(x[where // count], starts), _lists(w.ravel()[where][:, None], starts)], ["at", "x", "w"])

    waits = np.flatnonzero(known.waits)
    nodes = spark.createDataFrame(pa.Table.from_pandas(pd.concat(done, ignore_index=True), _NODE_TYPES, preserve_index=False), NODES) if done else None
    if len(waits):
        which = {k: v[waits] for k, v in (("model", names[known.model]), ("tree", known.tree), ("node", known.node), ("depth", known.depth))}
        which = spark.sparkContext.broadcast(which | {"at": waits})

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            i = int(np.searchsorted(which.value["at"], frame["at"].iloc[0]))
            model, tree, node, depth = (which.value[k][i] for k in ("model", "tree", "node", "depth"))
            x, w = np.concatenate(list(frame["x"])).astype(np.float32).reshape(-1, width), np.concatenate(list(frame["w"]))
            return build_subtree(x, seed, model, int(tree), limits[model], int(node), int(depth), w)

        # A given number of partitions: adaptive execution would merge these small but CPU-heavy groups.
        size = blocks.agg(F.sum(F.size(F.filter("at", lambda a: a >= 0)))).first()[0] * (width + 1) * 4
        tasks = max(4 * spark.sparkContext.defaultParallelism, size // (SUBTREE_MB << 20))
        built = blocks.mapInArrow(waiting, "at int, x array<float>, w array<int>").repartition(tasks, "at").groupBy("at").applyInPandas(build, NODES)
        nodes = built if nodes is None else nodes.unionByName(built)
    return nodes


def _build_groups(rows: DataFrame, sizes: dict, samples: dict, limits: dict, trees: int, seed: int, features: list[str], subtree_rows: int) -> DataFrame:
    """`_build_large` for as many trees at a time as have a bounded number of open nodes."""
    rows = spread(rows, again=True)
    cuts = _tree_cuts(rows, sizes, samples, trees, seed)[1]
    open_nodes = max(1, sum(samples.values()) // max(subtree_rows, 1))
    each = max(1, MAX_BROADCAST_SPLITS // open_nodes)
    out = None
    for start in range(0, trees, each):
        part = store(_build_large(rows, cuts, sorted(sizes), limits, range(start, min(start + each, trees)), seed, features, subtree_rows, samples))
        out = part if out is None else out.unionByName(part)
    return out


def model_sizes(rows: DataFrame) -> dict[str, int]:
    found = rows.groupBy("model").count().collect()      # a row per model
    if not found:
        raise ValueError("cannot fit a forest on an empty table")
    return {r["model"]: r["count"] for r in found}


def fit_forest(df: DataFrame, key: str, n_estimators: int = 100, max_samples: str | float = "auto",
               contamination: float | None = 0.08, seed: int = 42, features: list[str] = FEATURES,
               by: str | None = None, subtree_rows: int = SUBTREE_ROWS) -> Forest:
    """Fit one forest, or one per value of `by`, and set the offset at the contamination quantile.

    `key` identifies a row; copies of a key are drawn together as far as the sample has room. Samples have their
    exact size, whatever it is and whatever shares a key: the rows with the least hashes of the tree.
    """
    check_feature_schema(df, features)
    rows = _rows(df, key, features, by)
    sizes = model_sizes(rows)
    samples = {m: samples_per_tree(n, max_samples) for m, n in sizes.items()}
    limits = {m: height_limit(psi) for m, psi in samples.items()}
    if max(samples.values()) > RANKED_ROWS:
        nodes = _build_groups(rows, sizes, samples, limits, n_estimators, seed, features, subtree_rows)
    elif max(samples.values()) <= subtree_rows:
        drawn = tree_samples(rows, sizes, samples, n_estimators, seed)
        state = drawn.withColumn("node_id", F.lit(1).cast("bigint")).withColumn("depth", F.lit(0))
        nodes = materialise(_build_in_tasks(state, limits, features, seed))
    else:
        nodes = materialise(build_by_levels(tree_samples(rows, sizes, samples, n_estimators, seed), limits, features, seed,
                                            subtree_rows))
    forest = Forest(nodes, samples, n_estimators, list(features), {}, by)
    if contamination is not None:
        scored = score_samples(df, forest).select(*([by] if by else []), "score_sample").persist()
        forest.offsets = _offsets(scored, contamination, by)
        scored.unpersist()
    return forest


def _offsets(scored: DataFrame, contamination: float, by: str | None) -> dict[str, float]:
    cuts = contamination_threshold(scored, contamination, "score_sample", by)
    return {str(r[by]): r["threshold"] for r in cuts.collect()} if by else {ONE_MODEL: cuts}   # a row per model


def fit_and_score(df: DataFrame, key: str, contamination: float = 0.08, **options) -> tuple[Forest, DataFrame]:
    """The forest of `fit_forest` and `score_forest` of its own training rows, which pass through the trees once."""
    forest = fit_forest(df, key, contamination=None, **options)
    scored = store(score_samples(df, forest))
    forest.offsets = _offsets(scored, contamination, forest.by)
    return forest, decide(scored, forest)


# Scoring -------------------------------------------------------------------------------------------------------


def pack(nodes: pd.DataFrame) -> dict:
    """The trees of one model as flat arrays. The right child follows the left one; a leaf points to itself."""
    # Level order within a tree puts the two children of a node next to each other.
    nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    leaf = nodes["is_leaf"].to_numpy(dtype=bool)
    left = np.arange(len(nodes))
    left[~leaf] = np.flatnonzero(nodes["node_id"].to_numpy() % 2 == 0)     # left children are in the order of their parents
    return {
        "roots": np.flatnonzero(nodes["node_id"].to_numpy() == 1),
        "feature": np.where(leaf, 0, nodes["feature"].fillna(0).to_numpy(dtype=np.int64)).astype(np.int16),
        "threshold": np.where(leaf, np.inf, nodes["threshold"].fillna(0).to_numpy(dtype=float)),
        "left": left.astype(np.int32),
        "path": nodes["depth"].to_numpy(dtype=float) + np.where(leaf, average_path(nodes["n_samples"]), 0.0),
        "depth": int(nodes["depth"].max()),
    }


def _packed(forest: Forest, n: int) -> DataFrame:
    """The `n` nodes of a forest as a row per tree with the arrays of `pack`, made in tasks."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tree = pack(frame)
        return pd.DataFrame({"model": frame["model"].iloc[:1], "tree_id": frame["tree_id"].iloc[:1], "depth": tree["depth"],
                             **{k: [tree[k].tobytes()] for k in _PACKED}})

    spark = forest.nodes.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, n // CHUNK_NODES)
    nodes = forest.nodes.select("model", "tree_id", "node_id", "depth", "is_leaf", "feature", "threshold", "n_samples")
    return store(nodes.repartition(tasks, "model", "tree_id").groupBy("model", "tree_id").applyInPandas(
        run, "model string, tree_id int, depth int, " + ", ".join(f"{k} binary" for k in _PACKED)))


def _is_large(model: dict) -> bool:
    return len(model["left"]) > LARGE_TREE * len(model["roots"])


def _joined(trees: list[dict]) -> dict:
    """Trees, each by itself from `pack`, as `pack` has them together."""
    if len(trees) == 1:
        return trees[0]
    roots = np.cumsum([0, *[len(t["left"]) for t in trees[:-1]]])
    out = {k: np.concatenate([t[k] for t in trees]) for k in ("feature", "threshold", "path")}
    out["left"] = np.concatenate([t["left"] + np.int32(root) for t, root in zip(trees, roots)])
    return out | {"roots": roots, "depth": max(t["depth"] for t in trees)}


def _unpacked(rows: pa.Table) -> dict[str, dict]:
    """The trees of `_packed` by model."""
    trees: dict[str, list[dict]] = {}
    for row in sorted(rows.to_pylist(), key=lambda r: r["tree_id"]):
        arrays = {k: np.frombuffer(row[k], dtype=kind) for k, kind in _PACKED.items()}
        trees.setdefault(row["model"], []).append(arrays | {"roots": np.zeros(1, dtype=np.int64), "depth": row["depth"]})
    return {m: _joined(trees.pop(m)) for m in list(trees)}


def _share(forest: Forest, sizes: list[int]) -> list[tuple[int, Broadcast]]:
    """Per chunk its first tree and its packed trees, by model, once per executor. The driver holds one chunk at a time."""
    packed = _packed(forest, sum(sizes)) if sum(sizes) > DRIVER_NODES else None
    out = []
    for first, end in _chunks(sizes):
        mine = F.col("tree_id").between(first, end - 1)
        with _ON_DRIVER:
            if packed is None:
                models = {m: pack(part) for m, part in forest.nodes.filter(mine).toArrow().to_pandas().groupby("model")}
            else:
                models = _unpacked(packed.filter(mine).toArrow())
            out.append((first, forest.nodes.sparkSession.sparkContext.broadcast(models)))
            del models
    return out


def _paths_by_tree(model: dict, x: np.ndarray) -> Iterator[np.ndarray]:
    """Path length of every row in one tree after the other: the nodes of one large tree stay in the cache, those of all would not."""
    values = np.ascontiguousarray(x, dtype=float).ravel()
    start = np.arange(len(x)) * x.shape[1]
    ends = np.append(model["roots"][1:], len(model["left"]))
    for root, end in zip(model["roots"], ends):
        feature, threshold, left = (model[k][root:end] for k in ("feature", "threshold", "left"))
        at = np.full(len(x), root, dtype=np.int32)
        for _ in range(model["depth"]):
            at -= root
            at = left.take(at) + (values.take(feature.take(at) + start) > threshold.take(at))
        yield model["path"].take(at)


def _paths(model: dict, x: np.ndarray) -> np.ndarray:
    """Path length of every row in every tree."""
    values = np.ascontiguousarray(x, dtype=float).ravel()
    start = (np.arange(len(x)) * x.shape[1])[:, None]
    at = np.tile(model["roots"], (len(x), 1))
    for _ in range(model["depth"]):
        goes_right = values.take(model["feature"].take(at) + start) > model["threshold"].take(at)
        at = model["left"].take(at)
        at += goes_right
    return model["path"].take(at)


def _tree_sizes(forest: Forest) -> list[int]:
    """Nodes per tree, of all models."""
    counts = {r["tree_id"]: r["n"] for r in forest.nodes.groupBy("tree_id").agg(F.count("*").alias("n")).collect()}    # a row per tree
    return [counts.get(t, 0) for t in range(forest.n_estimators)]


def _chunks(sizes: list[int], most: int | None = None) -> list[tuple[int, int]] | None:
    """Ranges of neighbouring trees of at most `most` nodes, or of one tree; None if one tree alone is too large."""
    chunks, first, held = [], 0, 0
    if max(sizes, default=0) > MAX_BROADCAST_NODES:
        return None
    for t, n in enumerate(sizes):
        if held and held + n > (most or min(CHUNK_NODES, MAX_BROADCAST_NODES)):
            chunks.append((first, t))
            first, held = t, 0
        held += n
    return [*chunks, (first, len(sizes))]


def tree_chunks(forest: Forest) -> list[tuple[int, int]] | None:
    """Ranges of tree numbers whose nodes, of all models, may be broadcast together; None if one tree alone is too large."""
    return _chunks(_tree_sizes(forest))


def _path_sums(forest: Forest, shared: list[tuple[int, Broadcast]], prefixes: list[int]) -> Column:
    """Per prefix the sum of a row's path lengths over its trees, as an array column.

    Lengths are added in the order of the trees, so chunks don't change a sum. Only the feature columns cross to Python.
    """
    has_model, asked = forest.by is not None, np.minimum(prefixes, forest.n_estimators)

    def walk(x: np.ndarray, models: list[tuple[int, dict]]) -> np.ndarray:
        total, out = np.zeros(len(x)), np.zeros((len(x), len(asked)))
        for first, model in models:
            if _is_large(model):
                for t, path in enumerate(_paths_by_tree(model, x), first + 1):
                    total += path
                    out[:, asked == t] = total[:, None]
                continue
            counts = asked - first
            here = (counts > 0) & (counts <= len(model["roots"]))
            for start in range(0, len(x), SCORE_ROWS):
                rows = slice(start, start + SCORE_ROWS)
                sums = np.column_stack([total[rows], _paths(model, x[rows])]).cumsum(axis=1)
                out[rows, here] = sums[:, counts[here]]
                total[rows] = sums[:, -1]
        return out

    def sums(x: np.ndarray, models: list[tuple[int, dict]]) -> np.ndarray:
        if not any(_is_large(model) for _, model in models):
            return walk(x, models)
        _, each, alike = np.unique(np.ascontiguousarray(x).view(f"V{4 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return walk(x[each], models)[alike]

    def run(batches):
        chunks = [(first, chunk.value) for first, chunk in shared]
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)     # one column comes bare
            names = columns[0] if has_model else None
            x = np.column_stack([c.to_numpy(dtype=np.float32) for c in columns[1 if has_model else 0:]])
            if names is None:
                result = sums(x, [(first, models[ONE_MODEL]) for first, models in chunks])
            else:
                result = np.full((len(x), len(asked)), np.nan)
                for name in names.unique():
                    rows = (names == name).to_numpy()
                    if name in chunks[0][1]:
                        result[rows] = sums(x[rows], [(first, models[name]) for first, models in chunks])
            yield pd.Series(list(result))

    @F.pandas_udf("array<double>")
    def udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from run(batches)

    lead = [F.col(forest.by).cast("string")] if has_model else []
    return udf(*lead, *[F.col(f).cast("float") for f in forest.features])


def _scales(forest: Forest, model: Column) -> Column:
    """Normal path length of the samples of each model."""
    return F.element_at(F.create_map(*[F.lit(v) for m, s in forest.samples.items() for v in (m, float(average_path(s)))]), model)


def score_expression(forest: Forest, prefixes: list[int] | None = None) -> Column | None:
    """Score of a row, or with `prefixes` one score per number of leading trees; None if a tree cannot be broadcast."""
    return _expression(forest, _tree_sizes(forest), prefixes)


def _expression(forest: Forest, sizes: list[int], prefixes: list[int] | None) -> Column | None:
    if _chunks(sizes) is None:
        return None
    return _scores(forest, F.lit(ONE_MODEL) if forest.by is None else F.col(forest.by).cast("string"), _path_sums(forest, _share(forest, sizes), prefixes or [forest.n_estimators]), prefixes)


def _score_in_tasks(df: DataFrame, forest: Forest, sizes: list[int], prefixes: list[int] | None, column: str) -> DataFrame:
    """`score_samples` for a forest of many nodes: a task meets a chunk of trees with a block of the different rows.

    Neither trees nor rows pass the driver. A row gets its path lengths tree by tree, so they are added in that order.
    """
    spark, width = df.sparkSession, len(forest.features)
    of = F.col(forest.by).cast("string") if forest.by else F.lit(ONE_MODEL)
    x = F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(float("nan")).cast("float")) for f in forest.features])
    rows = store(df.withColumn("_model", of).withColumn("_x", x))
    each = store(rows.select("_model", "_x").distinct().withColumn("_id", F.monotonically_increasing_id()))

    groups = 4 * spark.sparkContext.defaultParallelism
    chunks = _chunks(sizes, min(CHUNK_NODES, MAX_BROADCAST_NODES, max(sum(sizes) // groups, max(sizes))))
    blocks = math.ceil(each.count() * max(end - first for first, end in chunks) / SCORE_VALUES) or 1
    number = F.get(F.array(*[F.lit(i) for i, (first, end) in enumerate(chunks) for _ in range(first, end)]), F.col("tree_id"))
    trees = _packed(forest, sum(sizes)).withColumn("_chunk", number).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = each.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))).withColumn("_block", (F.col("_id") % blocks).cast("int"))

    def meet(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        first, end = chunks[key[0].as_py()]
        x, names = _matrix(rows.column("_x").combine_chunks(), width), rows.column("_model")
        paths = np.full((len(x), end - first), np.nan)
        for name, model in _unpacked(trees).items():
            mine = np.flatnonzero(pc.fill_null(pc.equal(names, name), False).to_numpy())
            if _is_large(model):
                for t, path in enumerate(_paths_by_tree(model, x[mine])):
                    paths[mine, t] = path
                continue
            for start in range(0, len(mine), SCORE_ROWS):
                some = mine[start:start + SCORE_ROWS]
                paths[some] = _paths(model, x[some])
        lists = _lists(paths, np.arange(len(x)))
        return pa.table({"_id": rows.column("_id"), "_first": pa.array(np.full(len(x), first, dtype=np.int32)), "_paths": lists})

    # A given number of partitions: adaptive execution would merge these small but CPU-heavy groups.
    tasks, place = max(groups, len(chunks) * blocks), ["_chunk", "_block"]
    met = asked.repartition(tasks, *place).groupBy(*place).cogroup(trees.repartition(tasks, *place).groupBy(*place)).applyInArrow(
        meet, "_id bigint, _first int, _paths array<double>")
    ends = np.minimum(prefixes or [forest.n_estimators], forest.n_estimators) - 1

    @F.pandas_udf("array<double>")
    def add(paths: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(paths).cumsum(axis=1)[:, ends]))

    paths = met.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_first", "_paths"))).alias("_all")).select(
        "_id", add(F.flatten("_all._paths")).alias("_sums"))
    scored = store(each.join(paths, "_id").select(
        F.col("_model").alias("_of"), F.col("_x").alias("_at"), _scores(forest, F.col("_model"), F.col("_sums"), prefixes).alias(column)))
    return rows.join(scored, F.col("_model").eqNullSafe(F.col("_of")) & (F.col("_x") == F.col("_at")), "left").drop("_model", "_x", "_of", "_at")


def _scores(forest: Forest, model: Column, sums: Column, prefixes: list[int] | None) -> Column:
    counts = prefixes or [forest.n_estimators]
    scale = _scales(forest, model)
    numbers = F.array(*[F.lit(float(c)) for c in counts])
    scores = F.zip_with(sums, numbers, lambda s, n: F.when(F.isnan(s), F.lit(float("nan"))).otherwise(
        -F.pow(F.lit(2.0), -F.when(scale > 0, s / n / scale).otherwise(F.lit(1.0)))))
    return scores if prefixes else F.get(scores, F.lit(0))


def score_samples(df: DataFrame, forest: Forest, prefixes: list[int] | None = None,
                  column: str = "score_sample") -> DataFrame:
    """Add the raw score, the lower the more unusual; an array of scores with `prefixes`.

    A table whose model has a tree too large for a task gets a row number first and is scored by joins. One whose
    model has more than CHUNKS_AT_ONCE chunks of trees is scored in tasks that hold a chunk.
    """
    sizes = _tree_sizes(forest)
    chunks = _chunks(sizes)
    if chunks is not None and len(chunks) > CHUNKS_AT_ONCE and not df.isStreaming:
        return _score_in_tasks(df, forest, sizes, prefixes, column)
    scores = _expression(forest, sizes, prefixes)
    if scores is not None:
        return df.withColumn(column, scores)
    numbered = store(df.withColumn("_row", F.monotonically_increasing_id()))
    return score_by_join(numbered, "_row", forest, column, prefixes).drop("_row")


def score_forest(df: DataFrame, forest: Forest) -> DataFrame:
    """Add `score` (below 0 is unusual) and `prediction` (-1 or 1). Works on batches and on streams."""
    check_feature_schema(df, forest.features)
    return decide(score_samples(df, forest), forest)


def decide(scored: DataFrame, forest: Forest) -> DataFrame:
    offset = F.lit(forest.offsets.get(ONE_MODEL))
    if forest.by:
        offset = F.element_at(F.create_map(*[F.lit(v) for kv in forest.offsets.items() for v in kv]),
                              F.col(forest.by).cast("string"))
    return (
        scored.withColumn("score", F.col("score_sample") - offset).drop("score_sample")
        .withColumn("prediction", F.when(F.col("score") < 0, -1).otherwise(1))
    )


def score_by_join(df: DataFrame, key: str, forest: Forest, column: str = "score_sample", prefixes: list[int] | None = None) -> DataFrame:
    """The same raw score for trees of any size: rows walk down the node table by equi joins, level by level.

    `key` must identify a row. All rows start at the same roots; adaptive execution splits such hot keys, as each
    of them meets one node row.
    """
    group = ["model", "tree_id", "node_id"]
    nodes = store(forest.nodes.select(*group, "depth", "is_leaf", "feature", "threshold", "n_samples"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(forest.n_estimators - 1)))
    at = (
        _rows(df, key, forest.features, forest.by)
        .withColumn("tree_id", trees).withColumn("node_id", F.lit(1).cast("bigint"))
    )
    value = F.get(F.array(*[F.col(f) for f in forest.features]), F.col("feature")).cast("double")
    n = F.col("n_samples").cast("double")
    long = 2 * (F.log(n - 1) + F.lit(float(np.euler_gamma))) - 2 * (n - 1) / n
    extra = F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(long)
    finished = []
    for level in range(max(height_limit(s) for s in forest.samples.values()) + 1):
        joined = at.join(nodes, group)
        finished.append(joined.filter("is_leaf").select("model", "key", "tree_id", (F.col("depth") + extra).alias("path")))
        at = (
            joined.filter("not is_leaf")
            .withColumn("node_id", 2 * F.col("node_id") + (value > F.col("threshold")).cast("bigint"))
            .select("model", "key", *forest.features, "tree_id", "node_id")
        )
        if (level + 1) % LEVELS_PER_CHECKPOINT == 0:
            at = store(at)
    paths = finished[0]
    for part in finished[1:]:
        paths = paths.unionByName(part)
    counts = prefixes or [forest.n_estimators]
    sums = paths.groupBy("model", "key").agg(*[F.sum(F.when(F.col("tree_id") < c, F.col("path"))).alias(f"_s{i}") for i, c in enumerate(counts)])
    scale = _scales(forest, F.col("model"))
    score = [-F.pow(F.lit(2.0), -F.when(scale > 0, F.col(f"_s{i}") / c / scale).otherwise(F.lit(1.0))) for i, c in enumerate(counts)]
    scores = sums.select(F.col("key").alias("_key"), (F.array(*score) if prefixes else score[0]).alias(column))
    return df.join(scores, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def anomaly_name(prediction: Column | str = "prediction") -> Column:
    prediction = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.when(prediction == -1, F.lit("ANOMALY")).otherwise(F.lit("NORMAL"))
