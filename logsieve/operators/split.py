"""Seeded splits by the hash of the row key: the same rows in any partitioning, and no sort of the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.scalars import unit_hash
from logsieve.operators.labels import source_matches
from logsieve.operators.quantiles import broadcast_few, group_column, group_sizes, order_statistics
from logsieve.session import store

# Which node holds the events of which services, and the size below which a half split is used.
NODE_PATTERNS = {"node1": "iam", "node2": "s3|ec2|compute"}
MIN_NODE_ROWS = 1000


def _hashes(hashed: DataFrame, by: str | None) -> DataFrame:
    """(_of, _h, _h2): group and hashes of every row, stored: they are scanned in every pass and dear to compute."""
    return store(hashed.select(group_column("_h", by).alias("_of"), "_h", "_h2"))


def _cut(hashes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_g, cut, cut2): per group the hash pair up to which exactly k + 1 rows lie, for `wanted` (g, k).

    Rows with the same key have the same first hash. Where a cut falls among such rows the second hash, of the whole
    row, decides; only copies of a whole row cannot be told apart.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    cuts = order_statistics(hashes, "_h", wanted, "_of").select(F.col("g").alias("_g"), "k", F.col("value").alias("cut"))
    cuts = broadcast_few(cuts, cuts.count())
    ties = store(
        hashes.join(cuts, same("_of", "_g")).groupBy("_g", "k", "cut").agg(F.count_if(F.col("_h") < F.col("cut")).alias("under"), F.count_if(F.col("_h") == F.col("cut")).alias("tied")))
    inside = ties.filter(F.col("under") + F.col("tied") > F.col("k") + 1)
    n_inside = inside.count()
    if not n_inside:
        return ties.select("_g", "cut", F.lit(float("inf")).alias("cut2"))
    here = broadcast_few(inside.select(F.col("_g").alias("_t"), "cut"), n_inside)
    tied = store(hashes.join(here, same("_of", "_t") & (F.col("_h") == F.col("cut"))).select("_of", "_h2"))
    second = order_statistics(tied, "_h2", inside.select(F.col("_g").alias("g"), (F.col("k") - F.col("under")).alias("k")), "_of")
    second = second.select(F.col("g").alias("_s"), F.col("value").alias("cut2"))
    return ties.join(second, same("_g", "_s"), "left").select("_g", "cut", F.coalesce("cut2", F.lit(float("inf"))).alias("cut2"))


def _flag(hashed: DataFrame, cuts: DataFrame, by: str | None, column: str) -> DataFrame:
    cuts = store(cuts)
    joined = hashed.withColumn("_of", group_column("_h", by)).join(broadcast_few(cuts, cuts.count()), F.col("_of").eqNullSafe(F.col("_g")), "left")
    within = (F.col("_h") < F.col("cut")) | (F.col("_h") == F.col("cut")) & (F.col("_h2") <= F.col("cut2"))
    return joined.withColumn(column, F.coalesce(within, F.lit(False))).drop("_h", "_h2", "_of", "_g", "cut", "cut2")


def _second_hash(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.lit(1 << 52)).cast("double")


def stratified_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.2,
                     seed: int = 42, column: str = "is_train") -> DataFrame:
    """Add a flag that is true for the training rows; every label keeps its share and the sizes are exact.

    Per label the rows with the smallest key hashes train; among rows with one key a hash of the whole row decides.
    The cut is an exact order statistic of the hash, found by counting, so a label that holds most rows is as cheap as
    any other. Rows are told apart by their columns: copies of a whole row stay together.
    """
    hashed = df.withColumn("_h", unit_hash(F.lit(str(seed)), F.col(key).cast("string"))).withColumn("_h2", _second_hash(df))
    hashes = _hashes(hashed, label)
    sizes = store(group_sizes(hashes, "_h", "_of"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        raise ValueError("cannot split an empty table")
    n_train = total - math.ceil(test_size * total)
    # Every label gets its share rounded down; what is left goes to the largest remainders.
    share = F.col("n") * F.lit(n_train) / F.lit(total)
    shares = store(sizes.select("g", share.alias("exact"), F.floor(share).cast("bigint").alias("k")))
    rest = n_train - shares.agg(F.sum("k").alias("k")).first()["k"]
    order = W.orderBy((F.col("k") - F.col("exact")).asc(), F.col("g").cast("string"))
    topped = shares.withColumn("k", F.col("k") + (F.row_number().over(order) <= rest).cast("bigint"))
    cuts = _cut(hashes, topped.filter("k > 0").select("g", (F.col("k") - 1).alias("k")))
    return _flag(hashed, cuts, label, column)


def half_split(df: DataFrame, key: str, column: str = "is_first") -> DataFrame:
    """True for exactly floor(n / 2) rows, those with the smallest key hashes; ties as in `stratified_split`."""
    hashed = df.withColumn("_h", unit_hash(F.col(key).cast("string"))).withColumn("_h2", _second_hash(df))
    hashes = _hashes(hashed, None)
    wanted = group_sizes(hashes, "_h", "_of").select("g", (F.floor(F.col("n") / 2) - 1).cast("bigint").alias("k")).filter("k >= 0")
    return _flag(hashed, _cut(hashes, wanted), None, column)


def node_membership(source: Column, patterns: dict[str, str] = NODE_PATTERNS) -> Column:
    """Names of the nodes whose pattern the source matches: none, one or several."""
    return F.array_compact(F.array(*[
        F.when(source_matches(source, pattern), F.lit(node)) for node, pattern in patterns.items()
    ]))


def node_split(df: DataFrame, source: str, key: str, patterns: dict[str, str] = NODE_PATTERNS,
               min_rows: int = MIN_NODE_ROWS) -> DataFrame:
    """One copy of a row per node that holds it; halves when a node would get fewer than `min_rows`."""
    member = node_membership(F.col(source), patterns)
    names = list(patterns)
    counts = df.agg(*[F.count_if(F.array_contains(member, n)).alias(n) for n in names]).first()
    if min(counts[n] for n in names) >= min_rows:
        return df.withColumn("node", F.explode(member))
    halves = half_split(df, key, "_first")
    return halves.withColumn("node", F.when(F.col("_first"), names[0]).otherwise(names[1])).drop("_first")


def node_coverage(df: DataFrame, source: str, patterns: dict[str, str] = NODE_PATTERNS) -> DataFrame:
    """How many rows belong to no node, to one, and to several."""
    n = F.size(node_membership(F.col(source), patterns))
    return df.agg(
        F.count_if(n == 0).alias("uncovered"),
        F.count_if(n == 1).alias("single"),
        F.count_if(n > 1).alias("shared"),
    )
