"""Dedup and upsert by key. Every step is an aggregation with map-side combine or an equi join on a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: list[str], chosen) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(chosen(F.struct(*rest)).alias("_row"))
    return out.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, key: str | list[str], order_by: Column) -> DataFrame:
    """One row per key, the one with the least order value; copies of a hot key collapse before the shuffle."""
    key = [key] if isinstance(key, str) else key
    return _pick(df, key, lambda row: F.min_by(row, order_by))


def last_per_key(df: DataFrame, key: str | list[str], order_by: Column) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    return _pick(df, key, lambda row: F.max_by(row, order_by))


def anti_join(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks; a null key is never known.

    A row with a null key gets a salt of its own that the other table cannot have, so that such rows are spread over
    the tasks instead of meeting in one.
    """
    own = F.pmod(F.xxhash64(*df.columns, F.spark_partition_id()), F.lit(2**62)) + 1
    left = df.withColumn("_salt", F.when(F.col(key).isNull(), own).otherwise(F.lit(0).cast("bigint"))).alias("l")
    # Always 0, but not a literal: the optimiser would take a literal out of the join key.
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("bigint"))
    right = other.filter(F.col(key).isNotNull()).select(key, zero.alias("_salt")).alias("r")
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._salt") == F.col("r._salt"))
    return left.join(right, same, "left_anti").drop("_salt")


def rows_to_insert(target: DataFrame, source: DataFrame, key: str, order_by: Column) -> DataFrame:
    """Insert-or-ignore: the first row of every key that the target does not have. Append them to the target."""
    return first_per_key(source, key, order_by).join(target.select(key), key, "left_anti").select(*source.columns)


def upsert_keep_first(target: DataFrame, source: DataFrame, key: str, order_by: Column) -> DataFrame:
    """The target after an insert that leaves existing keys untouched."""
    return target.unionByName(rows_to_insert(target, source, key, order_by), allowMissingColumns=True)


def upsert_replace(target: DataFrame, source: DataFrame, key: str, columns: list[str], order_by: Column,
                   stamp: tuple[str, Column] | None = None) -> DataFrame:
    """The target after an insert that, for a key it has, overwrites only `columns` and sets the stamp.

    `order_by` picks the last of several source rows with one key.
    """
    latest = last_per_key(source, key, order_by)
    t, s = target.alias("t"), latest.alias("s")
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    old, new = F.col(f"t.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()

    def column(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(name)
        if stamp and name == stamp[0]:
            return F.when(new, stamp[1]).otherwise(F.col(f"t.{name}")).alias(name)
        incoming = F.col(f"s.{name}") if name in latest.columns else F.lit(None)
        if name in columns:
            return F.when(new, incoming).otherwise(F.col(f"t.{name}")).alias(name)
        return F.when(old, F.col(f"t.{name}")).otherwise(incoming).alias(name)

    return joined.select(*[column(c) for c in target.columns])


def upsert_counts(target: DataFrame, source: DataFrame, key: str, batch: str | None = None) -> DataFrame:
    """Keys inserted and updated, per batch when the source says to which one a row belongs.

    Copies of a key in the source count once in a batch, and copies in the target not at all.
    """
    by = [batch] if batch else []
    known = target.select(F.col(key).alias("_known")).distinct()
    marked = source.select(key, *by).distinct().join(known, F.col(key) == F.col("_known"), "left")
    return marked.groupBy(*by).agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
        F.count("*").alias("upserted"),
    )
