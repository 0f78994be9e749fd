"""Dictionary codes: distinct values in ascending order become 0..n-1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.scalars import text
from logsieve.session import materialise

SMALL_DICTIONARY = 1_000_000


def dense_index(df: DataFrame, order_by: str, name: str) -> DataFrame:
    """Rows of a table of unique values numbered 0.. in order, without one task that sorts them all.

    The table is range-partitioned; each partition numbers its own rows and adds the rows of the partitions
    before it. Only one count per partition passes through the driver.
    """
    ranged = materialise(
        df.repartitionByRange(F.col(order_by)).withColumn("_part", F.spark_partition_id())
    )
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    within = F.row_number().over(W.partitionBy("_part").orderBy(order_by))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_start") + within - 1).cast("bigint"))
        .drop("_part", "_start")
    )


def fit_dictionaries(df: DataFrame, columns: list[str], small: int = SMALL_DICTIONARY) -> dict[str, tuple[DataFrame, bool]]:
    """Per column `(value, code)` over its distinct values, and whether it is small enough to broadcast.

    One scan collects the distinct values of all columns; the rows themselves are never sorted. Up to `small` values
    a window over the distinct set gives the codes; beyond that they come from `dense_index`.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])).alias("p")
    values = materialise(df.select(pairs).select("p.column", "p.value").distinct())
    sizes = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    code = (F.row_number().over(W.partitionBy("column").orderBy("value")) - 1).cast("bigint")
    few = [c for c in columns if sizes.get(c, 0) <= small]
    coded = values.filter(F.col("column").isin(few)).withColumn("code", code)
    out = {}
    for c in columns:
        mine = F.col("column") == c
        if c in few:
            out[c] = coded.filter(mine).select("value", "code"), True
        else:
            out[c] = dense_index(values.filter(mine).select("value"), "value", "code"), False
    return out


def fit_dictionary(df: DataFrame, column: str, small: int = SMALL_DICTIONARY) -> tuple[DataFrame, bool]:
    return fit_dictionaries(df, [column], small)[column]


def encode(df: DataFrame, columns: dict[str, str], small: int = SMALL_DICTIONARY) -> DataFrame:
    """Replace each text column by its dictionary code: `{raw column: code column}`.

    Fit on the union of all sources by passing the union. A small dictionary is broadcast, so the rows are not
    shuffled; a large one is joined by value, where adaptive execution splits a hot value.
    """
    out = df
    for raw, (dictionary, is_small) in fit_dictionaries(df, list(columns), small).items():
        out = apply_dictionary(out, F.broadcast(dictionary) if is_small else dictionary, raw, columns[raw]).drop(raw)
    return out


def apply_dictionary(df: DataFrame, dictionary: DataFrame, raw: str, code_column: str) -> DataFrame:
    """Codes of a fitted dictionary; a value it has not seen becomes -1."""
    renamed = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return (
        df.join(renamed, text(raw) == F.col("_value"), "left")
        .withColumn(code_column, F.coalesce(F.col("_code"), F.lit(-1)))
        .drop("_value", "_code")
    )
