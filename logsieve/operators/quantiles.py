"""Exact order statistics without a global sort.

A histogram over the current bracket of a group finds the bin that holds a wanted rank; the bracket shrinks to that bin
until the rank is at one of its ends or all its values are equal. Each pass is one aggregation with map-side combine
and a window over at most BINS rows a bracket. Brackets, bins and results are tables: the driver sees a number a pass,
and neither the number of groups nor of rows that share a value is bounded. Quantiles of groups of at most SORTED_ROWS
rows come from one shuffle by group and a sort of each; the histogram is for the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.session import store

BINS = 2048
SORTED_ROWS = 50_000            # of a group that one task sorts
MAX_BROADCAST_GROUPS = 500_000


def broadcast_few(df: DataFrame, n: int) -> DataFrame:
    """The n rows marked for a broadcast if they are few: a join with a few groups needs no shuffle of the other side."""
    return F.broadcast(df) if n <= MAX_BROADCAST_GROUPS else df


def group_column(value: str, by: str | None) -> Column:
    """The group of a row. Without groups it is 0, but not a literal: the optimiser would take a literal out of a join."""
    return F.col(by) if by else F.pmod(F.xxhash64(value), F.lit(1).cast("bigint"))


def _rows(df: DataFrame, value: str, by: str | None) -> DataFrame:
    """(g, v): the group and the value of the rows that have one."""
    return df.select(group_column(value, by).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")


def _same_group(a: str, b: str = "g") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def group_sizes(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """(g, n, lo, hi) over the non-null values."""
    return _rows(df, value, by).groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def order_statistics(df: DataFrame, value: str, wanted: DataFrame, by: str | None = None) -> DataFrame:
    """(g, k, value): for each group the value at the zero-based ranks that `wanted` (g, k) asks for."""
    rows = _rows(df, value, by)
    sizes = group_sizes(df, value, by)
    asked = wanted.filter("k is not null").groupBy(F.col("g").alias("_w")).agg(F.collect_set("k").alias("ks"))
    # A step holds answers (value set) and brackets that are open (ks set): ranks are counted from `below` rows on.
    step = store(
        sizes.join(asked, _same_group("_w")).filter(F.size("ks") > 0)
        .select("g", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "ks", F.lit(None).cast("bigint").alias("k"),
                F.lit(None).cast("double").alias("value")))
    steps = [step]
    while n_open := step.filter("ks is not null").count():
        brackets = broadcast_few(step.filter("ks is not null").select(F.col("g").alias("_g"), "lo", "hi", "below", "ks"), n_open)
        inside = rows.join(broadcast_few(brackets.select("_g", "lo", "hi"), n_open), _same_group("_g") & F.col("v").between(F.col("lo"), F.col("hi")))
        width = F.col("hi") / BINS - F.col("lo") / BINS
        place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BINS - 1))).otherwise(F.lit(0))
        bins = (
            inside.groupBy("g", F.col("lo").alias("of"), place.alias("b"))
            .agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last")))
        upto = F.sum("n").over(W.partitionBy("g", "of").orderBy("b"))
        placed = (
            bins.withColumn("upto", upto).join(brackets, _same_group("_g") & (F.col("of") == F.col("lo")))
            .withColumn("start", F.col("below") + F.col("upto") - F.col("n"))
            .withColumn("mine", F.filter("ks", lambda k: (k >= F.col("start")) & (k < F.col("start") + F.col("n"))))
            .filter(F.size("mine") > 0))
        at_end = lambda k: (F.col("first") == F.col("last")) | (k == F.col("start")) | (k == F.col("start") + F.col("n") - 1)
        answers = F.transform(F.filter("mine", at_end), lambda k: F.struct(
            F.lit(None).cast("array<bigint>").alias("ks"), k.alias("k"), F.when(k == F.col("start"), F.col("first")).otherwise(F.col("last")).alias("value")))
        rest = F.filter("mine", lambda k: ~at_end(k))
        left = F.when(F.size(rest) > 0, F.array(F.struct(
            rest.alias("ks"), F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("double").alias("value")))).otherwise(F.array().cast("array<struct<ks:array<bigint>,k:bigint,value:double>>"))
        step = store(
            placed.select("g", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("start").alias("below"), F.explode(F.concat(answers, left)).alias("r"))
            .select("g", "lo", "hi", "below", "r.ks", "r.k", "r.value"))
        steps.append(step)
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out.filter("k is not null").select("g", "k", "value")


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: str | None = None,
                    method: str = "linear") -> DataFrame:
    """(`by`, quantile, value) of each group that has a value, without the first column if there are no groups.

    `linear` interpolates, `index` takes the value at position int(n * q).
    """
    if method not in ("linear", "index"):
        raise ValueError(f"unknown method {method}")
    if not by:
        return _by_histogram(df, value, qs, None, method).select("quantile", "value")
    sizes = group_sizes(df, value, by)
    large = store(sizes.filter(F.col("n") > SORTED_ROWS).select(F.col("g").alias("_b")))
    n_large = large.count()
    rows = _rows(df, value, by)
    if not n_large:
        return _by_sort(rows, qs, method).select(F.col("g").alias(by), "quantile", "value")
    large = broadcast_few(large, n_large)
    found = _by_sort(rows.join(large, _same_group("_b"), "left_anti"), qs, method)
    rest = _by_histogram(rows.join(large, _same_group("_b"), "left_semi"), "v", qs, "g", method)
    return found.unionByName(rest).select(F.col("g").alias(by), "quantile", "value")


def _place(n: Column, q: Column, method: str) -> Column:
    """Where the quantile lies among n ordered values, counted from 0."""
    return q * (n - 1) if method == "linear" else F.least(F.floor(n * q), n - 1)


def _by_sort(rows: DataFrame, qs: list[float], method: str) -> DataFrame:
    """(g, quantile, value) of groups that a task can sort, from (g, v)."""
    group = W.partitionBy("g")
    n, q = F.col("n"), F.col("quantile")
    ordered = rows.withColumn("i", F.row_number().over(group.orderBy("v")) - 1).withColumn("next", F.lead("v").over(group.orderBy("v"))).withColumn("n", F.count("*").over(group))
    # Only rows at a wanted place are taken apart.
    here = lambda c: F.floor(_place(n, c, method)) == F.col("i")
    met = ordered.withColumn("quantile", F.explode(F.filter(F.array(*[F.lit(float(v)) for v in qs]), here)))
    weight = _place(n, q, method) - F.col("i")
    return met.select("g", "quantile", F.when(weight > 0, F.col("v") + (F.coalesce("next", "v") - F.col("v")) * weight).otherwise(F.col("v")).alias("value"))


def _by_histogram(df: DataFrame, value: str, qs: list[float], by: str | None, method: str) -> DataFrame:
    """(g, quantile, value) of groups of any size."""
    places = group_sizes(df, value, by).select(F.col("g").alias("_p"), "n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("quantile"))
    at = _place(F.col("n"), F.col("quantile"), method)
    places = store(
        places.withColumn("at", at).withColumn("low", F.floor("at").cast("bigint"))
        .withColumn("high", F.least(F.ceil("at").cast("bigint"), F.col("n") - 1)).withColumn("weight", F.col("at") - F.col("low")))
    wanted = places.select(F.col("_p").alias("g"), F.explode(F.array("low", "high")).alias("k")).distinct()
    found = order_statistics(df, value, wanted, by)
    low = found.select(F.col("g").alias("_l"), F.col("k").alias("_lk"), F.col("value").alias("_lv"))
    high = found.select(F.col("g").alias("_h"), F.col("k").alias("_hk"), F.col("value").alias("_hv"))
    both = (
        places.join(low, _same_group("_l", "_p") & (F.col("low") == F.col("_lk")))
        .join(high, _same_group("_h", "_p") & (F.col("high") == F.col("_hk"))))
    mixed = F.when(F.col("weight") > 0, F.col("_lv") + (F.col("_hv") - F.col("_lv")) * F.col("weight")).otherwise(F.col("_lv"))
    return both.select(F.col("_p").alias("g"), "quantile", mixed.alias("value"))


def contamination_threshold(scores: DataFrame, contamination: float, score: str = "score",
                            by: str | None = None) -> DataFrame | float:
    """Score below which the given share of the training rows lies: (`by`, threshold), or a number without groups."""
    found = exact_quantiles(scores, score, [contamination], by)
    if by:
        return found.select(by, F.col("value").alias("threshold"))
    first = found.first()
    if first is None:
        raise ValueError("no scores to take a threshold from")
    return first["value"]
