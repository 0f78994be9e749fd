"""Samples by levels where keys repeat."""

import pytest
from pyspark.sql import functions as F

from logsieve.operators import forest as fo


@pytest.mark.parametrize("features", ["rand", "equal"])
def test_levels_keep_every_tree_where_a_key_holds_a_third_of_the_rows(spark, features):
    one = F.col("id") < 3000
    value = F.xxhash64("id").cast("double")
    table = spark.range(9000).select(F.when(one, 0).when(F.col("id") < 6000, F.col("id") - F.col("id") % 16).otherwise(F.col("id")).alias("key"),
                                     F.when(one & F.lit(features == "equal"), 0.5).otherwise(value).alias("a"))
    rows = fo._rows(table, "key", ["a"], None).persist()
    drawn = fo._tree_rows(rows, {"all": 9000}, {"all": 4500}, 6, 42).persist()
    assert {r.tree_id: r["count"] for r in drawn.groupBy("tree_id").count().collect()} == dict.fromkeys(range(6), 4500)
    mine = drawn.filter("tree_id = 0").drop("tree_id")
    h = fo._hash(F.lit(42), F.col("key"), F.lit(0))
    left = rows.exceptAll(mine)
    assert left.count() == 4500 and mine.agg(F.max(h)).first()[0] <= left.agg(F.min(h)).first()[0]


@pytest.mark.parametrize("copies", ["third", "64", "one key", "equal rows"])
def test_ranked_samples_are_full_and_the_same_as_by_levels(spark, copies):
    ids = F.col("id")
    key = {"third": F.when(ids < 4000, 0).otherwise(ids), "64": ids - ids % 64, "one key": F.lit(1), "equal rows": ids - ids % 64}[copies]
    value = F.col("key").cast("double") if copies == "equal rows" else F.xxhash64("id").cast("double")
    table = spark.range(12_000).select(ids, key.alias("key")).select("key", value.alias("a"))
    rows = fo._rows(table, "key", ["a"], None).persist()
    ranked = fo.tree_samples(rows, {"all": 12_000}, {"all": 256}, 30, 42).select("tree_id", "key", "a").persist()
    assert {r.tree_id: r["count"] for r in ranked.groupBy("tree_id").count().collect()} == dict.fromkeys(range(30), 256)
    by_levels = fo._tree_rows(rows, {"all": 12_000}, {"all": 256}, 30, 42).select("tree_id", "key", "a")
    assert ranked.exceptAll(by_levels).count() == 0 and by_levels.exceptAll(ranked).count() == 0
    again = fo.tree_samples(rows.repartition(13), {"all": 12_000}, {"all": 256}, 30, 42).select("tree_id", "key", "a")
    assert ranked.exceptAll(again).count() == 0


def test_ranks_are_limited_before_the_shuffle(spark):
    rows = fo._rows(spark.range(5000).select(F.lit(1).alias("key"), F.col("id").cast("double").alias("a")), "key", ["a"], None)
    plans = []
    keep = fo.store
    fo.store = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
    try:
        fo.tree_samples(rows, {"all": 5000}, {"all": 64}, 2, 1)
    finally:
        fo.store = keep
    below = plans[0].split("Exchange hashpartitioning(", 1)[1]
    assert "WindowGroupLimit" in below and "Partial" in below


@pytest.mark.parametrize("by", [None, "m"])
def test_scoring_once_gives_the_same(spark, by):
    table = spark.range(3000).select("id", (F.col("id") % 2).cast("string").alias("m"), F.xxhash64("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    model, scored = fo.fit_and_score(table, "id", n_estimators=10, features=["a", "b"], by=by)
    other = fo.fit_forest(table, "id", n_estimators=10, features=["a", "b"], by=by)
    assert model.offsets == other.offsets and model.nodes.exceptAll(other.nodes).count() == 0
    assert scored.exceptAll(fo.score_forest(table, other)).count() == 0 and scored.count() == 3000
