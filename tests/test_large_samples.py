"""Forests of large samples, whose rows are held once for all trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import forest as fo


@pytest.mark.parametrize("copies", [1, 40])
def test_weights_stand_for_equal_rows(copies):
    x = np.random.default_rng(3).integers(0, 6, (300, 3)).astype(np.float32)
    w = np.random.default_rng(4).integers(1, 1 + copies, 300)
    plain = fo.build_subtree(np.repeat(x, w, axis=0), 42, "all", 2, 9)
    assert fo.build_subtree(x, 42, "all", 2, 9, weights=w).equals(plain)
    number, some, weights = fo._combine(np.zeros(300, dtype=np.int64), x, w[:, None].astype(np.int32))
    assert weights.sum() == w.sum() and len(some) == len(np.unique(x, axis=0)) < 300
    assert fo.build_subtree(some, 42, "all", 2, 9, weights=weights[:, 0]).equals(plain)


def _rows(spark, values):
    """Two models; keys repeat, one of them has a fifth of the rows; with `few` also whole rows do."""
    n = F.col("id")
    value = F.pmod(F.xxhash64(n), F.lit(7 if values == "few" else 1 << 20)).cast("double")
    key = F.when(n < 1600, 0).when(n < 4000, n - n % 16).otherwise(n)
    return spark.range(8000).repartition(5).select(key.alias("key"), F.when(n % 4 == 0, "x").otherwise("y").alias("m"), value.alias("a"),
                                                    (F.xxhash64(n, F.lit(1)) % 5).cast("double").alias("b"))


@pytest.mark.parametrize("values", ["many", "few"])
@pytest.mark.parametrize("subtree_rows", [150, 100_000])
def test_trees_are_those_of_the_plain_samples(spark, values, subtree_rows):
    table = _rows(spark, values)
    model = fo.fit_forest(table, "key", 3, 0.7, None, 5, ["a", "b"], "m", subtree_rows)
    rows = fo._rows(table, "key", ["a", "b"], "m")
    drawn = fo._tree_rows(rows, fo.model_sizes(rows), model.samples, 3, 5)
    start = drawn.withColumn("node_id", F.lit(1).cast("bigint")).withColumn("depth", F.lit(0))
    plain = fo._build_in_tasks(start, {m: fo.height_limit(n) for m, n in model.samples.items()}, ["a", "b"], 5)
    assert model.nodes.exceptAll(plain).count() == 0 and plain.exceptAll(model.nodes).count() == 0


@pytest.mark.parametrize("chunks", [2, 6])
def test_large_trees_score_as_small_ones(spark, monkeypatch, chunks):
    table = _rows(spark, "many")
    model = fo.fit_forest(table, "key", 6, 0.7, None, 5, ["a", "b"])
    want = fo.score_samples(table, model, [1, 4, 6], "s").select("a", "b", "s")
    monkeypatch.setattr(fo, "LARGE_TREE", 0)
    monkeypatch.setattr(fo, "MAX_BROADCAST_NODES", {2: model.nodes.count() // 2, 6: model.nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0]}[chunks])
    assert len(fo.tree_chunks(model)) >= min(chunks, fo.CHUNKS_AT_ONCE + 1)
    got = fo.score_samples(table, model, [1, 4, 6], "s").select("a", "b", "s")
    close = lambda df: df.select("a", "b", F.transform("s", lambda v: F.round(v, 12)).alias("s"))
    assert close(got).exceptAll(close(want)).count() == 0 and got.count() == 8000


def test_nodes_of_a_large_forest_stay_in_tasks(spark, monkeypatch):
    """The driver gets no nodes but those of a forest of one chunk, as arrays; scores are those of a forest packed at once."""
    table = _rows(spark, "many").withColumn("b", F.when(F.col("b") > 0, F.col("b")))
    model = fo.fit_forest(table, "key", 6, 0.7, None, 5, ["a", "b"], "m")
    asked = table.select("m", "a", "b").unionByName(spark.sql("SELECT 'z' AS m, 1D AS a, 2D AS b UNION ALL SELECT NULL, 1D, 2D UNION ALL SELECT 'x', CAST('NaN' AS DOUBLE), -0D"))
    trees = model.nodes.toPandas()
    whole = {m: fo.pack(part) for m, part in trees.groupby("model")}
    want = fo.score_samples(asked, model, [1, 4, 6], "s")

    seen, plain = [], type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda df: (seen.append(plain(df)), seen[-1])[1])
    for name, value in {"DRIVER_NODES": 0, "CHUNK_NODES": trees.groupby("tree_id").size().max(), "LARGE_TREE": 0, "SCORE_VALUES": 5000}.items():
        monkeypatch.setattr(fo, name, value, raising=False)
    got = fo.score_samples(asked, model, [1, 4, 6], "s")
    assert len(fo.tree_chunks(model)) >= 4 and not seen
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    monkeypatch.setattr(fo, "CHUNK_NODES", len(trees))
    (first, shared), = fo._share(model, fo._tree_sizes(model))
    assert first == 0 and sum(t.nbytes for t in seen) < 30 * len(trees) and shared.value.keys() == whole.keys()
    for m, arrays in whole.items():
        assert all(np.array_equal(shared.value[m][k], v) and np.asarray(shared.value[m][k]).dtype == np.asarray(v).dtype for k, v in arrays.items())
