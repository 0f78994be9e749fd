"""The forest against an independent traversal of its own node table, and its invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import forest as fo
from logsieve.operators.labels import SchemaDriftError
from logsieve.schema import FEATURES
from logsieve.sources.synthetic import synthetic_trail


@pytest.fixture(scope="module")
def table(spark):
    return synthetic_trail(spark, 3000, 300).persist()


@pytest.fixture(scope="module")
def model(table):
    return fo.fit_forest(table, "event_id", n_estimators=30)


def walk(nodes, trees, x):
    """Mean path length of one row, node by node."""
    total = 0.0
    for t in range(trees):
        node = nodes[(t, 1)]
        while not node.is_leaf:
            node = nodes[(t, node.left if x[node.feature] <= node.threshold else node.right)]
        n = node.n_samples
        extra = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
        total += node.depth + extra
    return total / trees


def test_scores_equal_a_plain_walk(table, model):
    nodes = {(r.tree_id, r.node_id): r for r in model.nodes.collect()}
    rows = fo.score_samples(table, model).orderBy("event_id").limit(60).collect()
    scale = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    for r in rows:
        mean = walk(nodes, 30, [np.float32(r[f]) for f in FEATURES])
        assert r.score_sample == pytest.approx(-(2 ** (-mean / scale)))


def test_invariants_of_the_node_table(model):
    nodes = model.nodes
    trees = nodes.groupBy("tree_id").agg(
        F.sum(F.when(F.col("is_leaf"), F.col("n_samples"))).alias("rows"), F.max("depth").alias("depth"),
        F.count_if("is_leaf").alias("leaves"), F.count_if(~F.col("is_leaf")).alias("inner"))
    assert trees.count() == 30
    assert trees.filter("rows <> 256 or depth > 8 or leaves <> inner + 1").count() == 0
    children = nodes.select("tree_id", F.col("node_id").alias("child"), F.col("n_samples").alias("c"))
    inner = nodes.filter("not is_leaf").select("tree_id", "node_id", "n_samples", F.explode(F.array("left", "right")).alias("child"))
    sums = inner.join(children, ["tree_id", "child"]).groupBy("tree_id", "node_id", "n_samples").agg(F.sum("c").alias("s"))
    assert sums.filter("s <> n_samples").count() == 0
    assert model.nodes.filter("n_samples = 0").count() == 0


def test_flagged_share_is_the_contamination(table, model):
    share = fo.score_forest(table, model).agg(F.avg((F.col("prediction") == -1).cast("int")).alias("s")).first().s
    assert abs(share - 0.08) < 0.002


def test_attacks_score_lower_and_extreme_vector_is_flagged(spark, table, model):
    means = {r.label: r.m for r in fo.score_forest(table, model).groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] < means[0]
    extreme = dict.fromkeys(FEATURES, 0.0) | {
        "is_error": 1.0, "is_root": 1.0, "hour": 3.0, "day_of_week": 6.0, "req_params_len": 5000.0, "event_name_enc": 999.0,
        "region_enc": 999.0, "is_mgmt_event": 1.0}
    row = spark.createDataFrame([extreme]).select(*FEATURES)
    assert fo.score_forest(row, model).first().prediction == -1
    named = fo.score_forest(row, model).select(fo.anomaly_name().alias("n")).first().n
    assert named == "ANOMALY"


def test_partitioning_does_not_change_the_model(table, model):
    for n in (1, 16):
        other = fo.fit_forest(table.repartition(n), "event_id", n_estimators=30)
        assert other.nodes.exceptAll(model.nodes).count() == 0
        assert other.offsets == model.offsets


def test_exact_samples_without_replacement(spark):
    table = spark.range(20_000).select("id", (F.col("id") % 97).cast("float").alias("a"), F.rand(1).alias("b"))
    rows = fo._rows(table, "id", ["a", "b"], None)
    drawn = fo.tree_samples(rows, {"all": 20_000}, {"all": 64}, 5, 7)
    per_tree = drawn.groupBy("tree_id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("d")).collect()
    assert [(r.n, r.d) for r in per_tree] == [(64, 64)] * 5
    fewer = fo.tree_samples(rows, {"all": 20_000}, {"all": 64}, 3, 7)
    assert fewer.exceptAll(drawn.filter("tree_id < 3")).count() == 0 and fewer.count() == 3 * 64


def test_copies_of_one_key_do_not_grow_a_tree(spark):
    table = spark.range(9000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("id"), F.rand(2).alias("a"))
    model = fo.fit_forest(table, "id", n_estimators=8, features=["a"])
    rows = model.nodes.filter("node_id = 1").agg(F.max("n_samples").alias("n"), F.count("*").alias("t")).first()
    assert rows.n <= 256 and rows.t == 8


def test_levels_build_the_same_trees_as_tasks(table):
    rows = fo._rows(table, "event_id", FEATURES, None)
    drawn = fo.tree_samples(rows, {"all": 3300}, {"all": 128}, 4, 11)
    start = drawn.withColumn("node_id", F.lit(1).cast("bigint")).withColumn("depth", F.lit(0))
    in_tasks = fo._build_in_tasks(start, {"all": 7}, FEATURES, 11)
    by_levels = fo.build_by_levels(drawn, {"all": 7}, FEATURES, 11, subtree_rows=30)
    assert by_levels.exceptAll(in_tasks).count() == 0 and in_tasks.exceptAll(by_levels).count() == 0


def test_a_share_of_the_table_as_sample(table):
    model = fo.fit_forest(table, "event_id", n_estimators=4, max_samples=0.5, subtree_rows=500)
    roots = model.nodes.filter("node_id = 1").collect()
    assert model.samples == {"all": 1650} and [r.n_samples for r in roots] == [1650] * 4
    whole = fo.fit_forest(table, "event_id", n_estimators=4, max_samples=0.5)
    assert whole.nodes.exceptAll(model.nodes).count() == 0      # the rule is one, whatever fits a task
    assert model.nodes.agg(F.max("depth")).first()[0] <= 11


def test_join_scoring_equals_broadcast_scoring(table):
    model = fo.fit_forest(table, "event_id", n_estimators=3, contamination=None)
    a = fo.score_samples(table, model).select("event_id", "score_sample")
    b = fo.score_by_join(table, "event_id", model, "joined").select("event_id", "joined")
    both = a.join(b, "event_id")
    assert both.count() == 3300
    assert both.filter("joined is null or abs(joined - score_sample) > 1e-12").count() == 0


def test_prefix_scores_are_scores_of_smaller_forests(table, model):
    small = fo.fit_forest(table, "event_id", n_estimators=10, contamination=None)
    pre = fo.score_samples(table, model, [10, 30], "s").select("event_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))
    ten = fo.score_samples(table, small, column="ten").select("event_id", "ten")
    all_trees = fo.score_samples(table, model, column="full").select("event_id", "full")
    joined = pre.join(ten, "event_id").join(all_trees, "event_id")
    assert joined.filter("abs(a - ten) > 1e-12 or abs(b - full) > 1e-12").count() == 0


def test_one_forest_per_group(table):
    grouped = table.withColumn("node", F.when(F.col("hour") < 12, "x").otherwise("y"))
    model = fo.fit_forest(grouped, "event_id", n_estimators=6, by="node")
    assert set(model.offsets) == {"x", "y"} and model.nodes.select("model", "tree_id").distinct().count() == 12
    scored = fo.score_forest(grouped, model)
    shares = scored.groupBy("node").agg(F.avg((F.col("prediction") == -1).cast("int")).alias("s")).collect()
    assert all(abs(r.s - 0.08) < 0.01 for r in shares)
    alone = fo.score_forest(grouped.filter("node = 'x'"), model)
    assert alone.select("event_id", "score").exceptAll(scored.filter("node = 'x'").select("event_id", "score")).count() == 0


def test_wrong_input_is_an_error(table, model):
    with pytest.raises(SchemaDriftError):
        fo.fit_forest(table.drop("hour"), "event_id")
    with pytest.raises(SchemaDriftError):
        fo.score_forest(table.withColumn("hour", F.lit("x")), model)
    with pytest.raises(ValueError):
        fo.fit_forest(table.limit(0), "event_id")


@pytest.mark.parametrize("bound", [1_000, 100])
def test_models_beyond_the_bound_get_the_same_scores(table, monkeypatch, bound):
    """First in chunks of trees, then, when no tree may be broadcast, by joins."""
    model = fo.fit_forest(table, "event_id", n_estimators=12)
    few = table.limit(400).persist()
    want = fo.score_samples(few, model, [5, 12], "want").select("event_id", "want")
    monkeypatch.setattr(fo, "MAX_BROADCAST_NODES", bound)
    chunks = fo.tree_chunks(model)
    assert chunks is None if bound == 100 else len(chunks) > 1 and chunks[0][0] == 0 and chunks[-1][1] == 12
    got = fo.score_samples(few, model, [5, 12], "got").select("event_id", "got")
    both = want.join(got, "event_id")
    assert both.count() == 400
    assert both.filter("abs(got[0] - want[0]) > 1e-12 or abs(got[1] - want[1]) > 1e-12 or got is null").count() == 0
    assert fo.score_forest(few, model).filter("prediction is null").count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """From another working directory the executors cannot import the package."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from logsieve.session import get_session
from logsieve.sources.synthetic import synthetic_trail
from logsieve.operators import forest, retrieval
spark = get_session("elsewhere", 2)
table = synthetic_trail(spark, 300, 30)
model = forest.fit_forest(table, "event_id", n_estimators=3)
print("rows", forest.score_forest(table, model).filter("score is not null").count())
v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<float>")
print("hits", retrieval.nearest(v.withColumnRenamed("id", "q"), v, 1, "q", "id").count())
print("placed", retrieval.assign_lists(v, retrieval.train_lists(v, "id", lists=2)).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 330" in done.stdout and "hits 2" in done.stdout and "placed 2" in done.stdout, done.stderr[-2000:]
