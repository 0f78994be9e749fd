"""Order statistics, splits, dictionaries, upserts, metrics and the quality gate against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsieve.operators import quantiles as qn
from logsieve.operators.encode import apply_dictionary, dense_index, encode, fit_dictionary
from logsieve.operators.metrics import (
    average_parameters, best_trial, binary_metrics, predicted_anomaly, round_metrics, weighted_average,
)
from logsieve.operators.quality import anomaly_rate, node_report, quality_report, union_sources, verdict
from logsieve.operators.split import half_split, node_coverage, node_split, stratified_split
from logsieve.operators.upsert import (
    anti_join, first_per_key, last_per_key, rows_to_insert, upsert_counts, upsert_keep_first, upsert_replace,
)
from logsieve.sources.synthetic import synthetic_trail


# Order statistics


@pytest.fixture
def few(monkeypatch):
    """Few bins, so that several narrowing passes run on small data."""
    monkeypatch.setattr(qn, "BINS", 64)


def asked(found, qs):
    """The values in the order of the quantiles."""
    by = {r["quantile"]: r["value"] for r in found.collect()}
    return [by[q] for q in qs]


@pytest.mark.parametrize("kind", ["uniform", "skewed", "hot", "constant", "wide"])
def test_quantiles_equal_numpy(spark, few, kind):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.random(5000), "skewed": rng.lognormal(0, 4, 5000),
        "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.normal(7, 1, 5000)), "constant": np.full(500, 2.5),
        "wide": rng.choice([-1e300, -1.0, 0.0, 1e-300, 5.0, 1e300], 500),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    qs = [0.0, 0.01, 0.08, 0.5, 0.731, 0.99, 1.0]
    got = asked(qn.exact_quantiles(df, "v", qs), qs)
    assert got == pytest.approx(list(np.quantile(values, qs)), rel=1e-12)
    ordered = np.sort(values)
    assert asked(qn.exact_quantiles(df, "v", [0.5, 0.99], method="index"), [0.5, 0.99]) == [ordered[int(len(values) * q)] for q in (0.5, 0.99)]


def test_quantiles_per_group_and_nulls(spark, few):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.19, 0.01]), "v": rng.normal(size=3000)})
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", None), ("d", None)], "g string, v double"))
    found = qn.exact_quantiles(df, "v", [0.08, 0.5], "g")
    got = {g: asked(found.filter(F.col("g") == g), [0.08, 0.5]) for g in {r.g for r in found.collect()}}
    assert set(got) == {"a", "b", "c"}
    for g, values in got.items():
        assert values == pytest.approx(list(np.quantile(frame[frame.g == g].v, [0.08, 0.5])))


def test_threshold_needs_scores(spark):
    with pytest.raises(ValueError):
        qn.contamination_threshold(spark.createDataFrame([], "score double"), 0.1)


# Splits


def test_stratified_split_is_exact_and_stable(spark, few):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i in range(200)], "id int, label int")
    out = stratified_split(df, "id")
    assert out.filter("is_train").count() == 160
    shares = {r.label: r.share for r in out.groupBy("label").agg(F.avg(F.col("is_train").cast("int")).alias("share")).collect()}
    assert all(abs(s - 0.8) < 0.02 for s in shares.values())
    for n in (1, 16):
        assert stratified_split(df.repartition(n), "id").exceptAll(out).count() == 0
    assert stratified_split(df, "id", seed=1).exceptAll(out).count() > 0
    with pytest.raises(ValueError):
        stratified_split(df.limit(0), "id")


def test_splits_are_exact_when_keys_repeat(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), F.col("id").alias("row"), (F.col("id") % 2).cast("int").alias("label"))
    halves = half_split(df, "key")
    assert halves.filter("is_first").count() == 500
    sizes = {(r.label, r.is_train): r["count"] for r in stratified_split(df, "key").groupBy("label", "is_train").count().collect()}
    assert sizes == {(0, True): 400, (0, False): 100, (1, True): 400, (1, False): 100}
    assert half_split(df.repartition(7), "key").exceptAll(halves).count() == 0


def test_quantiles_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    assert {r.g: r.value for r in qn.exact_quantiles(df, "v", [0.5], "g").collect()} == {None: 2.0, "a": 2.0}


def test_half_split_is_exact(spark, few):
    assert half_split(spark.range(101), "id").filter("is_first").count() == 50
    assert half_split(spark.range(1), "id").filter("is_first").count() == 0


def test_node_split_by_source_or_in_halves(spark):
    rows = [(i, s) for i, s in enumerate(["iam.x"] * 30 + ["s3.x"] * 40 + ["sns.x"] * 10 + ["IAM-ec2"] * 5 + [None] * 3)]
    df = spark.createDataFrame(rows, "id int, source string")
    by_source = {r.node: r["count"] for r in node_split(df, "source", "id", min_rows=20).groupBy("node").count().collect()}
    assert by_source == {"node1": 35, "node2": 45}
    halves = {r.node: r["count"] for r in node_split(df, "source", "id", min_rows=40).groupBy("node").count().collect()}
    assert halves == {"node1": 44, "node2": 44}
    assert node_coverage(df, "source").first() == (13, 70, 5)


# Dictionaries


def test_dictionary_codes_are_sorted(spark):
    rows = [("b",), ("a",), (None,), ("c",), ("a",), ("é",), ("B",)]
    df = spark.createDataFrame(rows, "x string")
    expected = {v: i for i, v in enumerate(sorted({r[0] or "" for r in rows}, key=lambda s: s.encode()))}
    for small in (1000, 2):      # the second takes the range-partitioned way
        dictionary, is_small = fit_dictionary(df, "x", small)
        assert is_small == (small == 1000)
        assert {r.value: r.code for r in dictionary.collect()} == expected
    assert sorted(r.c for r in encode(df, {"x": "c"}).collect()) == sorted(expected[r[0] or ""] for r in rows)
    unseen = apply_dictionary(spark.createDataFrame([("zzz",)], "x string"), dictionary, "x", "c")
    assert unseen.first().c == -1


def test_dense_index_over_many_partitions(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("v"))
    got = [r.v for r in dense_index(df, "v", "i").orderBy("i").collect()]
    assert got == sorted(got) and len(got) == 5000


# Upserts


@pytest.fixture
def sides(spark):
    target = spark.createDataFrame([("a", 1, "old", 0), ("b", 2, "old", 0)], "k string, v int, t string, at int")
    source = spark.createDataFrame([("b", 20, "new", 1), ("c", 30, "new", 1), ("c", 31, "newer", 2)],
                                   "k string, v int, t string, at int")
    return target, source


def test_insert_or_ignore(spark, sides):
    target, source = sides
    merged = {r.k: r.t for r in upsert_keep_first(target, source, "k", F.col("at")).collect()}
    assert merged == {"a": "old", "b": "old", "c": "new"}
    again = upsert_keep_first(target, source, "k", F.col("at"))
    assert rows_to_insert(again, source, "k", F.col("at")).count() == 0


def test_insert_or_update_touches_listed_columns_only(sides):
    target, source = sides
    merged = {r.k: (r.v, r.t, r.at) for r in upsert_replace(target, source, "k", ["t"], F.col("at"), ("at", F.lit(99))).collect()}
    assert merged == {"a": (1, "old", 0), "b": (2, "new", 99), "c": (31, "newer", 99)}
    assert upsert_counts(target, last_per_key(source, "k", F.col("at")), "k").first() == (1, 1, 2)


def test_first_and_last_per_key(sides):
    _, source = sides
    assert {r.k: r.v for r in first_per_key(source, "k", F.col("at")).collect()} == {"b": 20, "c": 30}
    assert {r.k: r.v for r in last_per_key(source, "k", F.col("at")).collect()} == {"b": 20, "c": 31}


def test_anti_join_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), (None,)], "k string")
    other = spark.createDataFrame([("a",), (None,)], "k string")
    assert sorted(str(r.k) for r in anti_join(df, other, "k").collect()) == ["None", "None", "b"]


# Metrics


def test_binary_metrics(spark):
    rows = [(1, -1)] * 3 + [(1, 1)] * 2 + [(0, -1)] + [(0, 1)] * 4
    got = binary_metrics(spark.createDataFrame(rows, "y int, prediction int"), "y", predicted_anomaly()).first()
    assert (got.n, got.precision, got.recall, got.f1) == (10, 0.75, 0.6, pytest.approx(2 / 3))
    none = binary_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_weighted_averages(spark):
    df = spark.createDataFrame([(1, 100, 0.5, None), (1, 300, 0.9, 0.4), (2, 0, 0.7, 0.1)],
                               "r int, n int, f1 double, recall double")
    as_zero = {r.r: (r.f1, r.recall) for r in weighted_average(df, "n", ["f1", "recall"], ["r"]).collect()}
    assert as_zero == {1: (pytest.approx(0.8), pytest.approx(0.3)), 2: (0.0, 0.0)}
    left_out = {r.r: r.recall for r in weighted_average(df, "n", ["recall"], ["r"], missing_as_zero=False).collect()}
    assert left_out == {1: pytest.approx(0.4), 2: None}
    assert average_parameters(df.filter("r = 1"), "n", "f1").first().f1 == pytest.approx(0.8)


def test_round_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.4, 0.3, 0.2), (1, 3, 0.9, 0.8, 0.7, 0.6)],
                               "round int, n int, train_f1 double, eval_f1 double, eval_precision double, eval_recall double")
    row = round_metrics(df).first()
    assert (row.num_clients, row.train_f1, row.eval_loss) == (2, pytest.approx(0.8), pytest.approx(0.3))


def test_best_trial_stops_at_the_goal(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.8), (2, 0.9), (3, 0.9), (4, None)], "trial_id int, f1 double")
    assert best_trial(df).first().trial_id == 2
    assert best_trial(df, goal=0.7).first().trial_id == 1
    assert best_trial(df, goal=0.95).first().trial_id == 2
    assert best_trial(df.filter("f1 is null")).count() == 0


# Quality gate


def test_gate_passes_and_fails(spark):
    good = synthetic_trail(spark, 1000, 100)
    assert verdict(quality_report(good, min_rows=1000)).first().failed == 0
    bad = (good.drop("region_enc").withColumn("hour", F.col("hour") + 20)
           .withColumn("is_root", F.when(F.col("is_root") == 1, 2.0).otherwise(None)).withColumn("label", F.lit(1)))
    failed = {r.check for r in quality_report(bad, min_rows=10_000).filter("not passed").collect()}
    assert failed == {"row_count", "anomaly_rate", "null_features", "missing_columns", "hour_out_of_range", "is_root_not_binary"}


def test_node_gate_fails_for_an_absent_node(spark):
    nodes = synthetic_trail(spark, 1500, 100).withColumn("node", F.lit("node1"))
    failed = {r.check for r in node_report(nodes, ["node1", "node2"]).filter("not passed").collect()}
    assert failed == {"node2_row_count"}


def test_union_and_rates(spark):
    a = spark.createDataFrame([(1, 0)], "x int, label int")
    b = spark.createDataFrame([(1, 1, "z"), (1, 1, "z")], "x int, label int, extra string")
    table = union_sources({"a": a, "b": b, "none": a.limit(0)})
    rates = {r.source: (r.n, r.rate) for r in anomaly_rate(table, "source").collect()}
    assert rates == {"a": (1, 0.0), "b": (2, 1.0), None: (3, pytest.approx(2 / 3))}
    with pytest.raises(ValueError):
        union_sources({"a": a.limit(0)})
