import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsieve.operators import monitor as mon

START = datetime(2026, 1, 1)


def greedy(rows, hours=4):
    last, sent = {}, set()
    for *group, t in sorted(rows, key=lambda r: r[-1]):
        key = tuple(group)
        if key not in last or t >= last[key] + timedelta(hours=hours):
            last[key] = t
            sent.add((*group, t))
    return sent


@pytest.mark.parametrize("fold_rows", [1_000_000, 40, 0])
def test_repeats_on_every_way(spark, fold_rows):
    rng = random.Random(9)
    names = ["hot"] * 8 + ["cold", None]
    rows = [(rng.choice(names), rng.choice(["x", None]), START + timedelta(seconds=rng.randint(0, 86400 * 4))) for _ in range(900)]
    rows += [("edge", "x", START + timedelta(hours=h)) for h in (0, 3, 4, 7, 8, 30)] + [("one", "x", START)] * 3
    df = spark.createDataFrame(rows, "name string, space string, ts timestamp")
    got = {tuple(r) for r in mon.suppress_repeats(df, ["name", "space"], "ts", fold_rows=fold_rows).collect()}
    assert got == greedy(rows)


def test_repeats_go_on_from_earlier_batches(spark):
    rows = [("a", START + timedelta(hours=h)) for h in (0, 1, 3.9, 4, 5, 9)] + [("b", START)]
    df = spark.createDataFrame(rows, "name string, ts timestamp")
    whole = {tuple(r) for r in mon.suppress_repeats(df, ["name"], "ts").collect()}
    cut = START + timedelta(hours=3.5)
    first = mon.suppress_repeats(df.filter(F.col("ts") < F.lit(cut)), ["name"], "ts")
    second = mon.suppress_repeats(df.filter(F.col("ts") >= F.lit(cut)), ["name"], "ts", last_sent=first)
    assert {tuple(r) for r in first.unionByName(second).collect()} == whole == greedy(rows)
    assert mon.suppress_repeats(df.limit(0), ["name"], "ts").count() == 0


def test_windows(spark):
    rows = [(START + timedelta(minutes=m), d) for m, d in ((0, "genuine_bug"), (4, "known_change"), (5, "genuine_bug"), (61, "known_change"))]
    df = spark.createDataFrame(rows, "ts timestamp, decision string")
    counts = {r.window_start.minute + 60 * r.window_start.hour: r.n for r in mon.flagged_per_window(df, "ts").collect()}
    assert counts == {0: 2, 5: 1, 60: 1}
    rates = {r.window_start.hour: r.rate for r in mon.decision_rate(df, "ts").collect()}
    assert rates == {0: pytest.approx(2 / 3), 1: 0.0}


def test_histogram_quantile_interpolates(spark):
    rows = [("a", le, n) for le, n in ((1.0, 10), (2.0, 30), (5.0, 40), (float("inf"), 40))]
    rows += [("a", le, 0) for le in (1.0, 2.0)] + [("over", 1.0, 1), ("over", float("inf"), 10), ("none", 1.0, 0), ("none", float("inf"), 0)]
    df = spark.createDataFrame(rows, "s string, le double, n bigint")
    got = {(r.s, r.quantile): r.value for r in mon.histogram_quantile(df, [0.25, 0.5, 0.99], ["s"]).collect()}
    assert got[("a", 0.25)] == pytest.approx(1.0) and got[("a", 0.5)] == pytest.approx(1.5)
    assert got[("a", 0.99)] == pytest.approx(2 + 3 * (39.6 - 30) / 10)
    assert got[("over", 0.99)] == pytest.approx(1.0) and got[("none", 0.5)] is None


def test_buckets_are_cumulative(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 5, "v": [0.5, 1.0, 3.0, 7.0, 100.0]}))
    got = {r.le: r.n for r in mon.to_buckets(df, "v", [1.0, 5.0], ["k"]).collect()}
    assert got == {1.0: 2, 5.0: 3, float("inf"): 5}


def test_latency_by_sorted_index(spark):
    values = list(np.random.default_rng(1).random(20))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = mon.latency_quantiles(df, "v", [0.99], method="index").first().value
    assert got == sorted(values)[int(20 * 0.99)]


def test_counter_resets_and_extrapolation(spark):
    at = [(0, 10.0), (60, 20.0), (120, 5.0), (180, 15.0), (240, 30.0), (400, 1.0)]
    df = spark.createDataFrame([("a", START + timedelta(seconds=s + 30), v) for s, v in at], "s string, ts timestamp, v double")
    plain = {r.window_start.minute: r for r in mon.counter_increase(df, ["s"], "ts", "v", 300, extrapolate=False).collect()}
    assert set(plain) == {0} and plain[0].increase == 10 + 5 + 10 + 15 and plain[0].rate == pytest.approx(40 / 300)
    scaled = mon.counter_increase(df, ["s"], "ts", "v", 300).first()
    # 240 s sampled, 30 s to either end, both below 1.1 times the mean gap of 60 s.
    assert scaled.increase == pytest.approx(40 * 300 / 240)


def test_extrapolation_stops_at_zero(spark):
    df = spark.createDataFrame([("a", START + timedelta(seconds=s), v) for s, v in ((60, 1.0), (120, 31.0), (180, 61.0))],
                               "s string, ts timestamp, v double")
    got = mon.counter_increase(df, ["s"], "ts", "v", 300).first().increase
    # 2 s back to zero at the start, half a gap at the end because it is 120 s away.
    assert got == pytest.approx(60 * (120 + 2 + 30) / 120)


def test_ratios_lag_age_and_depth(spark):
    rates = spark.createDataFrame([("n", "idle", 3.0), ("n", "user", 1.0), ("m", "idle", 0.0)], "node string, mode string, rate double")
    assert {r.node: r.busy for r in mon.busy_ratio(rates, ["node"], "mode").collect()} == {"n": 0.25, "m": None}
    gauges = spark.createDataFrame([("n", "free", 25.0), ("n", "all", 100.0)], "node string, name string, v double")
    assert mon.used_ratio(gauges, ["node"], "name", "v", "free", "all").first().used == 0.75
    offsets = spark.createDataFrame([("t", 10, 4), ("t", 5, None)], "topic string, end_offset bigint, committed bigint")
    assert mon.consumer_lag(offsets, ["topic"]).first().lag == 11
    runs = spark.createDataFrame([(START,), (START + timedelta(seconds=50),)], "ts timestamp")
    assert mon.last_success_age(runs, "ts", F.lit(START + timedelta(seconds=80))).first().seconds == 30
    assert mon.dead_letter_depth(spark.createDataFrame([("q",), ("q",)], "queue string"), "queue").first().depth == 2
    assert mon.frequency(spark.createDataFrame([("q",), ("q",)], "d string"), "d").first().n == 2


def test_readiness(spark):
    pods = spark.createDataFrame([("a", "Running", [(True,), (True,)]), ("b", None, [(True,), (False,)]), ("c", "Pending", None)],
                                 "pod string, phase string, c array<struct<ready:boolean>>")
    got = {r.pod: (r.phase, r.ready) for r in mon.all_ready(pods, "pod", "phase", "c").collect()}
    assert got == {"a": ("Running", True), "b": ("Unknown", False), "c": ("Pending", True)}
    rows = spark.createDataFrame([("a", True), ("b", True), ("b", False), ("c", None)], "pod string, ready boolean")
    assert {r.pod: r.ready for r in mon.all_ready_rows(rows, "pod", "ready").collect()} == {"a": True, "b": False, "c": True}


def test_a_hot_series_is_dealt_out_by_time(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise((F.col("id") % 3).cast("string")).alias("s"),
                                      F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(7200 * 10 ** 6))).alias("ts"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)).cast("double").alias("v"))
    whole = mon.counter_increase(rows, ["s"], "ts", "v", 3600, slices=1).collect()
    sliced = mon.counter_increase(rows, ["s"], "ts", "v", 3600, slices=50).collect()
    by = lambda found: sorted((r.s, r.window_start, round(r.increase, 3), round(r.rate, 6)) for r in found)
    assert by(whole) == by(sliced) and len(whole) == 8
    few = spark.createDataFrame([("a", t, v) for t, v in ((5, 1.0), (5, 2.0), (3599, 9.0), (3600, 1.0))], "s string, t bigint, v double").withColumn("ts", F.timestamp_seconds("t"))
    for extrapolate in (False, True):
        one, many = (mon.counter_increase(few, ["s"], "ts", "v", 3600, extrapolate, n).collect() for n in (1, 64))
        assert one == many and len(one) == 1
