"""Partial rewrites of a keyed table, and a log that is asked for keys."""

import random

from pyspark.sql import functions as F

from logsieve.operators import upsert
from logsieve.sources.bucketed import BucketedTable
from logsieve.sources.keyed_log import KeyedLog, filter_of, may_hold

SCHEMA = "k string, v bigint, at bigint"


def rows(spark, ids, add=0, at=0):
    return spark.createDataFrame([(f"k{i}", i + add, at) for i in ids], SCHEMA)


def replace(target, source):
    return upsert.upsert_replace(target, source, "k", ["v", "at"], F.col("at"))


def test_a_small_upsert_rewrites_its_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=64)
    assert table.read().count() == 0 and table.upsert(rows(spark, []), replace) == [] and table.version() == 0
    table.upsert(rows(spark, range(2000)), replace)
    before, held = table.manifest(), table.read()
    assert len(before) == 64
    touched = table.upsert(rows(spark, range(1995, 2005), add=10_000, at=1), replace)
    after = table.manifest()
    assert len(touched) <= 10 and {b for b in after if after[b] != before.get(b)} == set(touched)
    new = {r.k: r.v for r in table.read().collect()}
    assert new == {f"k{i}": i + (10_000 if i >= 1995 else 0) for i in range(2005)}
    assert {r.k: r.v for r in held.collect()} == {f"k{i}": i for i in range(2000)}          # a reader of the old manifest
    assert table.read(version=1).count() == 2000 and table.version() == 2
    read = table.read(buckets=set(touched[:2]))
    assert 0 < read.count() < 300


def test_a_bucket_without_rows_leaves_the_manifest(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=4)
    table.write(rows(spark, range(40)))
    bucket = table.upsert(rows(spark, [3]), lambda target, source: target.limit(0))[0]
    assert bucket not in table.manifest() and 0 < table.read().count() < 40
    table.write(rows(spark, []))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(None, 1, 1), ("a", 2, 2)], SCHEMA), lambda target, source: target.unionByName(source))
    assert table.read().count() == 2


def test_a_job_that_dies_before_the_switch_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, "k", buckets=4)
    table.write(rows(spark, range(10)))

    def fails(target, source):
        return target.withColumn("v", F.raise_error(F.lit("died")).cast("bigint"))

    try:
        table.upsert(rows(spark, [1]), fails)
        raise AssertionError
    except Exception as e:
        assert "died" in str(e)
    assert table.version() == 1 and table.read().count() == 10


def test_filters_hold_their_keys():
    rng = random.Random(1)
    own = [str(rng.random()) for _ in range(3000)]
    bits = filter_of(own)
    assert all(may_hold(bits, [k]) for k in own)
    assert sum(may_hold(bits, [str(rng.random())]) for _ in range(3000)) < 60


def test_only_files_that_may_hold_a_key_are_read(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), "event_id string, v bigint", "event_id", file_rows=100)
    every = []
    for batch in range(4):
        ids = [f"{batch}-{i:05d}" for i in range(1000)] + ["both", None]
        every += [(i, batch) for i in ids]
        log.append(spark.createDataFrame([(i, batch) for i in ids], "event_id string, v bigint"), batch)
    ask = lambda ids: spark.createDataFrame([(i,) for i in ids], "key string")
    read = log.files_for(ask(["2-00005", "2-00006", "2-00990", "9-1", "zz", None]))
    assert 1 <= len(read) <= 3 and all("batch_id=2" in f for f in read)
    assert {f.split("/")[-2] for f in log.files_for(ask(["both"]), before=3)} >= {"batch_id=0", "batch_id=1", "batch_id=2"}
    assert log.files_for(ask(["both"]), before=0) == [] == log.files_for(ask([]))
    asked = [f"{b}-{i:05d}" for b in range(6) for i in range(0, 1500, 77)] + ["both", "x"]
    for before in (None, 2):
        got = sorted((r.event_id, r.v) for r in log.rows_for(ask(asked + asked[:5]), before).collect())
        assert got == sorted((i, b) for i, b in every if i in asked and (before is None or b < before))
    log.append(spark.createDataFrame([("new", 1)], "event_id string, v bigint"), 3)      # a replay replaces its batch
    assert log.rows_for(ask(["new", "3-00001"])).count() == 1


def test_keys_too_many_to_send_read_every_file(spark, tmp_path, monkeypatch):
    from logsieve.sources import keyed_log
    log = KeyedLog(spark, str(tmp_path / "log"), "event_id string", "event_id", file_rows=10)
    log.append(spark.createDataFrame([(str(i),) for i in range(50)], "event_id string"), 0)
    monkeypatch.setattr(keyed_log, "SENT_BYTES", 10)
    assert len(log.files_for(spark.createDataFrame([("3",)], "key string"))) >= 5
    assert [r.event_id for r in log.rows_for(spark.createDataFrame([("3",), ("x",)], "key string")).collect()] == ["3"]
