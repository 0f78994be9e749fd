import gzip
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logsieve.schema import FEATURES, LABEL
from logsieve.sources.json_logs import (
    EmptyInputError, read_documents, read_json_any, read_ndjson, read_records_json, scan_since, split_corrupt,
)
from logsieve.sources.synthetic import synthetic_trail
from logsieve.sources.tables import (
    VersionedTable, advance_watermark, drop_expired_partitions, get_state, put_state, read_features, read_or_empty,
    read_runs, retained, spread, write_features, write_node_splits,
)


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if zipped:
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


@pytest.fixture
def logs(tmp_path, event):
    root = tmp_path / "logs"
    put(root / "a" / "one.json", json.dumps({"Records": [event(eventID="1"), event(eventID="2")]}))
    put(root / "b" / "two.json.gz", json.dumps({"Records": [event(eventID="3")]}, indent=1), zipped=True)
    put(root / "empty.json", json.dumps({"Records": []}))
    put(root / "broken.json", '{"Records": [')
    put(root / "scalar.json", "5")
    put(root / "other.txt", json.dumps({"Records": [event(eventID="9")]}))
    return root


def ids(df):
    return sorted(r.eventID for r in df.select("eventID").collect())


def test_wrapped_files(spark, logs):
    assert ids(read_records_json(spark, str(logs))) == ["1", "2", "3"]


def test_free_form_members_keep_their_text(spark, logs):
    params = read_records_json(spark, str(logs)).filter("eventID = '3'").first()["requestParameters"]
    assert json.loads(params) == {"functionName": "fé", "n": [1, 2]}


def test_broken_documents_are_set_aside(spark, logs):
    good, bad = split_corrupt(read_documents(spark, str(logs)))
    assert {os.path.basename(r.source_file) for r in bad.collect()} == {"broken.json", "scalar.json"}
    assert good.filter(F.col("Records").isNotNull()).count() == 3


def test_one_wrong_member_does_not_lose_its_document(spark, tmp_path, event):
    root = tmp_path / "partly"
    put(root / "scalar.json", json.dumps({"Records": [event(eventID="1"), 5, event(eventID="2")]}))
    put(root / "kind.json", json.dumps({"Records": [event(eventID="3", managementEvent="?"), event(eventID="4")]}))
    put(root / "list.json", json.dumps([event(eventID="5"), "x", event(eventID="6")]))
    put(root / "string.json", json.dumps({"Records": "x"}))
    assert ids(read_records_json(spark, str(root))) == ["1", "2", "3", "4"]
    assert ids(read_json_any(spark, str(root))) == ["1", "2", "3", "4", "5", "6"]
    _, bad = split_corrupt(read_documents(spark, str(root)))
    assert [os.path.basename(r.source_file) for r in bad.collect()] == ["string.json"]


def test_list_object_and_bare_event(spark, tmp_path, event):
    root = tmp_path / "any"
    put(root / "list.json", json.dumps([event(eventID="1"), event(eventID="2")]))
    put(root / "object.json", json.dumps({"Records": [event(eventID="3")]}))
    put(root / "bare.json", json.dumps(event(eventID="4")))
    put(root / "scalar.json", '"text"')
    assert ids(read_json_any(spark, str(root))) == ["1", "2", "3", "4"]


def test_lines_wrapped_or_flat_and_path_filter(spark, tmp_path, event):
    root = tmp_path / "lines"
    lines = [json.dumps(event(eventID="1")), "", "  ", "{broken", json.dumps({"Records": [event(eventID="2"), event(eventID="3")]})]
    put(root / "AWS" / "x.ndjson", "\n".join(lines))
    put(root / "cloudtrail_y.json", json.dumps(event(eventID="4")) + "\n")
    put(root / "linux" / "z.json", json.dumps(event(eventID="5")) + "\n")
    assert ids(read_ndjson(spark, str(root))) == ["1", "2", "3", "4"]


def test_scan_since_is_inclusive_or_strict(spark, tmp_path, event):
    root = tmp_path / "since"
    for name, at in (("old", 1_700_000_000), ("edge", 1_700_000_100), ("new", 1_700_000_200)):
        put(root / f"{name}.json", json.dumps({"Records": [event(eventID=name)]}))
        os.utime(root / f"{name}.json", (at, at))
    mark = datetime.fromtimestamp(1_700_000_100, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert ids(scan_since(spark, str(root), mark)) == ["edge", "new"]
    assert ids(scan_since(spark, str(root), mark, inclusive=False)) == ["new"]
    with pytest.raises(EmptyInputError):
        scan_since(spark, str(root), "2030-01-01T00:00:00Z")


def test_feature_table_round_trip_and_missing_column(spark, tmp_path):
    table = synthetic_trail(spark, 200, 20)
    write_features(table, str(tmp_path / "f"))
    assert read_features(spark, str(tmp_path / "f")).columns == [*FEATURES, LABEL]
    write_features(table.drop("hour"), str(tmp_path / "g"))
    with pytest.raises(AnalysisException):
        read_features(spark, str(tmp_path / "g"))


def test_synthetic_regimes_do_not_depend_on_partitions(spark):
    table = synthetic_trail(spark, 2000, 200)
    stats = table.groupBy(LABEL).agg(F.count("*").alias("n"), F.min("hour").alias("lo"), F.max("hour").alias("hi"),
                                     F.avg("is_error").alias("e"), F.max("event_name_enc").alias("name"))
    routine, attack = stats.orderBy(LABEL).collect()
    assert (routine.n, attack.n) == (2000, 200)
    assert routine.lo == 8 and routine.hi == 17 and 0.01 < routine.e < 0.06 and routine.name < 50
    assert 0.45 < attack.e < 0.75 and attack.name >= 50
    hours = {r.hour for r in table.filter("label = 1").select("hour").distinct().collect()}
    assert hours <= {0, 1, 2, 3, 4, 5, 22, 23}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert synthetic_trail(spark, 2000, 200).exceptAll(table).count() == 0
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_state_and_watermark(spark, tmp_path):
    path = str(tmp_path / "state")
    assert get_state(spark, path, "last_train_ts", "never") == "never"
    put_state(spark, path, "last_train_ts", "a")
    put_state(spark, path, "other", "z")
    put_state(spark, path, "last_train_ts", "b")
    assert get_state(spark, path, "last_train_ts") == "b"
    value = advance_watermark(spark, path, at=datetime(2026, 1, 2, 3, 4, 5))
    assert value == "2026-01-02T03:04:05Z" == get_state(spark, path, "last_train_ts")


def test_versioned_table_switches_after_the_write(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v int")
    assert table.read().count() == 0
    table.write(spark.createDataFrame([("a", 1)], "k string, v int"))
    table.write(table.read().unionByName(spark.createDataFrame([("b", 2)], "k string, v int")))
    assert table.version() == 2 and table.read().count() == 2
    spark.createDataFrame([("x", 9)], "k string, v int").write.parquet(str(tmp_path / "t" / "v=3"))
    assert table.read().count() == 2


def test_newest_runs(spark):
    runs = spark.createDataFrame([("a", "x", 1), ("b", "x", 3), ("c", "x", 2), ("d", "y", 9)],
                                 "run_id string, experiment string, start_time bigint")
    assert [r.run_id for r in read_runs(runs, "x", 2).collect()] == ["b", "c"]


def test_retention(spark, tmp_path):
    rows = [(datetime(2026, 1, d), f"2026-01-{d:02d}") for d in range(1, 11)]
    df = spark.createDataFrame(rows, "ts timestamp, date string")
    assert retained(df, "ts", 7, F.lit(datetime(2026, 1, 10))).count() == 7
    df.write.partitionBy("date").parquet(str(tmp_path / "r"))
    gone = drop_expired_partitions(spark, str(tmp_path / "r"), 7, datetime(2026, 1, 10))
    assert gone == ["date=2026-01-01", "date=2026-01-02"]
    assert read_or_empty(spark, str(tmp_path / "r"), "ts timestamp, date string").count() == 8


def test_node_splits_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "node1"), (1, "node2"), (2, "node2")], "x int, node string")
    write_node_splits(df, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n" / "node=node2")).count() == 2


def test_spread_only_touches_narrow_scans(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    assert spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(scan, again=True).rdd.getNumPartitions() > 1 and spread(scan, again=True).count() == 100
    wide = spark.range(0, 1000, 1, 64)
    assert spread(wide) is wide
