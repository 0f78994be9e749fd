"""Streams: run, stop, go on from the checkpoint; a batch that runs again writes the same rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsieve.operators.features import features
from logsieve.operators.forest import fit_forest
from logsieve.operators.retrieval import TextVectoriser
from logsieve.schema import DECISION_LOG, EVENT, feature_hash
from logsieve.sources.json_logs import read_records_json, stream_topic
from logsieve.streaming import scoring as sc
from logsieve.streaming import triage as tg
from logsieve.streaming.batches import read_batches, write_batch
from logsieve.streaming.monitoring import start_alerts, start_decision_rate, start_flagged_counts, unique_within

START = datetime(2026, 1, 1)


def log_file(root, name, events):
    root.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(json.dumps({"Records": events}))


@pytest.fixture
def model(spark, tmp_path, event):
    log_file(tmp_path / "train", "t.json", [
        event(eventID=f"t{i}", eventTime=f"2026-01-{1 + i % 28:02d}T{8 + i % 9:02d}:00:00Z", userAgent="x" * (20 + i % 30))
        for i in range(300)])
    table = features(read_records_json(spark, str(tmp_path / "train")), keep=("eventID",))
    return fit_forest(table, "eventID", n_estimators=10)


def odd(event, i):
    return event(eventID=i, eventTime="2026-01-04T03:00:00Z", errorCode="AccessDenied", userAgent="", eventName="CreateUser",
                 userIdentity={"type": "Root"}, sourceIPAddress="10.0.0.1")


def test_scoring_goes_on_from_its_checkpoint(spark, tmp_path, event, model):
    logs, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "mark")
    log_file(logs, "1.json", [event(eventID="a"), odd(event, "b")])
    log_file(logs, "2.json", [])
    (logs / "3.json").write_text('{"Records": [')

    def run():
        sc.start_scoring(spark, str(logs), out, mark, model, feature_hash(), threshold=0.0).awaitTermination()
        return sorted(r.key for r in read_batches(spark, f"{out}/events-raw", "key string, value string").collect())

    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    log_file(logs, "4.json", [event(eventID="c")])
    assert run() == ["a", "b", "c"]
    flagged = spark.read.parquet(f"{out}/anomalies-flagged")
    assert "b" in {r.eventID for r in flagged.collect()} and flagged.first().raw.eventID is not None
    messages = read_batches(spark, f"{out}/events-raw", "key string, value string").collect()
    assert set(json.loads(messages[0].value)) == {"eventID", "eventTime", "eventName", "score"}
    failures = spark.read.parquet(f"{out}/failures").collect()
    assert len(failures) == 1 and failures[0].message_id.endswith("3.json")


def test_files_per_batch_are_limited(spark, tmp_path, event, model):
    for i in range(5):
        log_file(tmp_path / "logs", f"{i}.json", [event(eventID=str(i))])
    sc.start_scoring(spark, str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "mark"), model, max_files=2).awaitTermination()
    batches = spark.read.parquet(str(tmp_path / "out" / "events-raw")).select("batch_id").distinct().count()
    assert batches == 3


def test_drift_stops_the_stream(spark, tmp_path, model):
    with pytest.raises(ValueError):
        sc.start_scoring(spark, str(tmp_path), str(tmp_path), str(tmp_path), model, feature_hash(["x"]))


def test_dead_letters_after_three_attempts(spark):
    schema = "message_id string, raw string"
    attempts = spark.createDataFrame([], sc.ATTEMPTS)
    for _ in range(3):
        failures = spark.createDataFrame([("m", "{broken")], schema)
        attempts = attempts.unionByName(sc.record_attempts(failures, attempts))
    attempts = attempts.unionByName(sc.record_attempts(
        spark.createDataFrame([("ok", '{"Records": [{"eventID": "1"}]}'), ("bad", "{")], schema), attempts)).persist()
    status = {r.message_id: (r.attempts, r.dead) for r in sc.attempt_status(attempts).collect()}
    assert status == {"m": (3, True), "ok": (1, False), "bad": (1, False)}
    now = F.current_timestamp()
    assert [r.message_id for r in sc.dead_letters(attempts, now).collect()] == ["m"]
    assert sc.dead_letters(attempts, now + F.make_dt_interval(F.lit(15))).count() == 0
    good, bad = sc.retry_messages(attempts)
    assert [r.source_file for r in good.collect()] == ["ok"] and [r.message_id for r in bad.collect()] == ["bad"]


def test_messages_of_a_key_stay_in_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("at"))
    out = sc.partitioned(df, 6, "k", "at").select("k", "at", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    rows = out.collect()
    assert len({r.p for r in rows}) <= 6 and out.select("k", "p").distinct().count() == 7
    for k in range(7):
        mine = [r.at for r in sorted((r for r in rows if r.k == k), key=lambda r: r.i)]
        assert mine == sorted(mine)


@pytest.fixture
def flagged_dir(tmp_path, event):
    def put(name, ids, first_offset):
        rows = [{**event(eventID=i), "score": -0.3, "kafka_offset": first_offset + n} for n, i in enumerate(ids)]
        (tmp_path / "flagged").mkdir(exist_ok=True)
        for r in rows:
            r["requestParameters"] = json.dumps(r["requestParameters"])
        (tmp_path / "flagged" / name).write_text("\n".join(json.dumps(r) for r in rows))
    return put


def test_triage_logs_every_event_once(spark, tmp_path, flagged_dir):
    schema = type(EVENT)(list(EVENT.fields)).add("score", "double").add("kafka_offset", "long")
    chunks = spark.createDataFrame(
        [(f"c{i}", START + timedelta(days=i), "RunInstances", None, "p", f"RunInstances ec2 {i}") for i in range(9)],
        "event_id string, event_time timestamp, event_name string, resource string, principal string, raw_text string")
    vectoriser = TextVectoriser(64).fit(chunks, "raw_text")
    index = vectoriser.transform(chunks, "raw_text").persist()
    answers = spark.createDataFrame([("a", '{"decision": "known_change", "confidence": 0.8}'), ("b", "not json"),
                                     ("d", '{"decision": "no such decision"}')], "event_id string, response string")
    out = str(tmp_path / "out")

    def run():
        stream = stream_topic(spark, schema, path=str(tmp_path / "flagged"), maxFilesPerTrigger=1)
        tg.start_triage(spark, stream, out, str(tmp_path / "mark"), lambda: index, "2026-01-02T00:00:00Z", vectoriser,
                        tg.responses_from(answers)).awaitTermination()
        return {r.event_id: r for r in read_batches(spark, f"{out}/agent_log", DECISION_LOG).collect()}

    flagged_dir("1.json", ["a", "b", "a", ""], 0)
    log = run()
    assert set(log) == {"a", "b", ""}
    assert (log["a"].decision, log["a"].confidence, log["a"].kafka_offset, log["a"].pagerduty_id) == ("known_change", 0.8, 0, None)
    assert (log["b"].decision, log["b"].confidence, log["b"].pagerduty_id) == ("genuine_bug", 0.5, "b")
    assert len(log["a"].retrieved_ctx) == 5 and "RunInstances" in log["a"].bedrock_prompt and log["a"].anomaly_score == -0.3
    flagged_dir("2.json", ["b", "c", "d", ""], 10)
    log = run()
    rows = read_batches(spark, f"{out}/agent_log", DECISION_LOG)
    assert set(log) == {"a", "b", "c", ""} and rows.count() == 4 and log["b"].kafka_offset == 1
    assert [r.event_id for r in read_batches(spark, f"{out}/quarantine", DECISION_LOG).collect()] == ["d"]
    chat = spark.read.parquet(f"{out}/chat").groupBy("event_id").count().collect()
    assert {r.event_id: r["count"] for r in chat} == {"a": 1, "b": 1, "c": 1, "d": 1, "": 2}
    # A repeated batch must not meet its own rows, and overwrites them.
    before = read_batches(spark, f"{out}/agent_log", DECISION_LOG, before=1)
    events = spark.read.schema(schema).json(str(tmp_path / "flagged" / "2.json"))
    again = tg.classify(events, before, index, "2026-01-02T00:00:00Z", vectoriser, tg.responses_from(answers))
    assert sorted(r.eventID for r in again.collect()) == ["", "c", "d"]


def test_batches_overwrite_themselves(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.createDataFrame([("a",)], "k string")
    assert read_batches(spark, table, "k string").count() == 0
    for batch in (0, 1, 1, 1):
        write_batch(df, table, batch)
    assert read_batches(spark, table, "k string").count() == 2
    assert read_batches(spark, table, "k string", before=1).count() == 1


def stream_of(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(START + timedelta(minutes=m), "genuine_bug" if m % 2 else "known_change") for m in range(0, 130)]
    stream = stream_of(spark, str(tmp_path / "in"), rows, "ts timestamp, decision string", "a")
    start_flagged_counts(stream, "ts", str(tmp_path / "n"), str(tmp_path / "m1")).awaitTermination()
    counts = spark.read.parquet(str(tmp_path / "n")).collect()
    assert len(counts) == 23 and all(r.n == 5 for r in counts)      # 119 minutes are closed
    start_decision_rate(stream, "ts", str(tmp_path / "r"), str(tmp_path / "m2")).awaitTermination()
    assert [r.rate for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [0.5]


def test_alerts_keep_their_pause_across_batches(spark, tmp_path):
    schema = "name string, ts timestamp"
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run(hours, name):
        rows = [("a", START + timedelta(hours=h)) for h in hours]
        stream = stream_of(spark, str(tmp_path / "in"), rows, schema, name)
        start_alerts(spark, stream, ["name"], "ts", out, mark).awaitTermination()
        sent = read_batches(spark, f"{out}/sent", schema).collect()
        return sorted((r.ts - START).total_seconds() / 3600 for r in sent)

    assert run([0, 1, 3], "x") == [0]
    assert run([3.5, 4, 6, 8.5], "y") == [0, 4, 8.5]


def test_unique_within_the_watermark(spark, tmp_path):
    rows = [("a", START), ("a", START + timedelta(minutes=1)), ("b", START)]
    stream = stream_of(spark, str(tmp_path / "in"), rows, "k string, ts timestamp", "x")
    query = unique_within(stream, "k", "ts").writeStream.format("memory").queryName("uniq").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("uniq").count() == 2
