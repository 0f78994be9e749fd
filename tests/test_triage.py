import json

import pytest
from pyspark.sql import functions as F

from logsieve.operators import triage as tr
from logsieve.operators.retrieval import TextVectoriser
from logsieve.schema import CONTEXT, EVENT


def parse(spark, response):
    return tr.parse_verdict(spark.createDataFrame([(response,)], "response string")).first()


@pytest.mark.parametrize("response, expected", [
    ({"decision": "known_change", "confidence": 0.87, "reasoning": "why", "severity": "P1"}, ("known_change", 0.87, "why", "P1", True)),
    ({"verdict": "known_change", "confidence": "0.9", "reason": "r"}, ("known_change", 0.9, "r", "P3", True)),
    ({}, ("genuine_bug", 0.5, "", "P3", True)),
    ({"decision": "known_change"}, ("known_change", 0.5, "", "P3", True)),
    ({"decision": "known_change", "confidence": 1}, ("known_change", 1.0, "", "P3", True)),
])
def test_verdict_members_and_defaults(spark, response, expected):
    row = parse(spark, json.dumps(response))
    assert (row.decision, row.confidence, row.reasoning, row.severity, row.parse_ok) == expected


@pytest.mark.parametrize("response", ["This is not JSON: { broken", "[1, 2]", '"text"', "5", "null", "", "x" * 900,
                                      '{"decision": "known_change", "confidence": "high"}',
                                      '{"decision": "known_change", "confidence": null}'])
def test_safe_default(spark, response):
    row = parse(spark, response)
    assert (row.decision, row.confidence, row.severity, row.parse_ok) == ("genuine_bug", 0.5, "P3", False)
    assert row.reasoning == response[:500]


def test_missing_response(spark):
    row = parse(spark, None)
    assert (row.decision, row.reasoning, row.parse_ok) == ("genuine_bug", "", False)


def test_unprocessed(spark):
    events = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("",)], "event_id string")
    log = spark.createDataFrame([("a",), ("",), (None,)], "event_id string")
    for small in (None, 100, 0):
        got = sorted(str(r.event_id) for r in tr.unprocessed(events, log, small_batch=small).collect())
        assert got == ["", "", "None", "b"]


def test_context_lines(spark):
    df = spark.createDataFrame([([("raw", "E", "t", None, None), ("raw2", "F", "t2", "res", "p")],), ([],), (None,)],
                               f"ctx {CONTEXT.simpleString()}")
    rows = [r.b for r in df.select(tr.context_block(F.col("ctx")).alias("b")).collect()]
    assert rows == ["- [t] E on ? by ?: raw\n- [t2] F on res by p: raw2", tr.NO_CONTEXT, tr.NO_CONTEXT]


@pytest.fixture
def decided(spark, event):
    events = [event(eventID="1", errorCode="AccessDenied"), event(eventID="2", userIdentity=None, awsRegion=None)]
    rows = spark.read.schema(EVENT).json(spark.sparkContext.parallelize([json.dumps(e) for e in events]))
    bug = F.col("eventID") == "1"
    return rows.select("*", F.when(bug, -0.25).alias("score"), F.when(bug, "genuine_bug").otherwise("known_change").alias("decision"),
                       F.lit(0.9).alias("confidence"), F.when(bug, "because").alias("reasoning"),
                       F.when(bug, "P1").otherwise("P7").alias("severity"), F.lit("p").alias("prompt"), F.lit("r").alias("response"),
                       F.array().cast(CONTEXT).alias("retrieved_ctx"), F.lit(7).alias("kafka_offset"))


def test_pager_only_for_genuine(decided):
    rows = tr.pager_payload(decided).collect()
    assert len(rows) == 1
    body = json.loads(rows[0].payload)
    assert body["dedup_key"] == "1" and body["event_action"] == "trigger"
    assert body["payload"] == {
        "summary": "Anomaly: RunInstances by arn:aws:iam::1:user/a", "severity": "critical", "source": "logsieve",
        "timestamp": "2025-03-14T10:00:00Z",
        "custom_details": {"score": -0.25, "reasoning": "because", "region": "us-east-1", "error": "AccessDenied"}}


def test_chat_for_every_decision(decided):
    rows = {r.event_id: r for r in tr.chat_payload(decided).collect()}
    assert rows["1"].color == "#FF0000" and rows["1"].header == ":rotating_light: Genuine Anomaly: RunInstances"
    assert rows["2"].color == "#36a64f" and rows["2"].header == ":white_check_mark: Known Change: RunInstances"
    fields = [f["text"] for f in json.loads(rows["1"].payload)["attachments"][0]["blocks"][1]["fields"]]
    assert fields == ["*Score:*\n-0.2500", "*Time:*\n2025-03-14T10:00:00Z", "*Principal:*\narn:aws:iam::1:user/a", "*Region:*\nus-east-1"]
    blocks = json.loads(rows["2"].payload)["attachments"][0]["blocks"]
    assert [f["text"] for f in blocks[1]["fields"]] == ["*Score:*\n?", "*Time:*\n2025-03-14T10:00:00Z", "*Principal:*\n?", "*Region:*\n?"]
    assert blocks[2]["text"]["text"] == "*Reasoning:*\nn/a"


def test_severity_of_unknown_level(spark):
    rows = spark.createDataFrame([("P1",), ("P2",), ("P3",), ("x",), (None,)], "s string")
    assert [r.p for r in rows.select(tr.pager_severity(F.col("s")).alias("p")).collect()] == ["critical", "error"] + ["warning"] * 3


def test_log_rows(decided):
    rows = {r.event_id: r for r in tr.decision_rows(decided).collect()}
    assert rows["1"].pagerduty_id == "1" and rows["2"].pagerduty_id is None and rows["1"].slack_ts is None
    assert rows["1"].anomaly_score == -0.25 and rows["1"].kafka_offset == 7 and str(rows["1"].event_time) == "2025-03-14 10:00:00"
    view = tr.audit_view(tr.decision_rows(decided), decided.select(F.col("eventID").alias("event_id"), "score"))
    assert {(r.event_id, r.decision) for r in view.collect()} == {("1", "genuine_bug"), ("2", "known_change")}


def test_messages(decided):
    scored = {r.key: json.loads(r.value) for r in tr.scored_message(decided).collect()}
    assert set(scored["1"]) == {"eventID", "eventTime", "eventName", "score"}
    flagged = tr.flagged_events(decided.fillna({"score": -0.1}), -0.1)
    assert flagged.columns == tr.FLAGGED_MEMBERS and [r.eventID for r in flagged.collect()] == ["1"]
    message = json.loads(tr.flagged_message(decided, -0.1).first().value)
    assert message["raw"]["eventID"] == "1" and message["raw"]["userIdentity"]["type"] == "IAMUser"


def test_retrieval_is_bounded_by_time_and_k(spark, event):
    chunks = spark.createDataFrame(
        [(f"c{i}", f"2026-01-{i + 1:02d} 00:00:00", "RunInstances", None, "p", f"RunInstances on ec2.amazonaws.com number {i}")
         for i in range(9)] + [("x", "2026-01-09 00:00:00", "PutRule", None, "p", "something else entirely")],
        "event_id string, event_time string, event_name string, resource string, principal string, raw_text string",
    ).withColumn("event_time", F.col("event_time").cast("timestamp"))
    vectoriser = TextVectoriser(64).fit(chunks, "raw_text")
    index = vectoriser.transform(chunks, "raw_text")
    events = spark.read.schema(EVENT).json(spark.sparkContext.parallelize(
        [json.dumps(event(eventID="1")), json.dumps(event(eventID="2")),
         json.dumps({"eventID": "3"})]))
    out = {r.eventID: r.retrieved_ctx for r in tr.retrieve_context(
        events, index, F.lit("2026-01-03 00:00:00").cast("timestamp"), vectoriser, 5).collect()}
    assert [len(out[i]) for i in "123"] == [5, 5, 0]
    assert all(c.event_time > "2026-01-03" and c.event_name == "RunInstances" for c in out["1"])
    assert out["1"] == out["2"]
    empty = tr.retrieve_context(events, index.limit(0), F.lit("2026-01-03").cast("timestamp"), vectoriser).collect()
    assert all(r.retrieved_ctx == [] for r in empty)
