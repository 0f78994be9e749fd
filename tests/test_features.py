import hashlib
import json

import pytest
from pyspark.sql import functions as F

from logsieve.operators.features import (
    CANONICAL, CLOUDTRAIL, OFFLINE, SERVE, TRAIN, change_document, change_line, change_summary, changed_resource, conform,
    features, flatten_events, member_columns, missing_columns, retrieval_query,
)
from logsieve.operators.labels import (
    SchemaDriftError, check_drift, check_feature_schema, check_vector_arity, is_infra_change, rule_label, self_label,
    split_by_rule, valid_decision, valid_stage,
)
from logsieve.schema import (
    ATTACK_ERROR_CODES, ATTACK_EVENT_NAMES, CHANGE_VERBS, DOCUMENT, EVENT, FEATURES, INDEXED_CHANGE_NAMES,
    LOOKUP_CHANGE_NAMES, feature_hash,
)
from logsieve.sources.json_logs import wrapped_events


@pytest.fixture
def read(spark):
    def build(*events):
        text = json.dumps({"Records": list(events)}, ensure_ascii=False)
        docs = spark.createDataFrame([(text, "f")], "t string, source_file string").select(
            "source_file", F.from_json("t", DOCUMENT).alias("d")).select("source_file", "d.*")
        return wrapped_events(docs)
    return build


def md5_code(text):
    return int(hashlib.md5(text.encode()).hexdigest(), 16) % 1000


def one(df):
    return df.first().asDict()


def test_contract():
    assert len(FEATURES) == 18 == len(set(FEATURES))
    assert (len(ATTACK_EVENT_NAMES), len(ATTACK_ERROR_CODES), len(CHANGE_VERBS)) == (24, 7, 33)
    assert (len(INDEXED_CHANGE_NAMES), len(LOOKUP_CHANGE_NAMES)) == (22, 34)
    assert feature_hash() == hashlib.sha256(json.dumps(FEATURES).encode()).hexdigest()


def test_canonical_vector(read, event):
    row = one(features(read(event())))
    params = {"functionName": "fé", "n": [1, 2]}
    assert list(row) == FEATURES
    assert row == {
        "is_error": 0, "is_root": 0, "hour": 10, "day_of_week": 4, "is_mgmt_event": 1, "is_read_only": 0,
        "user_agent_len": 9, "req_params_len": len(json.dumps(params)), "resp_elements_len": 0,
        "event_source_enc": md5_code("ec2.amazonaws.com"), "event_name_enc": md5_code("RunInstances"),
        "region_enc": md5_code("us-east-1"), "identity_type_enc": md5_code("IAMUser"), "mfa_auth": 1, "is_console": 0,
        "access_key_len": 8, "src_ip_private": 0, "event_version_major": 1,
    }


def test_error_code_absent_null_and_empty(read, event):
    rows = features(read(event(), event(errorCode=""), event(errorCode="AccessDenied"))).select("is_error").collect()
    assert [r.is_error for r in rows] == [0, 0, 1]


def test_dialects_differ_where_they_should(read, event):
    bare = read({"eventID": "1", "eventTime": "bad", "userAgent": "x" * 600, "sourceIPAddress": "172.32.0.1"})
    canonical, train, serve = (one(features(bare, d)) for d in (CANONICAL, TRAIN, SERVE))
    offline = one(flatten_events(bare, OFFLINE))
    assert (canonical["user_agent_len"], offline["user_agent_len"]) == (500, 600)
    assert (canonical["src_ip_private"], train["src_ip_private"], serve["src_ip_private"]) == (0, 1, 1)
    assert (canonical["is_mgmt_event"], offline["is_mgmt_event"]) == (0, 1)
    assert (canonical["day_of_week"], offline["day_of_week"], serve["day_of_week"]) == (0, 3, 0)
    assert (canonical["req_params_len"], serve["req_params_len"]) == (0, 2)
    assert offline["identity_type_raw"] == "Unknown" and canonical["identity_type_enc"] == md5_code("")
    loud = read(event(userIdentity={"type": "Root", "sessionContext": {"attributes": {"mfaAuthenticated": "TRUE"}}},
                      userAgent="signin.amazonaws.com", eventType="AwsConsoleSignIn"))
    assert one(features(loud))["mfa_auth"] == 1 and one(features(loud, SERVE))["mfa_auth"] == 0
    assert one(features(loud))["is_console"] == 1 == one(flatten_events(loud, OFFLINE))["is_console"]
    with pytest.raises(ValueError):
        features(loud, OFFLINE)


def test_rows_that_fail_are_dropped(read, event):
    df = read(event(eventID="a"), event(eventID="b", eventVersion="x.1"))
    assert [r.eventID for r in flatten_events(df, keep=("eventID",)).collect()] == ["a"]
    assert flatten_events(df, keep=("eventID",), drop_failed=False).count() == 2


def test_conform_fills_and_casts(spark):
    df = spark.createDataFrame([("5", None, 1), ("x", 2.0, 0)], "hour string, is_error double, label int")
    out = conform(df, label="label")
    assert out.columns == [*FEATURES, "label"]
    assert {f.dataType.simpleString() for f in out.schema.fields[:18]} == {"float"}
    assert out.schema["label"].dataType.simpleString() == "tinyint"
    assert [(r.hour, r.is_error, r.is_root) for r in out.collect()] == [(5.0, 0.0, 0.0), (0.0, 2.0, 0.0)]
    assert len(missing_columns(df)) == 16


def test_labels(read, event):
    df = read(event(eventName="ListBuckets"), event(), event(eventName="X", errorCode="AuthFailure"),
              event(eventName="X", errorCode="NoSuchBucket"), event(eventName="X", userIdentity={"type": "Root"}), {"eventID": "z"})
    m = member_columns(df, CLOUDTRAIL)
    rows = df.select(rule_label(m["error_code"], m["event_name"], m["identity_type"]).alias("l")).collect()
    assert [r.l for r in rows] == [0, 1, 1, 0, 1, 0]
    flags = features(df).select(self_label().alias("l")).collect()
    assert [r.l for r in flags] == [0, 0, 1, 1, 0, 0]


def test_change_filter(read, event):
    cases = [(event(), True), (event(managementEvent=False), False), (event(readOnly=True), False),
             (event(eventName="createStack"), True), (event(eventName="XCreate"), False),
             (event(eventName="DescribeCreate"), False), (event(readOnly=None), False), (event(managementEvent=None), False)]
    df = read(*[e for e, _ in cases])
    got = df.select(is_infra_change(F.col("managementEvent"), F.col("readOnly"), F.col("eventName")).alias("c")).collect()
    assert [r.c for r in got] == [c for _, c in cases]


def test_change_texts(read, event):
    params = {"functionName": "fé", "n": [1, 2]}
    df = read(event(), event(userIdentity=None, requestParameters=None, eventSource=None, awsRegion=None),
              event(userIdentity={"type": "Root", "arn": "", "userName": "u"}, requestParameters={"k": "v" * 900}))
    m = member_columns(df, CLOUDTRAIL)
    rows = df.select(change_line(m, m["event_time"]).alias("line"), change_summary(m, m["event_time"]).alias("summary"),
                     change_document(m, m["event_time"]).alias("doc"),
                     changed_resource(m["request_parameters"]).alias("resource"), retrieval_query(m).alias("query")).collect()
    printed = json.dumps(params)
    assert rows[0].line == f"RunInstances on {printed} by arn:aws:iam::1:user/a at 2025-03-14T10:00:00Z"
    assert rows[0].summary == ("[2025-03-14T10:00:00Z] RunInstances on ec2.amazonaws.com in us-east-1 "
                               f"by arn:aws:iam::1:user/a. Params: {printed}")
    assert rows[0].doc == f"RunInstances at 2025-03-14T10:00:00Z by a via ec2.amazonaws.com in us-east-1: {printed}"
    assert rows[0].resource == "fé" and rows[0].query == "RunInstances ec2.amazonaws.com"
    assert rows[1].line == "RunInstances on {} by unknown at 2025-03-14T10:00:00Z"
    assert rows[1].summary == "[2025-03-14T10:00:00Z] RunInstances on ? in ? by Unknown. Params: {}"
    assert rows[1].resource is None and rows[1].query == "RunInstances"
    assert " by u. Params: " in rows[2].summary
    long = json.dumps({"k": "v" * 900})
    assert rows[2].summary.endswith("Params: " + long[:500]) and rows[2].doc.endswith(": " + long[:300])


def test_schema_gates(spark):
    table = spark.createDataFrame([tuple([1.0] * 18)], ", ".join(f"{f} float" for f in FEATURES))
    assert check_feature_schema(table) is table
    with pytest.raises(SchemaDriftError):
        check_feature_schema(table.drop("hour"))
    with pytest.raises(SchemaDriftError):
        check_feature_schema(table.withColumn("hour", F.lit("x")))
    vectors = spark.createDataFrame([(1, [1.0] * 18), (2, [1.0] * 17), (3, None), (4, [1.0] * 17 + [None])],
                                    "id int, v array<double>")
    good, bad = check_vector_arity(vectors, "v")
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_drift_gate():
    assert check_drift(None) == "unknown" and check_drift("") == "unset" and check_drift(feature_hash()) == "equal"
    with pytest.raises(SchemaDriftError):
        check_drift(feature_hash(FEATURES[:17]))


def test_domains_go_to_quarantine(spark):
    df = spark.createDataFrame([("genuine_bug",), ("known_change",), ("other",), (None,)], "d string")
    good, bad = split_by_rule(df, valid_decision(F.col("d")))
    assert good.count() == 3 and [r.d for r in bad.collect()] == ["other"]
    assert df.filter(valid_stage(F.lit("Production"))).count() == 4


def test_features_do_not_depend_on_partitions(read, event, spark):
    df = read(*[event(eventID=str(i), eventName=f"N{i}", errorCode="E" if i % 3 else "") for i in range(60)])
    base = features(df, keep=("eventID",))
    for n in (1, 4, 16):
        assert features(df.repartition(n), keep=("eventID",)).exceptAll(base).count() == 0


def test_event_schema_has_every_member():
    assert set(EVENT.fieldNames()) <= set(DOCUMENT.fieldNames())
