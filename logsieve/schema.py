"""Event envelope, feature contract and the fixed value lists the rules refer to."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import types as T

# The feature contract. The order is part of it.
FEATURES = [
    "is_error", "is_root", "hour", "day_of_week",
    "is_mgmt_event", "is_read_only",
    "user_agent_len", "req_params_len", "resp_elements_len",
    "event_source_enc", "event_name_enc", "region_enc", "identity_type_enc",
    "mfa_auth", "is_console", "access_key_len",
    "src_ip_private", "event_version_major",
]
LABEL = "label"

# Event names that the rule label counts as attacks.
ATTACK_EVENT_NAMES = [
    "CreateLoginProfile", "UpdateLoginProfile", "AttachUserPolicy",
    "AttachRolePolicy", "PutUserPolicy", "PutRolePolicy",
    "CreateAccessKey", "UpdateAccessKey",
    "CreateUser", "DeleteUser",
    "AssumeRole", "AssumeRoleWithWebIdentity",
    "GetSecretValue", "DescribeInstances",
    "RunInstances", "TerminateInstances",
    "GetPasswordData", "GetConsoleOutput",
    "ModifyInstanceAttribute", "AuthorizeSecurityGroupIngress",
    "CreateSecurityGroup", "DeleteSecurityGroup",
    "S3GetObject", "GetObject",
]

# Error codes that the rule label counts as attacks.
ATTACK_ERROR_CODES = [
    "AccessDenied", "AuthFailure", "UnauthorizedOperation",
    "InvalidClientTokenId", "ExpiredTokenException",
    "NoCredentialsError", "InvalidUserID.NotFound",
]

# Verbs that open the name of a change event.
CHANGE_VERBS = [
    "Create", "Update", "Delete", "Put", "Attach", "Detach", "Modify", "Run", "Start", "Stop",
    "Terminate", "Apply", "Enable", "Disable", "Associate", "Disassociate", "Register",
    "Deregister", "Import", "Export", "Authorize", "Revoke", "Tag", "Untag",
    "Set", "Reset", "Restore", "Reboot", "Replace", "Copy", "Move", "Rotate", "Provision",
]

# Change events that the training job indexes.
INDEXED_CHANGE_NAMES = [
    "CreateStack", "UpdateStack", "DeleteStack",
    "PutRule", "DeleteRule", "PutTargets",
    "CreateFunction", "UpdateFunctionCode", "DeleteFunction",
    "ModifyDBInstance", "CreateDBInstance", "DeleteDBInstance",
    "PutBucketPolicy", "CreateBucket", "DeleteBucket",
    "RunInstances", "TerminateInstances",
    "CreateSecurityGroup", "AuthorizeSecurityGroupIngress",
    "CreateRole", "AttachRolePolicy", "PutRolePolicy",
]

# Change events that the ad-hoc lookup keeps.
LOOKUP_CHANGE_NAMES = [
    "CreateStack", "UpdateStack", "DeleteStack",
    "RunInstances", "TerminateInstances", "StopInstances", "StartInstances",
    "CreateSecurityGroup", "DeleteSecurityGroup",
    "AuthorizeSecurityGroupIngress", "RevokeSecurityGroupIngress",
    "CreateLoadBalancer", "DeleteLoadBalancer",
    "CreateDBInstance", "DeleteDBInstance", "ModifyDBInstance",
    "CreateBucket", "DeleteBucket", "PutBucketPolicy", "DeleteBucketPolicy",
    "CreateFunction", "UpdateFunctionCode", "DeleteFunction",
    "CreateCluster", "DeleteCluster",
    "UpdateNodegroupConfig", "CreateNodegroup", "DeleteNodegroup",
    "CreateVpc", "DeleteVpc", "CreateSubnet", "DeleteSubnet",
    "CreateInternetGateway", "DeleteInternetGateway",
]

# Outcomes of triage and stages of a registered model.
DECISIONS = ["genuine_bug", "known_change"]
STAGES = ["Staging", "Production", "Archived"]

CORRUPT = "_corrupt_record"


def feature_hash(columns: list[str] | None = None) -> str:
    """SHA-256 of the JSON list of feature names; equal on both sides of the model boundary."""
    return hashlib.sha256(json.dumps(columns or FEATURES).encode()).hexdigest()


IDENTITY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("arn", T.StringType()),
    T.StructField("userName", T.StringType()),
    T.StructField("accessKeyId", T.StringType()),
    T.StructField("sessionContext", T.StructType([
        T.StructField("attributes", T.StructType([
            T.StructField("mfaAuthenticated", T.StringType()),
        ])),
    ])),
])

# Free-form members stay JSON text: a nested object read into a string keeps its source text, so an unseen
# parameter never widens the schema.
EVENT = T.StructType([
    T.StructField("eventID", T.StringType()),
    T.StructField("eventTime", T.StringType()),
    T.StructField("eventName", T.StringType()),
    T.StructField("eventSource", T.StringType()),
    T.StructField("awsRegion", T.StringType()),
    T.StructField("userAgent", T.StringType()),
    T.StructField("sourceIPAddress", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("eventVersion", T.StringType()),
    T.StructField("errorCode", T.StringType()),
    T.StructField("managementEvent", T.BooleanType()),
    T.StructField("readOnly", T.BooleanType()),
    T.StructField("userIdentity", IDENTITY),
    T.StructField("requestParameters", T.StringType()),
    T.StructField("responseElements", T.StringType()),
])

# One schema for every shape a document may have: wrapped, flat, or broken.
DOCUMENT = T.StructType(
    [T.StructField("Records", T.ArrayType(EVENT))]
    + list(EVENT.fields)
    + [T.StructField(CORRUPT, T.StringType())]
)

CHUNKS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("resource", T.StringType()),
    T.StructField("principal", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("indexed_at", T.TimestampType()),
])

CONTEXT = T.ArrayType(T.StructType([
    T.StructField("raw_text", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("resource", T.StringType()),
    T.StructField("principal", T.StringType()),
]))

DECISION_LOG = T.StructType([
    T.StructField("kafka_offset", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("retrieved_ctx", CONTEXT),
    T.StructField("bedrock_prompt", T.StringType()),
    T.StructField("bedrock_response", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("pagerduty_id", T.StringType()),
    T.StructField("slack_ts", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
