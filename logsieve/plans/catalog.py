"""Driver queries over the given tables, each next to the SQL that must give the same rows.

The `events` table plays the audit log through the `trail` view. A query without SQL is checked by row count here and
against an independent computation in the tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.scalars import (
    epoch_ms, is_private_ip, iso_timestamp, json_len, md5_mod, printed_json,
)
from logsieve.operators import forest as iforest
from logsieve.operators import metrics as met
from logsieve.operators import monitor as mon
from logsieve.operators import quality, quantiles, split, triage, upsert
from logsieve.operators.encode import dense_index, encode
from logsieve.operators.features import (
    CANONICAL, CATEGORICAL, FLAT, OFFLINE, SERVE, change_document, change_line, change_summary, changed_resource,
    features, flatten_events, member_columns, retrieval_query,
)
from logsieve.operators.labels import (
    flag_below, is_infra_change, is_named_change, rule_label, split_by_rule, valid_decision,
)
from logsieve.operators.vocabulary import Vocabulary
from logsieve.operators.retrieval import (
    TextVectoriser, assign_lists, cosine_distance, dot, exact_index, nearest, nearest_exact, nearest_in_lists, split_by_dimension,
    with_payload,
)
from logsieve.plans.changes import lookup_changes
from logsieve.plans.federated import federated_rounds
from logsieve.plans.journal import Journal
from logsieve.plans.training import MONTHLY_SEARCH, current_stages, draw_trials, search_trials, serving_version
from logsieve.schema import INDEXED_CHANGE_NAMES, LABEL, LOOKUP_CHANGE_NAMES
from logsieve.session import path_exists, shared_dir, store
from logsieve.sources.bucketed import BucketedTable
from logsieve.sources.file_ledger import FileLedger
from logsieve.sources.keyed_log import KeyedLog
from logsieve.sources.json_logs import all_events, read_documents
from logsieve.sources.tables import read_runs, retained, spread
from logsieve.streaming.batches import read_batches, start, write_batch
from logsieve.streaming.scoring import attempt_status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; `heavy` spreads a scan of few files before work that is bound by the CPU."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    scan = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(scan) if heavy else scan


# The audit log -------------------------------------------------------------------------------------------------


def trail(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    return trail_of(table(spark, sf, "events", heavy))


def trail_of(events: DataFrame) -> DataFrame:
    """The `events` table read as an audit log."""
    kind, user = F.col("event_type"), F.col("user_id")

    def by_kind(default: str, **names: str):
        out = None
        for k, v in names.items():
            out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
        return out.otherwise(default)

    def by_rest(n: int, *names: str):
        return F.element_at(F.array(*[F.lit(v) for v in names]), (user % n + 1).cast("int"))

    return events.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").alias("event_time"),
        by_kind("PutBucketPolicy", signup="CreateUser", purchase="RunInstances", view="DescribeVolumes",
                click="ListBuckets").alias("event_name"),
        by_kind("s3.amazonaws.com", signup="iam.amazonaws.com", purchase="ec2.amazonaws.com",
                view="ec2.amazonaws.com").alias("event_source"),
        by_rest(4, "us-east-1", "us-west-2", "eu-west-1", "ap-south-1").alias("region"),
        F.when(kind != "error", F.lit(None)).when(user % 2 == 0, "AccessDenied").otherwise("NoSuchBucket").alias("error_code"),
        F.when(user % 50 == 0, "Root").when(user % 3 == 0, "AssumedRole").otherwise("IAMUser").alias("identity_type"),
        F.concat(F.lit("arn:aws:iam::1:user/u"), user.cast("string")).alias("principal"),
        (kind != "click").alias("management_event"),
        kind.isin("view", "click").alias("read_only"),
        by_rest(5, "10.0.0.7", "172.32.0.1", "192.168.1.9", "8.8.8.8", "ec2.amazonaws.com").alias("source_ip"),
        F.when(kind == "signup", "signin.amazonaws.com").otherwise(F.concat(F.lit("cli/"), kind)).alias("user_agent"),
        F.lit("1.08").alias("event_version"),
        F.col("props").alias("request_parameters"),
        F.col("value").alias("metric_value"),
    )


TRAIL = """trail AS (
  SELECT CONCAT('e', CAST(event_id AS STRING)) AS event_id, ts AS event_time,
         CASE event_type WHEN 'signup' THEN 'CreateUser' WHEN 'purchase' THEN 'RunInstances'
              WHEN 'view' THEN 'DescribeVolumes' WHEN 'click' THEN 'ListBuckets' ELSE 'PutBucketPolicy' END AS event_name,
         CASE event_type WHEN 'signup' THEN 'iam.amazonaws.com' WHEN 'purchase' THEN 'ec2.amazonaws.com'
              WHEN 'view' THEN 'ec2.amazonaws.com' ELSE 's3.amazonaws.com' END AS event_source,
         CASE user_id % 4 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'eu-west-1'
              ELSE 'ap-south-1' END AS region,
         CASE WHEN event_type <> 'error' THEN NULL WHEN user_id % 2 = 0 THEN 'AccessDenied'
              ELSE 'NoSuchBucket' END AS error_code,
         CASE WHEN user_id % 50 = 0 THEN 'Root' WHEN user_id % 3 = 0 THEN 'AssumedRole' ELSE 'IAMUser' END AS identity_type,
         CONCAT('arn:aws:iam::1:user/u', CAST(user_id AS STRING)) AS principal,
         event_type <> 'click' AS management_event, event_type IN ('view', 'click') AS read_only,
         CASE user_id % 5 WHEN 0 THEN '10.0.0.7' WHEN 1 THEN '172.32.0.1' WHEN 2 THEN '192.168.1.9'
              WHEN 3 THEN '8.8.8.8' ELSE 'ec2.amazonaws.com' END AS source_ip,
         CASE WHEN event_type = 'signup' THEN 'signin.amazonaws.com' ELSE CONCAT('cli/', event_type) END AS user_agent,
         '1.08' AS event_version, props AS request_parameters, value AS metric_value
  FROM events)"""

_RULE = """(COALESCE(error_code, '') IN ('AccessDenied', 'AuthFailure', 'UnauthorizedOperation', 'InvalidClientTokenId',
   'ExpiredTokenException', 'NoCredentialsError', 'InvalidUserID.NotFound')
   OR event_name IN ('CreateUser', 'RunInstances') OR identity_type = 'Root')"""


def _md5_sql(c: str) -> str:
    words = [f"('0x' || substr(md5({c}), {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
    out = f"({words[0]} % 1000)"
    for w in words[1:]:
        out = f"(({out} * 296 + {w}) % 1000)"
    return out


def _unit_sql(c: str) -> str:
    return f"('0x' || substr(md5({c}), 1, 13))::BIGINT::DOUBLE"


def _json_len_sql(j: str, escapes: bool = True) -> str:
    skeleton = f"regexp_replace({j}, '\"(\\\\.|[^\"\\\\])*\"', 'S', 'g')"
    out = f"(length({j}) + length({skeleton}) - length(regexp_replace({skeleton}, '[,:]', '', 'g'))"
    if escapes:
        out += f" + 5 * length(regexp_replace({j}, '[\\x00-\\x7F]', '', 'g'))"
    return out + ")"


def labelled(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    t = trail(spark, sf, heavy)
    return t.withColumn(LABEL, rule_label(t["error_code"], t["event_name"], t["identity_type"]))


def labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    return features(labelled(spark, sf, heavy=True), CANONICAL, FLAT, keep=("event_id", "event_source", LABEL))


# Labels and rates ----------------------------------------------------------------------------------------------


@query(f"""WITH {TRAIL}
SELECT event_source, COUNT(*) AS n, SUM(CASE WHEN {_RULE} THEN 1 ELSE 0 END)::BIGINT AS n_anomaly,
       ROUND(AVG(CASE WHEN {_RULE} THEN 1.0 ELSE 0.0 END), 9) AS rate
FROM trail GROUP BY ROLLUP (event_source)""")
def anomaly_rate_by_source(spark, sf):
    rated = quality.anomaly_rate(labelled(spark, sf), "event_source")
    return rated.withColumn("rate", F.round("rate", 9))


@query(f"""WITH {TRAIL}
SELECT event_id, CASE WHEN {_RULE} THEN 1 ELSE 0 END::INTEGER AS label FROM trail""")
def label_rule(spark, sf):
    return labelled(spark, sf).select("event_id", F.col(LABEL).cast("int").alias("label"))


@query(f"""WITH {TRAIL}
SELECT event_id, event_name FROM trail
WHERE management_event AND NOT read_only
  AND regexp_matches(event_name, '(?i)^(Create|Update|Delete|Put|Attach|Detach|Modify|Run|Start|Stop|Terminate)')""")
def infra_change_filter(spark, sf):
    t = trail(spark, sf)
    return t.filter(is_infra_change(t["management_event"], t["read_only"], t["event_name"])).select("event_id", "event_name")


@query(f"""WITH {TRAIL}
SELECT event_id, event_name IN ('RunInstances', 'PutBucketPolicy') AS indexed,
       event_name IN ('RunInstances', 'PutBucketPolicy') AS looked_up FROM trail""")
def named_changes(spark, sf):
    return trail(spark, sf).select(
        "event_id", is_named_change(F.col("event_name"), INDEXED_CHANGE_NAMES).alias("indexed"),
        is_named_change(F.col("event_name"), LOOKUP_CHANGE_NAMES).alias("looked_up"))


@query("""SELECT event_type AS source, COUNT(*) AS n,
       ROUND(AVG(CASE WHEN event_type = 'error' OR event_type = 'signup' THEN 1.0 ELSE 0.0 END), 9) AS rate
FROM events WHERE event_type IN ('error', 'signup', 'view', 'click', 'purchase') GROUP BY event_type""")
def union_of_sources(spark, sf):
    events = table(spark, sf, "events")
    kinds = ["error", "signup", "view", "click", "purchase", "absent"]
    parts = {k: events.filter(F.col("event_type") == k).withColumn(LABEL, F.lit(int(k in ("error", "signup"))))
             for k in kinds}
    rated = quality.anomaly_rate(quality.union_sources(parts), "source").filter("source is not null")
    return rated.select("source", "n", F.round("rate", 9).alias("rate"))


# Features ------------------------------------------------------------------------------------------------------

_IPV4_SQL = """CASE WHEN regexp_matches(ip, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$')
  THEN (split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536
        + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT) END"""
_PRIVATE_SQL = """COALESCE((n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647
  OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727
  OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3323068416 AND 3323199487
  OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n BETWEEN 4026531840 AND 4294967295)
  AND n NOT IN (3221225481, 3221225482), FALSE)::INTEGER"""


def _features_sql(private: str, weekday: str, empty_response: int, enc: str) -> str:
    return f"""
SELECT event_id,
  (COALESCE(error_code, '') <> '')::INTEGER::FLOAT AS is_error, (identity_type = 'Root')::INTEGER::FLOAT AS is_root,
  hour(event_time)::FLOAT AS hour, {weekday}::FLOAT AS day_of_week,
  management_event::INTEGER::FLOAT AS is_mgmt_event, read_only::INTEGER::FLOAT AS is_read_only,
  LEAST(length(user_agent), 500)::FLOAT AS user_agent_len,
  LEAST({_json_len_sql('json(request_parameters)::VARCHAR')}, 5000)::FLOAT AS req_params_len,
  {empty_response}::FLOAT AS resp_elements_len, {enc},
  0::FLOAT AS mfa_auth, contains(user_agent, 'signin.amazonaws.com')::INTEGER::FLOAT AS is_console,
  0::FLOAT AS access_key_len, ({private})::FLOAT AS src_ip_private, 1::FLOAT AS event_version_major
FROM trail"""


_HASHED = ", ".join(f"{_md5_sql(c)}::FLOAT AS {c}_enc" for c in CATEGORICAL)
_RANGE_IP = "CASE WHEN source_ip IN ('10.0.0.7', '192.168.1.9') THEN 1 ELSE 0 END"
_PREFIX_IP = "CASE WHEN source_ip IN ('10.0.0.7', '192.168.1.9', '172.32.0.1') THEN 1 ELSE 0 END"


@query(f"WITH {TRAIL} {_features_sql(_RANGE_IP, '(isodow(event_time) - 1)', 0, _HASHED)}")
def feature_table(spark, sf):
    return features(trail(spark, sf, heavy=True), CANONICAL, FLAT, keep=("event_id",))


@query(f"WITH {TRAIL} {_features_sql(_PREFIX_IP, '0', 2, _HASHED)}")
def feature_table_serving(spark, sf):
    return features(trail(spark, sf, heavy=True), SERVE, FLAT, keep=("event_id",))


@query(f"WITH {TRAIL} {_features_sql(_RANGE_IP, '(isodow(event_time) - 1)', 0, _HASHED)}")
def ingested_features(spark, sf):
    """The trail written as log lines, flat ones and wrapped ones, and read back: the features must be the same."""
    t = trail(spark, sf, heavy=True)
    event = F.struct(
        F.col("event_id").alias("eventID"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.col("event_name").alias("eventName"), F.col("event_source").alias("eventSource"),
        F.col("region").alias("awsRegion"), F.col("error_code").alias("errorCode"),
        F.struct(F.col("identity_type").alias("type"), F.col("principal").alias("arn")).alias("userIdentity"),
        F.col("management_event").alias("managementEvent"), F.col("read_only").alias("readOnly"),
        F.col("source_ip").alias("sourceIPAddress"), F.col("user_agent").alias("userAgent"),
        F.col("event_version").alias("eventVersion"), F.try_parse_json("request_parameters").alias("requestParameters"))
    wrapped = F.concat(F.lit('{"Records":['), F.to_json(event), F.lit("]}"))
    line = F.when(F.col("event_name") == "CreateUser", wrapped).otherwise(F.to_json(event))
    out = f"{_work(spark)}/cloudtrail.json"
    t.select(line.alias("value")).write.option("compression", "gzip").text(out)
    # The writer names its files .txt.gz; the reader takes lines of any name below the path.
    lines = read_documents(spark, out, multiline=False, glob="*")
    return features(all_events(lines), CANONICAL, keep=("eventID",)).withColumnRenamed("eventID", "event_id")


_RANKED = ", ".join(f"(DENSE_RANK() OVER (ORDER BY {c}) - 1)::BIGINT AS {c}_enc" for c in CATEGORICAL)


@query(f"""WITH {TRAIL}
SELECT event_id, length(user_agent) AS user_agent_len,
  {_json_len_sql('json(request_parameters)::VARCHAR', False)} AS req_params_len, 0 AS is_console, {_RANKED} FROM trail""")
def feature_table_offline(spark, sf):
    flat = flatten_events(trail(spark, sf, heavy=True), OFFLINE, FLAT, keep=("event_id",))
    coded = encode(flat, {f"{c}_raw": f"{c}_enc" for c in CATEGORICAL})
    counts = [F.col(c).cast("bigint").alias(c) for c in ("user_agent_len", "req_params_len")]
    return coded.select("event_id", *counts, "is_console", *[f"{c}_enc" for c in CATEGORICAL])


@query(f"""WITH docs AS (
  SELECT conv_id, turn, '{{"role":"' || role || '","turn":' || turn || ',"text":"'
         || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"}}' AS j FROM conversations)
SELECT conv_id, turn, {_json_len_sql('j')}::BIGINT AS n FROM docs""")
def json_len_feature(spark, sf):
    j = F.to_json(F.struct("role", "turn", "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", json_len(j).cast("bigint").alias("n"))


_AS_JSON = """'{"id":' || doc_id || ',"said":"' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"}'"""
_QUOTED = """replace(text, ' ', CASE WHEN doc_id % 3 = 0 THEN '" ' ELSE ' \\' END)"""


@query(f"""WITH d AS (SELECT doc_id, {_QUOTED} AS text FROM documents), j AS (SELECT doc_id, {_AS_JSON} AS j, text FROM d)
SELECT doc_id, ({_json_len_sql('j')})::BIGINT AS n,
  length(j) + 3 + 5 * length(regexp_replace(j, '[\\x00-\\x7F]', '', 'g')) AS printed_chars,
  substr(j, 7 + length(doc_id::VARCHAR), 8) AS begins FROM j""")
def long_parameters(spark, sf):
    """Whole texts, with a quote or a backslash at every blank, as parameters: counted, and printed."""
    docs = table(spark, sf, "documents", heavy=True)
    mark = F.when(F.col("doc_id") % 3 == 0, '" ').otherwise(" \\")
    j = F.to_json(F.struct(F.col("doc_id").alias("id"), F.replace("text", F.lit(" "), mark).alias("said")))
    rows = docs.select("doc_id", j.alias("j"), printed_json(j).alias("p"))
    return rows.select("doc_id", json_len("j").cast("bigint").alias("n"), F.length("p").cast("bigint").alias("printed_chars"),
                       F.substring(F.replace("p", F.lit(", "), F.lit(",")), 8 + F.length(F.col("doc_id").cast("string")), 8).alias("begins"))


@query(f"""WITH {TRAIL} SELECT event_id, hour(event_time)::INTEGER AS hour,
  CASE event_id[-1] WHEN '0' THEN 0 WHEN '1' THEN 2 WHEN '2' THEN 2 WHEN '3' THEN 0 WHEN '4' THEN 8 ELSE length(json(request_parameters)::VARCHAR) + 1
    + length(json(request_parameters)::VARCHAR) - length(replace(json(request_parameters)::VARCHAR, ',', '')) END AS offline_len FROM trail""")
def odd_documents(spark, sf):
    """Times with fractions in the serving dialect; absent and empty documents in the offline one."""
    last = F.right("event_id", F.lit(1))
    made = {"0": None, "1": "{}", "2": " []", "3": "null", "4": '{"a":1}'}
    params = F.col("request_parameters")
    for digit, document in made.items():
        params = F.when(last == digit, F.lit(document).cast("string")).otherwise(params)
    t = trail(spark, sf).withColumn("request_parameters", params)
    t = t.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    served = flatten_events(t, SERVE, FLAT, keep=("event_id",)).select("event_id", "hour")
    offline = flatten_events(t, OFFLINE, FLAT, keep=("event_id",)).select("event_id", F.col("req_params_len").cast("bigint").alias("offline_len"))
    return served.join(offline, "event_id")


@query(f"""SELECT c_custkey, {_md5_sql('c_name')}::INTEGER AS name_code, {_md5_sql('c_mktsegment')}::INTEGER AS segment_code
FROM customer""")
def hash_codes(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", md5_mod("c_name").alias("name_code"), md5_mod("c_mktsegment").alias("segment_code"))


@query(f"""WITH a AS (SELECT o_orderkey, (o_orderkey * 7919 % 256) || '.' || (o_custkey % 256) || '.'
    || (o_orderkey % 4) || '.' || (o_orderkey % 300) AS ip FROM orders), b AS (SELECT *, {_IPV4_SQL} AS n FROM a)
SELECT o_orderkey, {_PRIVATE_SQL} AS is_private FROM b""")
def private_addresses(spark, sf):
    key = F.col("o_orderkey")
    ip = F.concat_ws(".", *[c.cast("string") for c in (key * 7919 % 256, F.col("o_custkey") % 256, key % 4, key % 300)])
    return table(spark, sf, "orders").select("o_orderkey", is_private_ip(ip).alias("is_private"))


@query("""SELECT o_orderkey, hour(o_orderdate)::INTEGER AS hour, (isodow(o_orderdate) - 1)::INTEGER AS weekday,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""")
def event_times(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    shown = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf, "orders").select(
        "o_orderkey", F.hour("o_orderdate").alias("hour"), F.weekday("o_orderdate").alias("weekday"),
        F.date_format(epoch_ms(ms), shown).alias("at"), F.date_format(iso_timestamp(text), shown).alias("parsed"))


@query(f"WITH {TRAIL} SELECT event_id, {_RANKED} FROM trail")
def dictionary_encode(spark, sf):
    raw = trail(spark, sf).select("event_id", *CATEGORICAL)
    return encode(raw, {c: f"{c}_enc" for c in CATEGORICAL})


@query("SELECT c_name AS value, (ROW_NUMBER() OVER (ORDER BY c_name) - 1)::BIGINT AS code FROM (SELECT DISTINCT c_name FROM customer)")
def large_dictionary(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("value")).distinct()
    return dense_index(names, "value", "code")


# Quality, splits, metrics --------------------------------------------------------------------------------------


@query(f"""WITH {TRAIL}, a AS (SELECT COUNT(*)::DOUBLE AS n, AVG(CASE WHEN {_RULE} THEN 1.0 ELSE 0.0 END) AS rate FROM trail)
SELECT 'row_count' AS "check", n AS observed, 100000.0::DOUBLE AS lower, NULL::DOUBLE AS upper, n >= 100000 AS passed FROM a
UNION ALL SELECT 'anomaly_rate', ROUND(rate, 9), 0.03, 0.3, rate BETWEEN 0.03 AND 0.3 FROM a
UNION ALL SELECT c, 0, NULL, 0, TRUE FROM a, (SELECT unnest(['null_features', 'missing_columns', 'hour_out_of_range',
  'day_of_week_out_of_range', 'is_error_not_binary', 'is_root_not_binary', 'label_not_binary']) AS c)""")
def quality_report(spark, sf):
    report = quality.quality_report(labelled_features(spark, sf))
    return report.withColumn("observed", F.round("observed", 9))


@query(f"""WITH {TRAIL}, a AS (SELECT COUNT(*) AS n, AVG(CASE WHEN {_RULE} THEN 1.0 ELSE 0.0 END) AS rate FROM trail)
SELECT (CASE WHEN n >= 100000 THEN 0 ELSE 1 END + CASE WHEN rate BETWEEN 0.03 AND 0.3 THEN 0 ELSE 1 END)::BIGINT AS failed,
  9::BIGINT AS checks FROM a""")
def quality_verdict(spark, sf):
    return quality.verdict(quality.quality_report(labelled_features(spark, sf)))


_NODE_SQL = f"""WITH {TRAIL}, t AS (
  SELECT *, CASE WHEN {_RULE} THEN 1 ELSE 0 END AS label, contains(event_source, 'iam') AS m1,
         regexp_matches(event_source, 's3|ec2|compute') AS m2,
         ROW_NUMBER() OVER (ORDER BY {_unit_sql('event_id')}) AS rn, COUNT(*) OVER () AS n FROM trail),
s AS (SELECT LEAST(SUM(m1::INTEGER), SUM(m2::INTEGER)) >= 1000 AS by_source FROM t),
m AS (SELECT 'node1' AS node, t.* FROM t, s WHERE CASE WHEN by_source THEN m1 ELSE rn <= n // 2 END
  UNION ALL SELECT 'node2', t.* FROM t, s WHERE CASE WHEN by_source THEN m2 ELSE rn > n // 2 END)"""


@query(f"{_NODE_SQL} SELECT node, COUNT(*) AS n, SUM(label)::BIGINT AS n_anomaly FROM m GROUP BY node")
def node_split_counts(spark, sf):
    nodes = split.node_split(labelled(spark, sf), "event_source", "event_id")
    return nodes.groupBy("node").agg(F.count("*").alias("n"), F.sum(LABEL).cast("bigint").alias("n_anomaly"))


@query("""WITH n AS (SELECT l_returnflag AS label, COUNT(*) AS c FROM lineitem GROUP BY 1),
t AS (SELECT SUM(c) AS n, SUM(c) - CEIL(0.2::DOUBLE * SUM(c)) AS train FROM n),
e AS (SELECT label, c, c * train / n::DOUBLE AS x FROM n, t),
f AS (SELECT *, FLOOR(x) AS base, ROW_NUMBER() OVER (ORDER BY FLOOR(x) - x, label) AS pos FROM e)
SELECT label, (base + CASE WHEN pos <= (SELECT train FROM t) - (SELECT SUM(base) FROM f) THEN 1 ELSE 0 END)::BIGINT AS first FROM f
UNION ALL SELECT 'all in halves', SUM(c)::BIGINT // 2 FROM n""")
def splits_of_repeated_keys(spark, sf):
    """The key of a line is its supplier, which many lines share."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "label")
    train = split.stratified_split(lines, "l_suppkey").groupBy("label").agg(F.count_if("is_train").alias("first"))
    halves = split.half_split(lines, "l_suppkey").agg(F.count_if("is_first").alias("first"))
    return train.unionByName(halves.select(F.lit("all in halves").alias("label"), "first"))


@query(f"""WITH {TRAIL}, t AS (SELECT contains(event_source, 'iam')::INTEGER
  + regexp_matches(event_source, 's3|ec2|compute')::INTEGER AS k FROM trail)
SELECT SUM((k = 0)::INTEGER)::BIGINT AS uncovered, SUM((k = 1)::INTEGER)::BIGINT AS single,
  SUM((k > 1)::INTEGER)::BIGINT AS shared FROM t""")
def node_coverage(spark, sf):
    return split.node_coverage(trail(spark, sf), "event_source")


@query(f"""WITH n AS (SELECT quality, COUNT(*) AS c FROM labels GROUP BY quality),
t AS (SELECT SUM(c) AS n, SUM(c) - CEIL(0.2::DOUBLE * SUM(c)) AS train FROM n),
e AS (SELECT quality, c * train / n::DOUBLE AS x FROM n, t),
f AS (SELECT quality, FLOOR(x) AS base, ROW_NUMBER() OVER (ORDER BY FLOOR(x) - x, quality) AS pos FROM e),
k AS (SELECT quality, base + CASE WHEN pos <= (SELECT train FROM t) - (SELECT SUM(base) FROM f) THEN 1 ELSE 0 END AS k FROM f),
r AS (SELECT doc_id, quality, ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {_unit_sql("'42:' || doc_id")}) AS rn FROM labels)
SELECT doc_id, quality, rn <= k AS is_train FROM r JOIN k USING (quality)""")
def stratified_split(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return split.stratified_split(rows, "doc_id", "quality", 0.2, 42)


@query(f"""SELECT event_id, ROW_NUMBER() OVER (ORDER BY {_unit_sql('event_id::VARCHAR')}) <= COUNT(*) OVER () // 2 AS is_first
FROM events""")
def half_split(spark, sf):
    return split.half_split(table(spark, sf, "events").select("event_id"), "event_id")


_COUNTS = """SUM((quality = 1 AND toxic = 1)::INTEGER)::DOUBLE AS tp, SUM((quality = 0 AND toxic = 1)::INTEGER)::DOUBLE AS fp,
  SUM((quality = 1 AND toxic = 0)::INTEGER)::DOUBLE AS fn"""


@query(f"""WITH c AS (SELECT COUNT(*) AS n, {_COUNTS} FROM labels)
SELECT n, ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
  ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
  ROUND(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM c""")
def binary_metrics(spark, sf):
    found = met.binary_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _node_metrics(spark, sf):
    """A node is a market segment, a round an order priority, a metric an average over the node's orders."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.groupBy(F.col("c_mktsegment").alias("node"), F.col("o_orderpriority").alias("round")).agg(
        F.count("*").alias("n"),
        (F.avg("o_totalprice") / 1e6).alias("train_f1"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("eval_f1"),
        F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("eval_precision"),
        F.max(F.when(F.col("c_mktsegment") != "BUILDING", F.lit(0.5))).alias("eval_recall"),
        (F.avg("c_acctbal") / 1e5).alias("offset"),
    )


_NODE_METRICS = """nodes AS (SELECT c_mktsegment AS node, o_orderpriority AS "round", COUNT(*) AS n, AVG(o_totalprice) / 1e6 AS train_f1,
  AVG((o_orderstatus = 'F')::INTEGER::DOUBLE) AS eval_f1, AVG((o_orderstatus = 'O')::INTEGER::DOUBLE) AS eval_precision,
  MAX(CASE WHEN c_mktsegment <> 'BUILDING' THEN 0.5::DOUBLE END) AS eval_recall, AVG(c_acctbal) / 1e5 AS "offset"
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query(f"""WITH {_NODE_METRICS}
SELECT "round", ROUND(SUM(n * train_f1) / SUM(n), 6) AS train_f1, ROUND(SUM(n * eval_recall) / SUM(n), 6) AS eval_recall
FROM nodes GROUP BY 1""")
def weighted_metric_average(spark, sf):
    averaged = met.weighted_average(_node_metrics(spark, sf), "n", ["train_f1", "eval_recall"], ["round"])
    return averaged.select("round", *[F.round(c, 6).alias(c) for c in ("train_f1", "eval_recall")])


@query(f"""WITH {_NODE_METRICS}
SELECT "round", ROUND(SUM(n * "offset") / SUM(n), 6) AS "offset" FROM nodes GROUP BY 1""")
def fedavg(spark, sf):
    averaged = met.average_parameters(_node_metrics(spark, sf), "n", "offset", ["round"])
    return averaged.select("round", F.round("offset", 6).alias("offset"))


@query(f"""WITH {_NODE_METRICS}
SELECT "round", ROUND(SUM(n * train_f1) / SUM(n), 6) AS train_f1, ROUND(SUM(n * eval_f1) / SUM(n), 6) AS eval_f1,
  ROUND(SUM(n * eval_precision) / SUM(n), 6) AS eval_precision,
  ROUND(SUM(n * eval_recall) / SUM(CASE WHEN eval_recall IS NOT NULL THEN n END), 6) AS eval_recall,
  COUNT(*) AS num_clients, ROUND(1 - SUM(n * eval_f1) / SUM(n), 6) AS eval_loss FROM nodes GROUP BY 1""")
def federated_round_metrics(spark, sf):
    found = met.round_metrics(_node_metrics(spark, sf))
    rounded = ("train_f1", "eval_f1", "eval_precision", "eval_recall", "eval_loss")
    return found.select("round", "num_clients", *[F.round(c, 6).alias(c) for c in rounded])


def _trials(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("trial_id")).agg(
        F.round(F.avg("l_discount") * 10, 9).alias("f1"), F.count("*").alias("n_estimators"))


_TRIALS = """trials AS (SELECT l_suppkey AS trial_id, ROUND(AVG(l_discount) * 10, 9) AS f1, COUNT(*) AS n_estimators
  FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_TRIALS}, s AS (SELECT MIN(trial_id) AS stop FROM trials WHERE f1 >= 0.52)
SELECT trial_id, f1, n_estimators FROM trials, s WHERE stop IS NULL OR trial_id <= stop ORDER BY f1 DESC, trial_id LIMIT 1""")
def best_trial(spark, sf):
    return met.best_trial(_trials(spark, sf), "f1", "trial_id", goal=0.52)


@query(f"WITH {_TRIALS} SELECT trial_id, f1, n_estimators FROM trials ORDER BY f1 DESC, trial_id LIMIT 1")
def best_trial_without_goal(spark, sf):
    return met.best_trial(_trials(spark, sf), "f1", "trial_id")


# Order statistics ----------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.08), 6) AS threshold FROM lineitem GROUP BY 1""")
def contamination_threshold(spark, sf):
    cuts = quantiles.contamination_threshold(table(spark, sf, "lineitem"), 0.08, "l_extendedprice", "l_returnflag")
    return cuts.withColumn("threshold", F.round("threshold", 6))


@query("""SELECT l_orderkey, q AS quantile, ROUND(value, 6) AS value FROM (
  SELECT l_orderkey, unnest([0.25, 0.9])::DOUBLE AS q, unnest(quantile_cont(l_extendedprice, [0.25, 0.9])) AS value FROM lineitem GROUP BY 1)""")
def quantiles_of_many_groups(spark, sf):
    """A group for each order."""
    found = quantiles.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.9], "l_orderkey")
    return found.withColumn("value", F.round("value", 6))


@query("""SELECT event_type, q AS quantile, ROUND(value, 6) AS value FROM (
  SELECT event_type, unnest([0.5, 0.95, 0.99])::DOUBLE AS q, unnest(quantile_cont(value, [0.5, 0.95, 0.99])) AS value
  FROM events GROUP BY event_type)""")
def latency_quantiles(spark, sf):
    found = mon.latency_quantiles(table(spark, sf, "events"), "value", [0.5, 0.95, 0.99], "event_type")
    return found.withColumn("value", F.round("value", 6))


@query("""SELECT event_type, 0.99::DOUBLE AS quantile, value FROM (
  SELECT event_type, value + 0.0 AS value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
         COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = LEAST(FLOOR(n * 0.99::DOUBLE), n - 1)""")
def latency_by_index(spark, sf):
    return mon.latency_quantiles(table(spark, sf, "events"), "value", [0.99], "event_type", "index")


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


@query("""WITH b AS (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 'inf'::DOUBLE]::DOUBLE[]) AS le),
h AS (SELECT event_type, le, SUM((value <= le)::INTEGER)::DOUBLE AS upto FROM events, b GROUP BY 1, 2),
w AS (SELECT *, COALESCE(LAG(upto) OVER p, 0) AS below, LAG(le) OVER p AS lo, MAX(upto) OVER (PARTITION BY event_type) AS total
  FROM h WINDOW p AS (PARTITION BY event_type ORDER BY le)),
q AS (SELECT w.*, q AS quantile, q * total AS r FROM w, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q)),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type, quantile ORDER BY le) AS rn FROM q WHERE upto >= r)
SELECT event_type, quantile, ROUND(CASE WHEN le = 'inf'::DOUBLE THEN lo
  ELSE COALESCE(lo, 0) + (le - COALESCE(lo, 0)) * (r - below) / (upto - below) END, 6) AS value FROM f WHERE rn = 1""")
def histogram_quantiles(spark, sf):
    buckets = mon.to_buckets(table(spark, sf, "events"), "value", _BOUNDS, ["event_type"])
    found = mon.histogram_quantile(buckets, [0.5, 0.95, 0.99], ["event_type"])
    return found.withColumn("value", F.round("value", 6))


# Incremental scans ----------------------------------------------------------------------------------------------


@query("""SELECT CONCAT('e', CAST(event_id AS STRING)) AS event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-20 06:00:00'""")
def scan_since_event_time(spark, sf):
    """The log as files of a day each, whose later half comes first; the ledger opens those that reach the time."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    ts = F.col("ts").cast("timestamp")
    log = table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("eventID"), F.col("event_type").alias("eventName"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"), F.to_date(ts).alias("day"))
    ledger = FileLedger(spark, f"{base}/ledger", f"{base}/logs", multiline=False)
    late = F.col("day") < "2024-01-22"
    for part in (log.filter(late.isNull() | ~late), log.filter(late)):
        part.repartition("day", F.pmod(F.xxhash64("eventID"), F.lit(4))).write.mode("append").partitionBy("day").json(f"{base}/logs")
        ledger.refresh()
    return ledger.scan_since("2024-01-20T06:00:00Z").select(F.col("eventID").alias("event_id"), F.col("eventName").alias("event_type"))


# Similarity ----------------------------------------------------------------------------------------------------


def _centres(spark, sf, name: str) -> DataFrame:
    """The mean vector of every label."""
    vectors = table(spark, sf, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return vectors.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m")).select(
        F.col("label").alias(name), vector_to_array("m").alias("centre"))


_CENTRES = """dims AS (SELECT label, unnest(generate_series(1, 64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT label, d, AVG(x) AS m FROM dims GROUP BY 1, 2),
centres AS (SELECT label, list(m ORDER BY d) AS c FROM mean GROUP BY 1)"""
_COSINE = "ROUND(1 - list_cosine_similarity(c, embedding::DOUBLE[]), 9)"


@query(f"""WITH {_CENTRES}, p AS (SELECT centres.label, vec_id, {_COSINE} AS distance FROM centres, embeddings),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT label, vec_id, ROUND(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def topk_cosine(spark, sf):
    hits = nearest(_centres(spark, sf, "label"), table(spark, sf, "embeddings").drop("label"), 5, "label", "vec_id", "centre")
    return hits.withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_CENTRES}, p AS (SELECT centres.label, vec_id, ROUND(-list_inner_product(c, embedding::DOUBLE[]), 9) AS distance
  FROM centres, embeddings),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT label, vec_id, ROUND(distance, 6) AS distance, rank FROM r WHERE rank <= 3""")
def topk_inner_product(spark, sf):
    hits = nearest(_centres(spark, sf, "label"), table(spark, sf, "embeddings").drop("label"), 3, "label", "vec_id", "centre",
                   metric="inner")
    return hits.withColumn("distance", F.round("distance", 6))


_LISTS = f"""{_CENTRES}, placed AS (SELECT vec_id, embedding, label AS list_id FROM (
  SELECT vec_id, embedding, centres.label, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY {_COSINE}, centres.label) AS rn
  FROM embeddings, centres) WHERE rn = 1)"""


@query(f"WITH {_LISTS} SELECT list_id, COUNT(*) AS n FROM placed GROUP BY 1")
def ivf_lists(spark, sf):
    placed = assign_lists(table(spark, sf, "embeddings"), _centres(spark, sf, "list_id"))
    return placed.groupBy("list_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_LISTS}, probed AS (SELECT label, list_id FROM (
  SELECT a.label, b.label AS list_id, ROW_NUMBER() OVER (PARTITION BY a.label
    ORDER BY ROUND(1 - list_cosine_similarity(a.c, b.c), 9), b.label) AS rn FROM centres a, centres b) WHERE rn <= 3),
p AS (SELECT centres.label, vec_id, {_COSINE} AS distance FROM centres JOIN probed USING (label) JOIN placed USING (list_id)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT label, vec_id, ROUND(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def topk_ivf(spark, sf):
    centres = _centres(spark, sf, "list_id")
    index = assign_lists(table(spark, sf, "embeddings").drop("label"), centres)
    queries = _centres(spark, sf, "label")
    hits = nearest_in_lists(queries, index, centres, 5, "label", "vec_id", "centre", probes=3)
    return hits.withColumn("distance", F.round("distance", 6))


def _exact_sql(distance: str, k: int) -> str:
    return f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, ROUND({distance}, 9) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, vec_id, ROUND(distance, 6) AS distance, rank FROM r WHERE rank <= {k}"""


def _exact(spark, sf, metric: str, k: int) -> DataFrame:
    """Every hundredth vector against all of them, in lists and rings."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    hits = nearest_exact(queries, exact_index(vectors, "vec_id", metric=metric), k, "query_id", "vec_id")
    return hits.withColumn("distance", F.round("distance", 6))


@query(_exact_sql("1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 5))
def exact_search_cosine(spark, sf):
    return _exact(spark, sf, "cosine", 5)


@query(_exact_sql("-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 3))
def exact_search_inner_product(spark, sf):
    return _exact(spark, sf, "inner", 3)


@query("""SELECT vec_id, ROUND(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2,
  ROUND(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS distance FROM embeddings""")
def vector_expressions(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(dot(e, e), 6).alias("norm2"), F.round(cosine_distance(e, F.reverse(e)), 6).alias("distance"))


@query("""SELECT label, SUM((label = 4)::INTEGER)::BIGINT AS valid, SUM((label <> 4)::INTEGER)::BIGINT AS rejected
FROM embeddings GROUP BY 1""")
def vector_dimension_check(spark, sf):
    cut = table(spark, sf, "embeddings").withColumn("embedding", F.slice("embedding", F.lit(1), F.col("label") + 56))
    valid, rejected = split_by_dimension(cut, 60)
    both = valid.select("label", F.lit(1).alias("ok")).unionByName(rejected.select("label", F.lit(0).alias("ok")))
    return both.groupBy("label").agg(F.count_if(F.col("ok") == 1).alias("valid"), F.count_if(F.col("ok") == 0).alias("rejected"))


@query(r"""SELECT doc_id, 1024 AS dim, 1.0::DOUBLE AS norm FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')""")
def text_vectors(spark, sf):
    documents = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    vectors = TextVectoriser(1024).fit(documents, "text").transform(documents, "text")
    v = F.col("embedding")
    return vectors.filter(v.isNotNull()).select("doc_id", F.size(v).alias("dim"), F.round(F.sqrt(dot(v, v)), 3).alias("norm"))


@query(r"""SELECT doc_id, regexp_matches(COALESCE(text, ''), '[\p{L}\p{N}]') AS has_vector, 0.0::DOUBLE AS difference, 2::BIGINT AS version FROM documents""")
def text_vectors_of_increments(spark, sf):
    """Vectors with a vocabulary of two increments, the second added twice, against those of one fit to all texts."""
    documents = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    vocabulary = Vocabulary(spark, _work(spark), 1024)
    first = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    vocabulary.add(documents.filter(first), "text", "first")
    for _ in range(2):
        version = vocabulary.add(documents.filter(~first), "text", "others")
    both = vocabulary.vectoriser(version).transform(documents, "text", "by_increments")
    both = TextVectoriser(1024).fit(documents, "text").transform(both, "text", "refitted")
    gap = F.aggregate(F.zip_with("by_increments", "refitted", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda m, d: F.greatest(m, d.cast("double")))
    return both.select("doc_id", F.col("by_increments").isNotNull().alias("has_vector"), F.coalesce(F.round(gap, 5), F.lit(0.0)).alias("difference"), F.lit(version).alias("version"))


# Joins, dedup, upsert ------------------------------------------------------------------------------------------


@query(f"""WITH {TRAIL}, e AS (SELECT CASE WHEN identity_type = 'Root' THEN '' ELSE event_id END AS event_id, event_name FROM trail)
SELECT event_id, event_name FROM e WHERE event_id = '' OR event_id NOT IN (
  SELECT event_id FROM trail WHERE event_source = 's3.amazonaws.com')""")
def unprocessed_events(spark, sf):
    t = trail(spark, sf)
    events = t.select(F.when(F.col("identity_type") == "Root", "").otherwise(F.col("event_id")).alias("event_id"), "event_name")
    log = t.filter(F.col("event_source") == "s3.amazonaws.com").select("event_id")
    return triage.unprocessed(events, log)


def _upsert_sql(order: str) -> str:
    return f"""WITH {TRAIL}, latest AS (SELECT principal, event_id, event_name, metric_value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY principal ORDER BY event_time {order}, event_id {order}) AS rn FROM trail) WHERE rn = 1),
target AS (SELECT principal, event_id, event_name, metric_value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY principal ORDER BY event_time, event_id) AS rn FROM trail
  WHERE event_name = 'CreateUser') WHERE rn = 1)"""


def _upsert_sides(spark, sf):
    t = trail(spark, sf).select("principal", "event_id", "event_name", "metric_value", "event_time")
    target = upsert.first_per_key(t.filter(F.col("event_name") == "CreateUser"), "principal", F.struct("event_time", "event_id"))
    return target.drop("event_time"), t


@query(_upsert_sql("ASC") + """
SELECT * FROM target UNION ALL SELECT * FROM latest WHERE principal NOT IN (SELECT principal FROM target)""")
def upsert_keep_first(spark, sf):
    target, source = _upsert_sides(spark, sf)
    merged = upsert.upsert_keep_first(target, source, "principal", F.struct("event_time", "event_id"))
    return merged.drop("event_time")


@query(_upsert_sql("DESC") + """
SELECT l.principal, COALESCE(t.event_id, l.event_id) AS event_id, l.event_name, l.metric_value
FROM latest l LEFT JOIN target t USING (principal)""")
def upsert_replace(spark, sf):
    target, source = _upsert_sides(spark, sf)
    return upsert.upsert_replace(target, source, "principal", ["event_name", "metric_value"], F.struct("event_time", "event_id"))


@query(_upsert_sql("DESC") + """
SELECT l.principal, COALESCE(t.event_id, l.event_id) AS event_id, l.event_name, l.metric_value
FROM latest l LEFT JOIN target t USING (principal)
UNION ALL SELECT principal, event_id, event_name, metric_value FROM target WHERE principal NOT IN (SELECT principal FROM latest)""")
def upsert_in_buckets(spark, sf):
    """The same upsert on a table in buckets, of which only the touched ones are rewritten."""
    target, source = _upsert_sides(spark, sf)
    held = BucketedTable(spark, f"{_work(spark)}/index", target.schema, "principal", 16)
    held.write(target)
    held.upsert(source, lambda old, new: upsert.upsert_replace(old, new, "principal", ["event_name", "metric_value"], F.struct("event_time", "event_id")))
    return held.read()


@query("""SELECT event_id, event_type, value FROM (SELECT 'e' || event_id AS event_id, event_type, value FROM events WHERE event_id % 4 < 2)
WHERE event_id IN (SELECT 'e' || l_orderkey FROM lineitem)""")
def log_lookup(spark, sf):
    """The events that the first two batches of a log have, of those with the id of an order; files without one stay closed."""
    rows = table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("event_id"), "event_type", "value", (F.col("event_id") % 4).alias("batch"))
    log = KeyedLog(spark, f"{_work(spark)}/log", rows.drop("batch").schema, "event_id", 5_000)
    for batch in range(3):
        log.append(rows.filter(F.col("batch") == batch).drop("batch"), batch)
    return log.rows_for(table(spark, sf, "lineitem").select(F.concat(F.lit("e"), "l_orderkey").alias("key")), before=2)


@query(_upsert_sql("DESC") + """
SELECT event_name, SUM((principal NOT IN (SELECT principal FROM target))::INTEGER)::BIGINT AS inserted,
  SUM((principal IN (SELECT principal FROM target))::INTEGER)::BIGINT AS updated, COUNT(*) AS upserted FROM latest GROUP BY 1""")
def upsert_batch_counts(spark, sf):
    target, source = _upsert_sides(spark, sf)
    latest = upsert.last_per_key(source, "principal", F.struct("event_time", "event_id"))
    return upsert.upsert_counts(target, latest, "principal", "event_name")


@query(_upsert_sql("DESC") + """
SELECT COUNT(DISTINCT CASE WHEN principal NOT IN (SELECT principal FROM target) THEN principal END) AS inserted,
  COUNT(DISTINCT CASE WHEN principal IN (SELECT principal FROM target) THEN principal END) AS updated,
  COUNT(DISTINCT principal) AS upserted FROM trail""")
def upsert_repeated_counts(spark, sf):
    """The source holds most keys several times."""
    target, source = _upsert_sides(spark, sf)
    return upsert.upsert_counts(target, source, "principal")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return upsert.last_per_key(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


def _stage_events(spark, sf):
    kind = F.col("event_type")
    stage = (F.when(kind == "purchase", "Production").when(kind == "click", "Archived").when(kind == "error", "Canary")
             .otherwise("Staging"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("name"),
        F.col("user_id").cast("string").alias("version"), stage.alias("stage"),
        F.struct("ts", "event_id").alias("at"))


_STAGES = """ev AS (SELECT 'm' || (user_id % 10) AS name, user_id::VARCHAR AS version, CASE event_type WHEN 'purchase' THEN 'Production'
  WHEN 'click' THEN 'Archived' WHEN 'error' THEN 'Canary' ELSE 'Staging' END AS stage, ts, event_id FROM events),
stages AS (SELECT name, version, stage FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, version
  ORDER BY ts DESC, event_id DESC) AS rn FROM ev WHERE stage IN ('Staging', 'Production', 'Archived')) WHERE rn = 1)"""


@query(f"WITH {_STAGES} SELECT * FROM stages")
def model_stages(spark, sf):
    return current_stages(_stage_events(spark, sf))


@query(f"""WITH {_STAGES} SELECT name, version, stage FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name
  ORDER BY (stage = 'Production')::INTEGER DESC, version::BIGINT DESC) AS rn FROM stages) WHERE rn = 1""")
def serving_model(spark, sf):
    return serving_version(current_stages(_stage_events(spark, sf)))


@query("""SELECT 'r' || o_orderkey AS run_id, o_orderstatus AS status, o_totalprice AS f1 FROM orders
WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, 'r' || o_orderkey LIMIT 5""")
def newest_runs(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderpriority").alias("experiment"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("f1"))
    return read_runs(runs, "1-URGENT", 5).select("run_id", "status", "f1")


@query(f"""WITH {TRAIL} SELECT event_id, metric_value AS score,
  CASE WHEN error_code = 'AccessDenied' THEN 'genuine_bug' ELSE 'known_change' END AS decision, 0.5::DOUBLE AS confidence
FROM trail WHERE error_code IS NOT NULL""")
def audit_view(spark, sf):
    t = trail(spark, sf)
    decision = F.when(F.col("error_code") == "AccessDenied", "genuine_bug").otherwise("known_change")
    log = t.filter("error_code is not null").select("event_id", decision.alias("decision"), F.lit(0.5).alias("confidence"))
    return triage.audit_view(log, t.select("event_id", F.col("metric_value").alias("score")))


# Changes, context, verdicts, payloads --------------------------------------------------------------------------


def _change_events(spark, sf):
    named = F.concat(F.lit('{"functionName":"f'), F.expr("substring(event_id, 2)"), F.lit('","memory":128}'))
    params = F.when(F.col("event_name") == "RunInstances", named).otherwise(F.col("request_parameters"))
    return trail(spark, sf, heavy=True).withColumn("request_parameters", params)


_TIME = "strftime(event_time, '%Y-%m-%dT%H:%M:%S')"
_PARAMS = """CASE WHEN event_name = 'RunInstances' THEN '{"functionName": "f' || substr(event_id, 2) || '", "memory": 128}'
  ELSE replace(json(request_parameters)::VARCHAR, ':', ': ') END"""


@query(f"""WITH {TRAIL}, newest AS (SELECT * FROM trail WHERE NOT read_only AND event_time >= TIMESTAMP '2024-01-10 00:00:00'
  ORDER BY event_time DESC, event_id LIMIT 500)
SELECT event_id, event_name || ' at ' || {_TIME} || ' by unknown via ' || event_source || ' in ' || region || ': '
  || {_PARAMS} AS document FROM newest WHERE event_name IN ('RunInstances', 'PutBucketPolicy')""")
def changes_since(spark, sf):
    start_at = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    changes = lookup_changes(_change_events(spark, sf), start_at, layout=FLAT)
    m = member_columns(changes, FLAT)
    shown = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    return changes.select("event_id", change_document(m, shown).alias("document"))


@query(f"""WITH {TRAIL} SELECT event_id,
  event_name || ' on ' || {_PARAMS} || ' by ' || principal || ' at ' || {_TIME} AS line,
  '[' || {_TIME} || '] ' || event_name || ' on ' || event_source || ' in ' || region || ' by ' || principal || '. Params: '
    || {_PARAMS} AS summary,
  CASE WHEN event_name = 'RunInstances' THEN 'f' || substr(event_id, 2) END AS resource,
  event_name || ' ' || event_source || COALESCE(' ' || error_code, '') AS query
FROM trail WHERE NOT read_only AND event_name IN ('CreateUser', 'RunInstances', 'PutBucketPolicy')""")
def change_texts(spark, sf):
    t = _change_events(spark, sf)
    changes = t.filter(is_infra_change(t["management_event"], t["read_only"], t["event_name"]))
    m = member_columns(changes, FLAT)
    shown = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    return changes.select("event_id", change_line(m, shown).alias("line"), change_summary(m, shown).alias("summary"),
                          changed_resource(m["request_parameters"]).alias("resource"), retrieval_query(m).alias("query"))


@query(r"""SELECT event_id, regexp_replace(regexp_replace(json(props)::VARCHAR, ':', ': ', 'g'), ',', ', ', 'g') AS printed FROM events""")
def printed_parameters(spark, sf):
    return table(spark, sf, "events").select("event_id", printed_json("props").alias("printed"))


_RESPONSE = """CASE turn % 7 WHEN 0 THEN '{"decision":"known_change","confidence":0.' || (conv_id % 10) || ',"reasoning":"r' || turn || '","severity":"P1"}'
  WHEN 1 THEN '{"verdict":"genuine_bug","confidence":"0.9","reason":"same"}' WHEN 2 THEN '{"decision":"known_change"}'
  WHEN 3 THEN '{"decision":"known_change","confidence":"high"}' WHEN 4 THEN '{"decision":"known_change","confidence":null}'
  WHEN 5 THEN '[1, 2]' ELSE text END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {_RESPONSE} AS response FROM conversations),
p AS (SELECT *, turn % 7 < 3 AS ok FROM r)
SELECT conv_id, turn, ok AS parse_ok,
  CASE WHEN ok THEN COALESCE(json_extract_string(response, '$.decision'), json_extract_string(response, '$.verdict'), 'genuine_bug')
    ELSE 'genuine_bug' END AS decision,
  CASE WHEN ok THEN COALESCE(TRY_CAST(json_extract_string(response, '$.confidence') AS DOUBLE), 0.5) ELSE 0.5 END AS confidence,
  CASE WHEN ok THEN COALESCE(json_extract_string(response, '$.reasoning'), json_extract_string(response, '$.reason'), '')
    ELSE substr(response, 1, 500) END AS reasoning,
  CASE WHEN ok THEN COALESCE(json_extract_string(response, '$.severity'), 'P3') ELSE 'P3' END AS severity FROM p""")
def verdict_parse(spark, sf):
    response = (
        F.when(F.col("turn") % 7 == 0, F.concat(
            F.lit('{"decision":"known_change","confidence":0.'), (F.col("conv_id") % 10).cast("string"),
            F.lit(',"reasoning":"r'), F.col("turn").cast("string"), F.lit('","severity":"P1"}')))
        .when(F.col("turn") % 7 == 1, '{"verdict":"genuine_bug","confidence":"0.9","reason":"same"}')
        .when(F.col("turn") % 7 == 2, '{"decision":"known_change"}')
        .when(F.col("turn") % 7 == 3, '{"decision":"known_change","confidence":"high"}')
        .when(F.col("turn") % 7 == 4, '{"decision":"known_change","confidence":null}')
        .when(F.col("turn") % 7 == 5, "[1, 2]").otherwise(F.col("text"))
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", response.alias("response"))
    return triage.parse_verdict(rows).drop("response")


def _contexts(spark, sf):
    """For each label the five nearest vectors as changes: vector n stands for event n."""
    hits = nearest(_centres(spark, sf, "label"), table(spark, sf, "embeddings").drop("label"), 5, "label", "vec_id", "centre")
    t = trail(spark, sf)
    chunks = t.select(F.expr("substring(event_id, 2)").cast("bigint").alias("vec_id"), F.col("principal").alias("raw_text"),
                      "event_name", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
                      F.col("error_code").alias("resource"), "principal")
    found = with_payload(hits, chunks, "vec_id", ["raw_text", "event_name", "event_time", "resource", "principal"])
    ranked = F.array_sort(F.collect_list(F.struct("rank", triage.context_struct().alias("chunk"))))
    contexts = found.groupBy("label").agg(F.transform(ranked, lambda r: r["chunk"]).alias("ctx"))
    every = table(spark, sf, "embeddings").select("label").distinct().unionByName(spark.range(1).select(F.lit(-1).alias("label")))
    return every.join(contexts, "label", "left")


_BLOCKS = f"""{TRAIL}, {_CENTRES}, p AS (SELECT centres.label, vec_id, {_COSINE} AS distance FROM centres, embeddings),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM p),
blocks AS (SELECT label, string_agg('- [' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '] ' || event_name || ' on '
  || COALESCE(error_code, '?') || ' by ' || principal || ': ' || principal, chr(10) ORDER BY rank) AS block
  FROM r JOIN trail ON event_id = 'e' || vec_id WHERE rank <= 5 GROUP BY label
  UNION ALL SELECT -1, 'No infrastructure changes found since last model training.')"""


@query(f"WITH {_BLOCKS} SELECT label, block FROM blocks")
def context_blocks(spark, sf):
    return _contexts(spark, sf).select("label", triage.context_block(F.col("ctx")).alias("block"))


@query(f"""WITH {_BLOCKS} SELECT label, 'Event: {{"label":' || label || '}} since 2024-01-10T00:00:00Z' || chr(10) || block AS prompt
FROM blocks""")
def prompt_rows(spark, sf):
    text = triage.prompt(F.struct("label"), F.lit("2024-01-10T00:00:00Z"), triage.context_block(F.col("ctx")),
                         "Event: %s since %s\n%s")
    return _contexts(spark, sf).select("label", text.alias("prompt"))


def _decided(spark, sf):
    t = trail(spark, sf, heavy=True)
    decision = F.when(F.col("error_code") == "AccessDenied", "genuine_bug").otherwise("known_change")
    severity = F.element_at(F.array(*[F.lit(s) for s in ("P1", "P2", "P3", "P9")]),
                            (F.expr("substring(event_id, 2)").cast("bigint") % 4 + 1).cast("int"))
    return t.select("*", decision.alias("decision"), severity.alias("severity"), F.lit("why").alias("reasoning"),
                    F.when(F.col("event_name") != "ListBuckets", F.col("metric_value")).alias("score"))


@query(f"""WITH {TRAIL}, d AS (SELECT *, CASE substr(event_id, 2)::BIGINT % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' ELSE 'warning' END AS severity
  FROM trail WHERE error_code = 'AccessDenied')
SELECT event_id, severity, 'Anomaly: ' || event_name || ' by ' || principal AS summary, event_id AS dedup_key,
  error_code AS error, region FROM d""")
def pager_rows(spark, sf):
    rows = triage.pager_payload(_decided(spark, sf), FLAT)
    member = {"summary": "$.payload.summary", "dedup_key": "$.dedup_key", "error": "$.payload.custom_details.error",
              "region": "$.payload.custom_details.region"}
    return rows.select("event_id", "severity", *[F.get_json_object("payload", p).alias(n) for n, p in member.items()])


@query(f"""WITH {TRAIL}, d AS (SELECT *, COALESCE(error_code, '') = 'AccessDenied' AS bug FROM trail)
SELECT event_id, CASE WHEN bug THEN '#FF0000' ELSE '#36a64f' END AS color,
  CASE WHEN bug THEN ':rotating_light: Genuine Anomaly: ' ELSE ':white_check_mark: Known Change: ' END || event_name AS header,
  '*Score:*' || chr(10) || CASE WHEN event_name = 'ListBuckets' THEN '?' ELSE printf('%.4f', metric_value) END AS score,
  '*Region:*' || chr(10) || region AS region, '*Reasoning:*' || chr(10) || 'why' AS reasoning FROM d""")
def chat_rows(spark, sf):
    rows = triage.chat_payload(_decided(spark, sf), FLAT)
    blocks = "$.attachments[0].blocks"
    member = {"score": f"{blocks}[1].fields[0].text", "region": f"{blocks}[1].fields[3].text", "reasoning": f"{blocks}[2].text.text"}
    return rows.select("event_id", "color", "header", *[F.get_json_object("payload", p).alias(n) for n, p in member.items()])


@query(f"""WITH {TRAIL} SELECT event_id AS key, event_name AS "eventName", printf('%.2f', metric_value) AS score FROM trail""")
def scored_messages(spark, sf):
    rows = triage.scored_message(trail(spark, sf).withColumn("score", F.col("metric_value")), FLAT)
    score = F.format_string("%.2f", F.get_json_object("value", "$.score").cast("double"))
    return rows.select("key", F.get_json_object("value", "$.eventName").alias("eventName"), score.alias("score"))


@query(f"WITH {TRAIL} SELECT event_id, metric_value FROM trail WHERE metric_value < 5.0")
def flagged_events(spark, sf):
    return flag_below(trail(spark, sf), 5.0, "metric_value").select("event_id", "metric_value")


@query("""SELECT event_type AS decision, COUNT(*) AS n, event_type IN ('genuine_bug', 'known_change') AS valid
FROM events GROUP BY 1""")
def decision_domain(spark, sf):
    valid, quarantined = split_by_rule(table(spark, sf, "events"), valid_decision(F.col("event_type")))
    both = valid.withColumn("valid", F.lit(True)).unionByName(quarantined.withColumn("valid", F.lit(False)))
    return both.groupBy(F.col("event_type").alias("decision"), "valid").agg(F.count("*").alias("n"))


# Monitoring ----------------------------------------------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end,
  COUNT(*) AS n FROM events GROUP BY 1""")
def flagged_per_5min(spark, sf):
    return mon.flagged_per_window(table(spark, sf, "events"), "ts")


@query("""WITH w AS (SELECT unnest([0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55]) AS back)
SELECT time_bucket(INTERVAL '5 minutes', ts) - to_minutes(back::BIGINT) AS window_start, SUM((event_type = 'error')::INTEGER)::BIGINT AS genuine,
  COUNT(*) AS n, ROUND(AVG((event_type = 'error')::INTEGER::DOUBLE), 9) AS rate FROM events, w GROUP BY 1""")
def decision_rate_1h(spark, sf):
    events = table(spark, sf, "events")
    decision = F.when(F.col("event_type") == "error", "genuine_bug").otherwise("known_change")
    return mon.decision_rate(events, "ts", decision, slide="5 minutes").withColumn("rate", F.round("rate", 9))


@query("SELECT event_type, user_id % 4 AS shard, COUNT(*) AS n FROM events GROUP BY 1, 2")
def event_frequency(spark, sf):
    return mon.frequency(table(spark, sf, "events").withColumn("shard", F.col("user_id") % 4), "event_type", "shard")


_RATES = """s AS (SELECT event_type, floor(epoch_us(ts) / 1e6 / 21600) * 21600.0 AS w, epoch_us(ts) / 1e6::DOUBLE AS t, value AS v FROM events),
l AS (SELECT *, LAG(v) OVER (PARTITION BY event_type, w ORDER BY t, v) AS p, FIRST_VALUE(v) OVER (PARTITION BY event_type, w ORDER BY t, v) AS f FROM s),
g AS (SELECT event_type, w, COUNT(*) AS n, SUM(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) AS raw,
  MIN(t) AS t0, MAX(t) AS t1, MIN(f) AS v0 FROM l GROUP BY 1, 2 HAVING COUNT(*) > 1 AND MAX(t) > MIN(t)),
h AS (SELECT *, t1 - t0 AS span, (t1 - t0) / (n - 1) AS gap FROM g),
e AS (SELECT *, LEAST(CASE WHEN t0 - w >= gap * 1.1 THEN gap / 2 ELSE t0 - w END,
    CASE WHEN raw > 0 AND v0 >= 0 THEN span * v0 / raw ELSE 1e300 END) AS lead,
  CASE WHEN w + 21600 - t1 >= gap * 1.1 THEN gap / 2 ELSE w + 21600 - t1 END AS tail FROM h),
rates AS (SELECT event_type, make_timestamp((w * 1000000)::BIGINT) AS window_start, raw * (span + lead + tail) / span AS increase,
  raw * (span + lead + tail) / span / 21600 AS rate FROM e)"""


@query(f"WITH {_RATES} SELECT event_type, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, ROUND(increase, 4) AS increase, ROUND(rate, 6) AS rate FROM rates")
def counter_rate(spark, sf):
    found = mon.counter_increase(table(spark, sf, "events"), ["event_type"], "ts", "value", 6 * 3600)
    return found.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                        F.round("increase", 4).alias("increase"), F.round("rate", 6).alias("rate"))


@query(f"""WITH {_RATES} SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
  ROUND(SUM(CASE WHEN event_type <> 'view' THEN rate ELSE 0 END) / SUM(rate), 6) AS busy FROM rates GROUP BY 1""")
def node_busy_ratio(spark, sf):
    found = mon.counter_increase(table(spark, sf, "events"), ["event_type"], "ts", "value", 6 * 3600)
    busy = mon.busy_ratio(found, ["window_start"], "event_type", idle="view")
    return busy.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("busy", 6).alias("busy"))


@query("""SELECT user_id, ROUND(1 - MAX(CASE WHEN event_type = 'view' THEN value END) / MAX(CASE WHEN event_type = 'click' THEN value END), 6) AS used
FROM events GROUP BY 1""")
def memory_used_ratio(spark, sf):
    """A total of zero has no ratio; DuckDB's division gives null there too."""
    return mon.used_ratio(table(spark, sf, "events"), ["user_id"], "event_type", "value", "view", "click").withColumn("used", F.round("used", 6))


@query("SELECT o_custkey, COALESCE(BOOL_AND(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'O' END), TRUE) AS ready FROM orders GROUP BY 1")
def pods_ready(spark, sf):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O")
    return mon.all_ready_rows(table(spark, sf, "orders").withColumn("ready", status), "o_custkey", "ready")


@query("""SELECT event_type, (SUM(event_id) - SUM(CASE WHEN user_id % 2 = 0 THEN event_id - 3 ELSE 0 END))::BIGINT AS lag FROM events GROUP BY 1""")
def consumer_lag(spark, sf):
    committed = F.when(F.col("user_id") % 2 == 0, F.col("event_id") - 3)
    offsets = table(spark, sf, "events").withColumn("committed", committed)
    return mon.consumer_lag(offsets, ["event_type"], "event_id", "committed")


@query("""SELECT event_type, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(MAX(ts))))::BIGINT AS seconds FROM events GROUP BY 1""")
def last_success_age(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return mon.last_success_age(table(spark, sf, "events"), "ts", now, ["event_type"])


@query("""SELECT user_id::VARCHAR AS message_id, COUNT(*)::INTEGER AS attempts, COUNT(*) >= 3 AS dead
FROM events WHERE event_type = 'error' GROUP BY 1""")
def failed_messages(spark, sf):
    errors = table(spark, sf, "events").filter(F.col("event_type") == "error")
    attempts = errors.groupBy(F.col("user_id").cast("string").alias("message_id")).agg(
        F.count("*").cast("int").alias("attempts"), F.min("props").alias("raw"), F.max("ts").alias("at"))
    return attempt_status(attempts).select("message_id", "attempts", "dead")


@query("""WITH a AS (SELECT user_id, COUNT(*) AS k FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT CASE WHEN k >= 3 THEN 'dead' ELSE 'retry' END AS queue, COUNT(*) AS depth FROM a GROUP BY 1""")
def dead_letter_depth(spark, sf):
    queue = F.when(F.col("dead"), "dead").otherwise("retry").alias("queue")
    return mon.dead_letter_depth(failed_messages(spark, sf).select(queue), "queue")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-24 12:00:00'")
def retained_messages(spark, sf):
    now = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return retained(table(spark, sf, "events"), "ts", 7, now).select("event_id", "ts")


@query("""WITH RECURSIVE t AS (SELECT event_type, user_id % 4 AS shard, ts FROM events),
c AS (SELECT event_type, shard, MIN(ts) AS ts FROM t GROUP BY 1, 2
  UNION ALL SELECT c.event_type, c.shard, (SELECT MIN(t.ts) FROM t WHERE t.event_type = c.event_type AND t.shard = c.shard
    AND t.ts >= c.ts + INTERVAL '4 hours') AS ts FROM c WHERE c.ts IS NOT NULL)
SELECT event_type, shard, ts FROM c WHERE ts IS NOT NULL""")
def alert_repeat_suppression(spark, sf):
    alerts = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("shard"), "ts")
    return mon.suppress_repeats(alerts, ["event_type", "shard"], "ts")


# Jobs ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, 2::BIGINT AS tries FROM events GROUP BY 1, 2")
def resumed_job(spark, sf):
    """A job of two steps that dies within each, after its work and before its commit: the third run ends it, published once."""
    out = _work(spark)
    died = set()

    def dying(step: str, work):
        def run(again: bool):
            if not (again and path_exists(spark, f"{out}/{step}")):
                work(f"{out}/{step}")
            if step not in died:
                died.add(step)
                raise RuntimeError(f"died in {step}")
        return run

    def days(path):
        day = F.date_format("ts", "yyyy-MM-dd").alias("day")
        table(spark, sf, "events").groupBy("event_type", day).agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.parquet(path)

    def publish(path):
        spark.read.parquet(f"{out}/days").write.mode("append").parquet(path)

    for _ in range(3):
        journal = Journal(spark, f"{out}/journal", "days")
        try:
            journal.step("days", dying("days", days))
            journal.step("publish", dying("publish", publish))
        except RuntimeError:
            continue
    tries = journal.status().filter("step = 'publish' and committed").first()["tries"]
    found = spark.read.parquet(f"{out}/publish")
    return found.select("event_type", "day", "n", F.round("total", 4).alias("total"), F.lit(tries).cast("bigint").alias("tries"))


# Forest --------------------------------------------------------------------------------------------------------

PRICE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf):
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                      F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return spread(table(spark, sf, "lineitem").select(key.alias("line"), *PRICE_FEATURES), again=True)


def _line_forest(spark, sf):
    lines = _lines(spark, sf)
    return lines, iforest.fit_forest(lines, "line", features=PRICE_FEATURES)


@query()
def forest_scores(spark, sf):
    """100 trees over the whole lineitem table, every line scored."""
    scored = iforest.fit_and_score(_lines(spark, sf), "line", features=PRICE_FEATURES)[1]
    return scored.select("line", F.round("score", 9).alias("score"), "prediction")


@query("""SELECT COUNT(*) AS n, 0.08::DOUBLE AS expected, 0.08::DOUBLE AS measured FROM lineitem""")
def forest_flagged(spark, sf):
    """The flagged share of the training rows, to three places, next to the contamination that was asked for."""
    scored = iforest.fit_and_score(_lines(spark, sf), "line", features=PRICE_FEATURES)[1]
    share = F.avg((F.col("prediction") == -1).cast("double"))
    return scored.agg(F.count("*").alias("n"), F.lit(0.08).alias("expected"), F.round(share, 3).alias("measured"))


def _shape(model: iforest.Forest) -> DataFrame:
    """Per tree what a well-formed tree has in common with any other of its sample size."""
    leaf = F.col("is_leaf")
    return model.nodes.groupBy("tree_id").agg(
        F.max(F.when(F.col("node_id") == 1, F.col("n_samples"))).alias("sample"),
        F.sum(F.when(leaf, F.col("n_samples"))).alias("in_leaves"),
        (F.count_if(leaf) - F.count_if(~leaf)).alias("leaves_over_splits"),
        (F.max("depth") <= max(iforest.height_limit(s) for s in model.samples.values())).alias("within_height"))


@query("""SELECT t::INTEGER AS tree_id, LEAST(256, n) AS sample, LEAST(256, n) AS in_leaves, 1::BIGINT AS leaves_over_splits, TRUE AS within_height
FROM (SELECT COUNT(*) AS n FROM lineitem), (SELECT unnest(range(100)) AS t)""")
def forest_tree_shape(spark, sf):
    """100 trees of 256 rows: every row of a sample ends in a leaf, every split has two children."""
    return _shape(_line_forest(spark, sf)[1])


@query("""SELECT t::INTEGER AS tree_id, 256::BIGINT AS sample, 256::BIGINT AS in_leaves, 1::BIGINT AS leaves_over_splits, TRUE AS within_height
FROM (SELECT unnest(range(50)) AS t)""")
def forest_tree_shape_of_hot_keys(spark, sf):
    """50 trees where one key has a third of the rows and the others repeat: every sample is full."""
    lines = table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey")).alias("order"), *PRICE_FEATURES)
    return _shape(iforest.fit_forest(lines, "order", n_estimators=50, contamination=None, features=PRICE_FEATURES))


@query("""SELECT t::INTEGER AS tree_id, FLOOR(n * 0.8::DOUBLE)::BIGINT AS sample, FLOOR(n * 0.8::DOUBLE)::BIGINT AS in_leaves, 1::BIGINT AS leaves_over_splits,
  TRUE AS within_height FROM (SELECT COUNT(*) AS n FROM lineitem), (SELECT unnest(range(5)) AS t)""")
def forest_tree_shape_of_shares(spark, sf):
    """Trees of four fifths of the rows, level by level until a node fits a task."""
    return _shape(iforest.fit_forest(_lines(spark, sf), "line", n_estimators=5, max_samples=0.8, contamination=None, features=PRICE_FEATURES, subtree_rows=20_000))


@query(f"""WITH {TRAIL}, t AS (SELECT event_id, {_RULE} AS label FROM trail), c AS (SELECT label, COUNT(*) AS n FROM t GROUP BY 1),
s AS (SELECT SUM(n) AS total, SUM(n) - CEIL(0.2::DOUBLE * SUM(n)) AS train FROM c)
SELECT t::INTEGER AS trial_id, CEIL(0.2::DOUBLE * (SELECT total FROM s))::BIGINT AS n, TRUE AS f1_fits, TRUE AS in_space FROM (SELECT unnest(range(15)) AS t)""")
def trial_search_sizes(spark, sf):
    """Each trial of the search judges the held-out fifth; its f1 is that of its precision and recall."""
    found = trial_search(spark, sf)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    low, high = MONTHLY_SEARCH.n_estimators
    return found.select("trial_id", "n", (F.abs(f1 - F.col("f1")) < 1e-9).alias("f1_fits"),
                        (F.col("n_estimators").between(low, high) & F.col("max_samples").isin(MONTHLY_SEARCH.max_samples)).alias("in_space"))


@query("""SELECT event_id, TRUE AS sign_fits FROM (SELECT 'e' || event_id AS event_id FROM events)""")
def stream_forest_rows(spark, sf):
    """Every event of the stream is scored once, and its prediction is the sign of its score."""
    found = stream_forest_scores(spark, sf)
    return found.select("event_id", ((F.col("score") < 0) == (F.col("prediction") == -1)).alias("sign_fits"))


@query()
def forest_on_features(spark, sf):
    """The 18-feature table of the trail: fit, score, name, count by label."""
    rows = store(labelled_features(spark, sf))
    scored = iforest.fit_and_score(rows, "event_id")[1].withColumn("outcome", iforest.anomaly_name())
    return scored.groupBy("outcome", LABEL).agg(F.count("*").alias("n"))


@query()
def trial_search(spark, sf):
    """The monthly search on the feature table; the forests of trials that share their sample size are shared."""
    rows = store(labelled_features(spark, sf))
    return search_trials(rows, "event_id", draw_trials(MONTHLY_SEARCH))


@query()
def federated_training(spark, sf):
    """Two nodes, shared threshold, ten rounds."""
    nodes = split.node_split(store(labelled_features(spark, sf)), "event_source", "event_id")
    return federated_rounds(nodes, "event_id")[1]


# Streams -------------------------------------------------------------------------------------------------------


def _work(spark: SparkSession) -> str:
    fresh = spark.range(1).select(F.expr("uuid()").alias("u")).first()["u"]
    return f"{shared_dir(spark).rstrip('/')}/stream-{fresh}"


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'signup')")
def stream_idempotent_log(spark, sf):
    """The events as a stream; the log keeps each flagged event once, also when a batch runs again."""
    out = _work(spark)
    schema = "event_id bigint, event_type string, value double"

    def process(batch, batch_id):
        flagged = batch.filter(F.col("event_type").isin("error", "signup")).select("event_id", "event_type", "value")
        for _ in range(2):      # the second pass is the replay of the batch
            log = read_batches(spark, f"{out}/log", schema, batch_id)
            write_batch(upsert.rows_to_insert(log, flagged, "event_id", F.col("value")), f"{out}/log", batch_id)

    start(_event_stream(spark, sf), process, f"{out}/checkpoint").awaitTermination()
    return read_batches(spark, f"{out}/log", schema)


@query("""SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS n FROM events
WHERE time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' <= (SELECT MAX(ts) - INTERVAL '10 minutes' FROM events) GROUP BY 1""")
def stream_flagged_counts(spark, sf):
    """Five-minute counts of a stream: the windows that the watermark has closed."""
    from logsieve.streaming.monitoring import start_flagged_counts

    out = _work(spark)
    stream = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    start_flagged_counts(stream, "ts", f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    counts = spark.read.schema("window_start timestamp, window_end timestamp, n bigint").parquet(f"{out}/counts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("""WITH RECURSIVE t AS (SELECT event_type, user_id % 4 AS shard, ts FROM events),
c AS (SELECT event_type, shard, MIN(ts) AS ts FROM t GROUP BY 1, 2
  UNION ALL SELECT c.event_type, c.shard, (SELECT MIN(t.ts) FROM t WHERE t.event_type = c.event_type AND t.shard = c.shard
    AND t.ts >= c.ts + INTERVAL '4 hours') AS ts FROM c WHERE c.ts IS NOT NULL)
SELECT event_type, shard, ts FROM c WHERE ts IS NOT NULL""")
def stream_alerts(spark, sf):
    """Alerts as a stream: the last time sent of a group is state."""
    from logsieve.streaming.monitoring import start_alerts

    out = _work(spark)
    alerts = _event_stream(spark, sf).select("event_type", (F.col("user_id") % 4).alias("shard"), "ts")
    start_alerts(spark, alerts, ["event_type", "shard"], "ts", out, f"{out}/checkpoint").awaitTermination()
    return read_batches(spark, f"{out}/sent", alerts.schema)


@query("""SELECT user_id::VARCHAR AS message_id, COUNT(*)::INTEGER AS attempts FROM events WHERE event_type = 'error' GROUP BY 1 HAVING COUNT(*) >= 3""")
def stream_dead_letters(spark, sf):
    """Failures as a stream of files: messages that failed three times or more are dead letters."""
    from logsieve.streaming.retries import add_failures, dead_letter_table, start_retries

    out = _work(spark)
    errors = table(spark, sf, "events").filter(F.col("event_type") == "error")
    add_failures(errors.select(F.col("user_id").cast("string").alias("message_id"), F.col("props").alias("raw")), f"{out}/failures", "scoring-0")
    running = start_retries(spark, out, f"{out}/checkpoint", every="1 second", retry_after=86_400)
    try:
        while not any(p.numInputRows for p in running.recentProgress) and running.isActive:
            running.awaitTermination(1)
    finally:
        running.stop()
    if running.exception() is not None:
        raise running.exception()
    return dead_letter_table(spark, out).select("message_id", "attempts")


@query()
def stream_forest_scores(spark, sf):
    """A stream of events scored with a forest that was fitted on the same features in a batch."""
    out = _work(spark)
    model = iforest.fit_forest(store(labelled_features(spark, sf)), "event_id")
    schema = "event_id string, score double, prediction int"

    def process(batch, batch_id):
        rows = features(trail_of(batch), CANONICAL, FLAT, keep=("event_id",))
        write_batch(iforest.score_forest(rows, model).select("event_id", "score", "prediction"), f"{out}/scored", batch_id)

    start(_event_stream(spark, sf), process, f"{out}/checkpoint").awaitTermination()
    return read_batches(spark, f"{out}/scored", schema)
