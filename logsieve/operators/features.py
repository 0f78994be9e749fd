"""The 18-column feature table.

Three places of the pipeline compute the same columns with small differences; `Dialect` names each difference as
a switch and `CANONICAL` is the default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.scalars import (
    has_private_prefix, is_private_ip, iso_timestamp, json_len, md5_mod, non_empty, printed_json, text,
)
from logsieve.schema import FEATURES

CATEGORICAL = ["event_source", "event_name", "region", "identity_type"]

# Where each logical member sits in a nested event.
CLOUDTRAIL = {
    "event_id": "eventID", "event_time": "eventTime", "event_name": "eventName", "event_source": "eventSource",
    "region": "awsRegion", "error_code": "errorCode", "identity_type": "userIdentity.type",
    "principal": "userIdentity.arn", "user_name": "userIdentity.userName",
    "access_key": "userIdentity.accessKeyId",
    "mfa": "userIdentity.sessionContext.attributes.mfaAuthenticated",
    "management_event": "managementEvent", "read_only": "readOnly",
    "request_parameters": "requestParameters", "response_elements": "responseElements",
    "user_agent": "userAgent", "source_ip": "sourceIPAddress", "event_version": "eventVersion",
    "event_type": "eventType",
}
# A table that has the logical members as columns already; members it lacks count as missing.
FLAT = {name: name for name in CLOUDTRAIL}


@dataclass(frozen=True)
class Dialect:
    name: str
    management_default: bool = False
    identity_default: str = ""
    capped: bool = True
    empty_json_len: int = 0
    printed_as: str = "json"          # "json" counts \uXXXX escapes, "repr" counts characters
    encode: str = "hash"              # "hash" or "dictionary" (then fitted later over all sources)
    weekday: str = "event"            # "event" or "zero"
    bad_time_weekday: int = 0
    mfa_any_case: bool = True
    console_by: str = "agent"         # "agent" or "type"
    private_by: str = "range"         # "range" or "prefix"
    hour_by: str = "time"             # "time" or "characters" 11 to 13 of the text, whatever its end looks like


CANONICAL = Dialect("canonical")
OFFLINE = Dialect("offline", management_default=True, identity_default="Unknown", capped=False,
                  printed_as="repr", encode="dictionary", bad_time_weekday=3, console_by="type")
TRAIN = Dialect("train", mfa_any_case=False, private_by="prefix")
SERVE = Dialect("serve", empty_json_len=2, weekday="zero", mfa_any_case=False, private_by="prefix",
                hour_by="characters")


def member_columns(df: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> dict[str, Column]:
    """Logical member to column; a member whose top-level column is absent is a null."""
    present = set(df.columns)
    kinds = {"management_event": "boolean", "read_only": "boolean"}
    return {
        name: F.col(path) if path.split(".")[0] in present else F.lit(None).cast(kinds.get(name, "string"))
        for name, path in layout.items()
    }


def event_timestamp(df: DataFrame, layout: dict[str, str] = CLOUDTRAIL) -> Column:
    """The event time as a timestamp, whether the table has text or a timestamp; null when it does not parse."""
    path = layout["event_time"]
    if path in df.columns and df.schema[path].dataType.typeName().startswith("timestamp"):
        return F.col(path)
    return iso_timestamp(path)


def _capped(c: Column, limit: int, dialect: Dialect) -> Column:
    return F.least(c, F.lit(limit)) if dialect.capped else c


def _document_len(c: Column, dialect: Dialect, compact: bool) -> Column:
    # A length that is counted on the printed value counts the two brackets of an empty document.
    blank = ["", "null", '""'] + ["{}", "[]"] * (dialect.printed_as == "json")
    empty = c.isNull() | F.trim(c).isin(*blank)
    n = json_len(c, compact=compact, ascii_escapes=dialect.printed_as == "json")
    return _capped(F.when(empty, dialect.empty_json_len).otherwise(n), 5000, dialect)


def _hour(df: DataFrame, ts: Column, dialect: Dialect, layout: dict[str, str]) -> Column:
    path = layout["event_time"]
    if dialect.hour_by == "time" or path in df.columns and df.schema[path].dataType.typeName() != "string":
        return F.hour(ts)
    return F.substring(F.col(path), 12, 2).try_cast("int")


def feature_columns(df: DataFrame, dialect: Dialect = CANONICAL, layout: dict[str, str] = CLOUDTRAIL,
                    compact_json: bool = False) -> dict[str, Column]:
    """Feature name to column expression, all of them built-in expressions over one row."""
    m = member_columns(df, layout)
    ts = event_timestamp(df, layout)
    identity = F.coalesce(m["identity_type"], F.lit(dialect.identity_default))
    weekday = F.lit(0) if dialect.weekday == "zero" else F.coalesce(F.weekday(ts), F.lit(dialect.bad_time_weekday))
    mfa = F.lower(m["mfa"]) if dialect.mfa_any_case else m["mfa"]
    console = (text(m["user_agent"]).contains("signin.amazonaws.com") if dialect.console_by == "agent"
               else F.coalesce(m["event_type"], F.lit("AwsApiCall")) == "AwsConsoleSignIn")
    private = is_private_ip(m["source_ip"]) if dialect.private_by == "range" else has_private_prefix(m["source_ip"])
    categories = {"event_source": text(m["event_source"]), "event_name": text(m["event_name"]),
                  "region": text(m["region"]), "identity_type": identity}
    columns = {
        "is_error": (text(m["error_code"]) != "").cast("int"),
        "is_root": (identity == "Root").cast("int"),
        "hour": F.coalesce(_hour(df, ts, dialect, layout), F.lit(0)),
        "day_of_week": weekday,
        "is_mgmt_event": F.coalesce(m["management_event"], F.lit(dialect.management_default)).cast("int"),
        "is_read_only": F.coalesce(m["read_only"], F.lit(False)).cast("int"),
        "user_agent_len": _capped(F.length(text(m["user_agent"])), 500, dialect),
        "req_params_len": _document_len(m["request_parameters"], dialect, compact_json),
        "resp_elements_len": _document_len(m["response_elements"], dialect, compact_json),
        "mfa_auth": F.coalesce((mfa == "true").cast("int"), F.lit(0)),
        "is_console": console.cast("int"),
        "access_key_len": _capped(F.length(text(m["access_key"])), 100, dialect),
        "src_ip_private": private,
        "event_version_major":
            F.split_part(F.coalesce(m["event_version"], F.lit("1.0")), F.lit("."), F.lit(1)).try_cast("int"),
    }
    for name, c in categories.items():
        if dialect.encode == "hash":
            columns[f"{name}_enc"] = md5_mod(c)
        else:
            columns[f"{name}_raw"] = c
    return columns


def flatten_events(df: DataFrame, dialect: Dialect = CANONICAL, layout: dict[str, str] = CLOUDTRAIL,
                   keep: tuple[str, ...] = (), compact_json: bool = False, drop_failed: bool = True) -> DataFrame:
    """All features of each event in one projection, plus the columns in `keep`.

    The only feature that can fail is the version number; `drop_failed` leaves such rows out.
    """
    columns = feature_columns(df, dialect, layout, compact_json)
    out = df.select(*keep, *[c.alias(name) for name, c in columns.items()])
    return out.filter(F.col("event_version_major").isNotNull()) if drop_failed else out


def features(df: DataFrame, dialect: Dialect = CANONICAL, layout: dict[str, str] = CLOUDTRAIL,
             keep: tuple[str, ...] = (), compact_json: bool = False) -> DataFrame:
    """Feature table ready for the model: hash-coded categories, fixed order, float columns."""
    if dialect.encode != "hash":
        raise ValueError("dictionary codes are fitted over all sources: use flatten_events and encode")
    return conform(flatten_events(df, dialect, layout, keep, compact_json), keep=keep)


def conform(df: DataFrame, columns: list[str] = FEATURES, keep: tuple[str, ...] = (),
            label: str | None = None) -> DataFrame:
    """The feature columns in contract order as floats: absent columns, nulls and non-numbers become 0."""
    def one(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0).cast("float").alias(name)
        return F.coalesce(F.col(name).try_cast("float"), F.lit(0).cast("float")).alias(name)

    out = [*keep, *[one(c) for c in columns]]
    if label:
        out.append(F.coalesce(F.col(label), F.lit(0)).cast("tinyint").alias(label))
    return df.select(*out)


def missing_columns(df: DataFrame, columns: list[str] = FEATURES) -> list[str]:
    """Contract columns the table lacks; reads the schema only."""
    return [c for c in columns if c not in df.columns]


def feature_vector(columns: list[str] = FEATURES) -> Column:
    return F.array(*[F.col(c).cast("float") for c in columns])


# Derived text --------------------------------------------------------------------------------------------------


def _params(c: Column, limit: int, compact: bool) -> Column:
    """The parameters as printed JSON, cut to the length the summary line shows."""
    return F.substring(F.coalesce(non_empty(printed_json(c, compact)), F.lit("{}")), 1, limit)


def change_line(m: dict[str, Column], time_text: Column, compact: bool = False) -> Column:
    """`name on params by arn at time`."""
    return F.format_string("%s on %s by %s at %s", m["event_name"], _params(m["request_parameters"], 200, compact),
                           F.coalesce(m["principal"], F.lit("unknown")), time_text)


def change_summary(m: dict[str, Column], time_text: Column, compact: bool = False) -> Column:
    """`[time] name on source in region by principal. Params: ...`, the text that is embedded and shown."""
    principal = F.coalesce(non_empty(m["principal"]), non_empty(m["user_name"]), m["identity_type"], F.lit("Unknown"))
    return F.format_string(
        "[%s] %s on %s in %s by %s. Params: %s", time_text, m["event_name"],
        F.coalesce(m["event_source"], F.lit("?")), F.coalesce(m["region"], F.lit("?")), principal,
        _params(m["request_parameters"], 500, compact))


def change_document(m: dict[str, Column], time_text: Column, compact: bool = False) -> Column:
    """`name at time by user via source in region: params`."""
    return F.concat(m["event_name"], F.lit(" at "), time_text,
                    F.lit(" by "), F.coalesce(m["user_name"], F.lit("unknown")),
                    F.lit(" via "), text(m["event_source"]), F.lit(" in "), text(m["region"]),
                    F.lit(": "), _params(m["request_parameters"], 300, compact))


def changed_resource(params: Column) -> Column:
    """First member of the parameters that names the resource."""
    names = ["resourceArn", "stackName", "functionName", "bucketName"]
    return F.coalesce(*[non_empty(F.get_json_object(params, f"$.{n}")) for n in names])


def retrieval_query(m: dict[str, Column]) -> Column:
    """The parts of an event that are worth searching for, joined by blanks."""
    return F.concat_ws(" ", non_empty(m["event_name"]), non_empty(m["event_source"]), non_empty(m["error_code"]))
