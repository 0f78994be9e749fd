"""Labels, change filters, thresholds and domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.scalars import text
from logsieve.schema import (
    ATTACK_ERROR_CODES, ATTACK_EVENT_NAMES, CHANGE_VERBS, DECISIONS, FEATURES, STAGES, feature_hash,
)


def rule_label(error_code: Column, event_name: Column, identity_type: Column) -> Column:
    """1 when the error code or the name is on its list or the caller is Root; null members match nothing."""
    hit = (text(error_code).isin(ATTACK_ERROR_CODES) | text(event_name).isin(ATTACK_EVENT_NAMES)
           | (text(identity_type) == "Root"))
    return hit.cast("tinyint")


def constant_label(value: int = 1) -> Column:
    return F.lit(value).cast("tinyint")


def self_label(is_error: Column | str = "is_error") -> Column:
    """The error flag as its own label. It leaks a feature into the label; use it only to compare."""
    return (F.col(is_error) if isinstance(is_error, str) else is_error).cast("tinyint")


def is_infra_change(management: Column, read_only: Column, event_name: Column) -> Column:
    """A management event that writes and whose name opens with a change verb."""
    verbs = "|".join(CHANGE_VERBS)
    return (F.coalesce(management, F.lit(False)) & ~F.coalesce(read_only, F.lit(True))
            & text(event_name).rlike(f"(?i)^({verbs})"))


def is_named_change(event_name: Column, names: list[str]) -> Column:
    return text(event_name).isin(names)


def flag_below(df: DataFrame, threshold: float = -0.1, score: str = "score") -> DataFrame:
    """Rows whose score is strictly below the threshold."""
    return df.filter(F.col(score) < threshold)


def source_matches(source: Column, pattern: str) -> Column:
    return F.coalesce(source.rlike(f"(?i){pattern}"), F.lit(False))


def since(ts: Column, start: Column) -> Column:
    return ts > start


def split_by_rule(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy a rule, and the quarantine: rows that do not, or for which it is unknown."""
    known = F.coalesce(rule, F.lit(False))
    return df.filter(known), df.filter(~known)


def valid_decision(decision: Column) -> Column:
    """Like a CHECK constraint: a null decision passes."""
    return decision.isNull() | decision.isin(DECISIONS)


def valid_dimension(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim)


def valid_stage(stage: Column) -> Column:
    return stage.isin(STAGES)


class SchemaDriftError(ValueError):
    """The table or model does not follow the feature contract."""


def check_feature_schema(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Fail before any row is scored when a feature is absent or not numeric."""
    numeric = {"float", "double", "integer", "long", "short", "byte", "decimal"}
    types = {f.name: f.dataType.typeName().split("(")[0] for f in df.schema.fields}
    missing = [c for c in columns if c not in types]
    wrong = [c for c in columns if c in types and types[c] not in numeric]
    if missing or wrong:
        raise SchemaDriftError(f"missing features {missing}, non-numeric features {wrong}")
    return df


def check_vector_arity(df: DataFrame, vector: str, n: int = len(FEATURES)) -> tuple[DataFrame, DataFrame]:
    """Vectors the model accepts, and those of a wrong length or with a missing member."""
    v = F.col(vector)
    return split_by_rule(df, (F.size(v) == n) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def check_drift(registered_hash: str | None, columns: list[str] = FEATURES) -> str:
    """Compare the registered feature hash with ours: `unknown` and `unset` go on, a difference stops."""
    if registered_hash is None:
        return "unknown"
    if registered_hash == "":
        return "unset"
    if registered_hash != feature_hash(columns):
        raise SchemaDriftError(f"model was trained on other features: {registered_hash[:12]}")
    return "equal"
