"""Synthetic feature table with a routine and an attack regime, derived row by row from a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.schema import FEATURES, LABEL

# Per feature either ("p", chance of 1), ("r", low, high exclusive) or ("c", choices).
ROUTINE = {
    "is_error": ("p", 0.03), "is_root": ("p", 0.005), "hour": ("r", 8, 18), "day_of_week": ("r", 0, 5),
    "is_mgmt_event": ("p", 0.7), "is_read_only": ("p", 0.6), "user_agent_len": ("r", 20, 80),
    "req_params_len": ("r", 10, 200), "resp_elements_len": ("r", 50, 500), "event_source_enc": ("r", 0, 8),
    "event_name_enc": ("r", 0, 50), "region_enc": ("r", 0, 5), "identity_type_enc": ("c", [1, 2]),
    "mfa_auth": ("p", 0.7), "is_console": ("p", 0.2), "access_key_len": ("r", 16, 20),
    "src_ip_private": ("p", 0.6), "event_version_major": ("c", [1]),
}
ATTACK = {
    "is_error": ("p", 0.6), "is_root": ("p", 0.5), "hour": ("c", [0, 1, 2, 3, 4, 5, 22, 23]),
    "day_of_week": ("r", 0, 7), "is_mgmt_event": ("c", [1]), "is_read_only": ("c", [0]),
    "user_agent_len": ("r", 0, 15), "req_params_len": ("r", 500, 2000), "resp_elements_len": ("r", 0, 50),
    "event_source_enc": ("r", 0, 8), "event_name_enc": ("r", 50, 100), "region_enc": ("r", 5, 10),
    "identity_type_enc": ("c", [0, 3]), "mfa_auth": ("c", [0]), "is_console": ("p", 0.5),
    "access_key_len": ("r", 0, 5), "src_ip_private": ("c", [0]), "event_version_major": ("c", [1]),
}


def _draw(rule: tuple, seed: int, name: str) -> Column:
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(2**40)) / F.lit(float(2**40))
    if rule[0] == "p":
        return (u < rule[1]).cast("float")
    if rule[0] == "r":
        return F.floor(rule[1] + u * (rule[2] - rule[1])).cast("float")
    choices = F.array(*[F.lit(float(v)) for v in rule[1]])
    return F.get(choices, F.floor(u * len(rule[1])).cast("int")).cast("float")


def synthetic_trail(spark: SparkSession, n_normal: int = 10_000, n_anomaly: int = 1_000,
                    seed: int = 42) -> DataFrame:
    """`event_id`, the 18 features and the label; the same rows for any number of partitions."""

    def regime(n: int, rules: dict, label: int, prefix: str) -> DataFrame:
        return spark.range(n).select(
            F.concat(F.lit(prefix), F.col("id").cast("string")).alias("event_id"),
            *[_draw(rules[f], seed + label, f).alias(f) for f in FEATURES],
            F.lit(label).cast("tinyint").alias(LABEL),
        )

    return regime(n_normal, ROUTINE, 0, "n").unionByName(regime(n_anomaly, ATTACK, 1, "a"))
