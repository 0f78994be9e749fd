"""Label rates per source and the quality gate of the feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.features import missing_columns
from logsieve.schema import FEATURES, LABEL

# Bounds of the gate.
MIN_ROWS = 100_000
MIN_NODE_ROWS = 1_000
ANOMALY_RATE = (0.03, 0.30)


def anomaly_rate(df: DataFrame, source: str, label: str = LABEL) -> DataFrame:
    """Rows and label rate per source, with a total row whose source is null."""
    return df.rollup(source).agg(
        F.count("*").alias("n"),
        F.sum(label).cast("bigint").alias("n_anomaly"),
        F.avg(label).alias("rate"),
    )


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of the sources that have any, tagged with the name of their source."""
    filled = [(name, df) for name, df in sources.items() if not df.isEmpty()]
    if not filled:
        raise ValueError("no source has any row")
    tagged = [df.withColumn("source", F.lit(name)) for name, df in filled]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _check(name: str, observed, low, high):
    """One row of the report: passes when low <= observed <= high, an absent bound is open."""
    observed = observed.cast("double")
    ok = F.lit(True)
    if low is not None:
        ok = ok & (observed >= F.lit(float(low)))
    if high is not None:
        ok = ok & (observed <= F.lit(float(high)))
    return F.struct(
        F.lit(name).alias("check"), observed.alias("observed"),
        F.lit(None if low is None else float(low)).cast("double").alias("lower"),
        F.lit(None if high is None else float(high)).cast("double").alias("upper"),
        F.coalesce(ok, F.lit(False)).alias("passed"),
    )


def _report(aggregated: DataFrame, checks: list) -> DataFrame:
    return aggregated.select(F.explode(F.array(*checks)).alias("row")).select("row.*")


def quality_report(df: DataFrame, min_rows: int = MIN_ROWS, columns: list[str] = FEATURES,
                   label: str = LABEL) -> DataFrame:
    """One row per check of the full table, from a single aggregation over it."""
    present = [c for c in columns if c in df.columns]
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in present], F.lit(0))

    def outside(c, rule):
        return F.count_if(~F.coalesce(rule, F.lit(False))) if c in df.columns else F.lit(0)

    aggregated = df.agg(
        F.count("*").alias("rows"),
        F.avg(label).alias("rate"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"),
        outside("hour", F.col("hour").between(0, 23)).alias("hour"),
        outside("day_of_week", F.col("day_of_week").between(0, 6)).alias("day_of_week"),
        outside("is_error", F.col("is_error").isin(0, 1)).alias("is_error"),
        outside("is_root", F.col("is_root").isin(0, 1)).alias("is_root"),
        outside(label, F.col(label).isin(0, 1)).alias("label_domain"),
    )
    return _report(aggregated, [
        _check("row_count", F.col("rows"), min_rows, None),
        _check("anomaly_rate", F.col("rate"), *ANOMALY_RATE),
        _check("null_features", F.col("nulls"), None, 0),
        _check("missing_columns", F.lit(len(missing_columns(df, columns))), None, 0),
        _check("hour_out_of_range", F.col("hour"), None, 0),
        _check("day_of_week_out_of_range", F.col("day_of_week"), None, 0),
        _check("is_error_not_binary", F.col("is_error"), None, 0),
        _check("is_root_not_binary", F.col("is_root"), None, 0),
        _check("label_not_binary", F.col("label_domain"), None, 0),
    ])


def node_report(nodes: DataFrame, names: list[str], min_rows: int = MIN_NODE_ROWS,
                columns: list[str] = FEATURES, label: str = LABEL) -> DataFrame:
    """The same for the node datasets; a node without rows fails its row count."""
    present = [c for c in columns if c in nodes.columns]
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in present], F.lit(0))
    checks, aggregates = [], []
    for n in names:
        here = F.col("node") == n
        aggregates += [
            F.count_if(here).alias(f"{n}_rows"),
            F.count_if(here & ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias(f"{n}_label"),
            F.coalesce(F.sum(F.when(here, nulls)), F.lit(0)).alias(f"{n}_nulls"),
        ]
        checks += [
            _check(f"{n}_row_count", F.col(f"{n}_rows"), min_rows, None),
            _check(f"{n}_label_not_binary", F.col(f"{n}_label"), None, 0),
            _check(f"{n}_null_features", F.col(f"{n}_nulls"), None, 0),
        ]
    return _report(nodes.agg(*aggregates), checks)


def verdict(report: DataFrame) -> DataFrame:
    """Number of failed checks; 0 lets the next step run."""
    return report.agg(F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("checks"))
