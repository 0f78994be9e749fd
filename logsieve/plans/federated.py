"""Federated rounds: every node fits its own forest, only the decision threshold is shared and averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.operators.forest import fit_forest, score_samples
from logsieve.operators.metrics import average_parameters, binary_metrics, round_metrics
from logsieve.schema import FEATURES, LABEL
from logsieve.session import materialise

ROUNDS = 10
MIN_NODES = 2


def federated_rounds(df: DataFrame, key: str, node: str = "node", rounds: int = ROUNDS, n_estimators: int = 100,
                     contamination: float = 0.08, seed: int = 42, label: str = LABEL,
                     features: list[str] = FEATURES, min_nodes: int = MIN_NODES) -> tuple[DataFrame, DataFrame]:
    """Per node and round the offset and the metrics, and the weighted metrics per round.

    The forests of all nodes are fitted together, keyed by (node, tree). Every round a node refits from the same
    seed, so its own offset is the same each time: training uses that offset, evaluation the average of all nodes,
    weighted by rows. Rows are therefore scored once and the rounds differ in nothing but their number.
    """
    forest = fit_forest(df, key, n_estimators, "auto", contamination, seed, features, by=node)
    if len(forest.samples) < min_nodes:
        raise ValueError(f"{len(forest.samples)} nodes, at least {min_nodes} are needed")
    spark = df.sparkSession
    scored = score_samples(df, forest).select(
        F.col(node).cast("string").alias("node"), F.col(label).cast("int").alias("y"), "score_sample").persist()
    offsets = spark.createDataFrame(list(forest.offsets.items()), "node string, offset double")
    sizes = scored.groupBy("node").agg(F.count("*").alias("n"))
    local = materialise(offsets.join(sizes, "node"))
    shared = F.lit(average_parameters(local, "n", "offset").first()["offset"]).alias("global_offset")

    def judged(cut: str, prefix: str) -> DataFrame:
        rows = scored.join(F.broadcast(local.drop("n")), "node").withColumn("global_offset", shared)
        found = binary_metrics(rows.withColumn("p", (F.col("score_sample") < F.col(cut)).cast("int")), "y", "p", ["node"])
        return found.select("node", *[F.col(c).alias(f"{prefix}_{c}") for c in ("f1", "precision", "recall")])

    per_node = materialise(
        local.withColumn("global_offset", shared)
        .join(judged("offset", "train").select("node", "train_f1"), "node")
        .join(judged("global_offset", "eval"), "node")
    )
    scored.unpersist()
    numbered = per_node.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return numbered, round_metrics(numbered)
