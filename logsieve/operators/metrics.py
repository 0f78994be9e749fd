"""Binary metrics, weighted averages over nodes, choice of the best trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(df: DataFrame, truth: Column | str, predicted: Column | str, by: list[str] | None = None,
                   ) -> DataFrame:
    """Precision, recall and f1 of the positive class; a zero denominator gives 0. One pass, three counters."""
    truth = F.col(truth) if isinstance(truth, str) else truth
    predicted = F.col(predicted) if isinstance(predicted, str) else predicted
    counted = df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if((truth == 1) & (predicted == 1)).alias("tp"),
        F.count_if((truth == 0) & (predicted == 1)).alias("fp"),
        F.count_if((truth == 1) & (predicted == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        *(by or []), "n",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def predicted_anomaly(prediction: Column | str = "prediction") -> Column:
    """1 where the model says -1."""
    return (F.col(prediction) == -1 if isinstance(prediction, str) else prediction == -1).cast("int")


def weighted_average(df: DataFrame, weight: str, metrics: list[str], by: list[str] | None = None,
                     missing_as_zero: bool = True) -> DataFrame:
    """Averages weighted by row counts; no rows give 0.

    A metric that a node did not report counts as 0, or, with `missing_as_zero` off, leaves that node out of the
    average of that metric (and gives null when no node reports it).
    """
    def one(m: str) -> Column:
        total = F.sum(F.col(weight) * F.col(m))
        if missing_as_zero:
            return _ratio(total, F.sum(weight)).alias(m)
        return F.try_divide(total, F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m)

    return df.groupBy(*(by or [])).agg(*[one(m) for m in metrics])


def average_parameters(df: DataFrame, weight: str, parameter: str, by: list[str] | None = None) -> DataFrame:
    """Global parameter: the mean of the node parameters weighted by rows."""
    return weighted_average(df, weight, [parameter], by, missing_as_zero=False)


def best_trial(trials: DataFrame, objective: str = "f1", trial_id: str = "trial_id",
               goal: float | None = None) -> DataFrame:
    """The trial with the highest objective, ties to the lowest id.

    With a goal, trials after the first one that reaches it do not count: the search would have stopped there.
    """
    row = F.struct(*[F.col(c) for c in trials.columns])
    highest = F.max_by(row, F.struct(F.col(objective), -F.col(trial_id)))
    best = highest
    if goal is not None:
        # All trials before the first that reaches the goal are below it, so that first one is the best so far.
        best = F.coalesce(F.min_by(row, F.when(F.col(objective) >= goal, F.col(trial_id))), highest)
    return (
        trials.filter(F.col(objective).isNotNull()).agg(best.alias("best")).filter("best is not null").select("best.*")
    )


def round_metrics(node_rows: DataFrame, round_column: str = "round", weight: str = "n") -> DataFrame:
    """One row per round: weighted train and evaluation metrics, loss and the number of nodes."""
    averaged = weighted_average(node_rows, weight, ["train_f1", "eval_f1", "eval_precision", "eval_recall"],
                                [round_column], missing_as_zero=False)
    clients = node_rows.groupBy(round_column).agg(F.count("*").alias("num_clients"))
    return (
        averaged.join(clients, round_column)
        .withColumn("eval_loss", 1.0 - F.col("eval_f1"))
    )
