"""Training: trial search, fit and evaluation, registry, and the ordered run that ends with the watermark."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators.features import CANONICAL, CLOUDTRAIL, Dialect, conform, features, member_columns
from logsieve.operators.forest import Forest, decide, fit_forest, score_samples
from logsieve.operators.labels import check_drift, rule_label, valid_stage
from logsieve.operators.metrics import best_trial, binary_metrics, predicted_anomaly
from logsieve.operators.quantiles import exact_quantiles
from logsieve.operators.split import stratified_split
from logsieve.operators.upsert import last_per_key
from logsieve.plans.journal import Journal
from logsieve.schema import FEATURES, LABEL, STAGES, feature_hash
from logsieve.sources.json_logs import scan_since
from logsieve.sources.tables import advance_watermark, get_state, read_or_empty
from logsieve.session import materialise, store

# Trial search --------------------------------------------------------------------------------------------------

MAX_FAILED_TRIALS = 5       # fixed value: the allowance of both search spaces
SIDE_BY_SIDE = 3            # fixed value: trials that run at the same time
TRIALS = "trial_id int, n_estimators int, contamination double, max_samples string"


@dataclass(frozen=True)
class SearchSpace:
    """Bounds of a random search; `max_samples` is a list of choices or a (low, high) range."""

    trials: int
    goal: float
    n_estimators: tuple[int, int]
    contamination: tuple[float, float]
    max_samples: tuple | list


# The two search spaces in use.
MONTHLY_SEARCH = SearchSpace(15, 0.95, (50, 300), (0.01, 0.15), ["auto", "0.5", "0.8"])
WIDE_SEARCH = SearchSpace(20, 0.85, (50, 400), (0.01, 0.20), (0.5, 1.0))


def draw_trials(space: SearchSpace, seed: int = 42) -> list[tuple]:
    """Random parameter sets as `(trial_id, n_estimators, contamination, max_samples)`."""
    rng = random.Random(seed)
    out = []
    for i in range(space.trials):
        samples = (rng.choice(space.max_samples) if isinstance(space.max_samples, list)
                   else repr(round(rng.uniform(*space.max_samples), 4)))
        out.append((i, rng.randint(*space.n_estimators), rng.uniform(*space.contamination), samples))
    return out


def search_trials(df: DataFrame, key: str, trials: list[tuple], label: str = LABEL, seed: int = 42,
                  features_used: list[str] = FEATURES, max_failed: int = MAX_FAILED_TRIALS) -> DataFrame:
    """Metrics of every trial on the held-out part: `trial_id, parameters, n, precision, recall, f1`.

    With one seed, tree i of two trials with equal `max_samples` is the same tree. So one forest with the most trees
    is fitted per `max_samples`, side by side, each row is scored once with all of its tree prefixes, and a trial only
    adds a threshold and three counters. A trial that fails has no metrics; more than `max_failed` of them end the search.
    """
    spark = df.sparkSession
    # Equal rows of a partition lie together: they are scored once.
    split = store(stratified_split(df, key, label, 0.2, seed).sortWithinPartitions(*features_used))

    def judge(samples: str) -> DataFrame:
        mine = [t for t in trials if t[3] == samples]
        prefixes = sorted({t[1] for t in mine})
        forest = fit_forest(split.filter("is_train"), key, max(prefixes), samples, None, seed, features_used)
        scored = score_samples(split, forest, prefixes, "_scores").select(
            "is_train", F.col(label).cast("int").alias("_y"), "_scores").persist()
        # One search for the thresholds of all trials: every prefix is a group of its own.
        trained = scored.filter("is_train").select(F.posexplode("_scores").alias("at", "v"))
        asked = sorted({t[2] for t in mine})
        cuts = {(prefixes[r["at"]], r["quantile"]): r["value"] for r in exact_quantiles(trained, "v", asked, "at").collect()}
        rows = [(t[0], prefixes.index(t[1]), cuts[(t[1], t[2])]) for t in mine]
        table = F.array(*[F.struct(F.lit(t).alias("trial_id"), F.lit(i).alias("at"), F.lit(cut).alias("cut"))
                          for t, i, cut in rows])
        judged = (
            scored.filter("not is_train").select("_y", "_scores", F.explode(table).alias("t"))
            .select("t.trial_id", "_y", (F.col("_scores")[F.col("t.at")] < F.col("t.cut")).cast("int").alias("_p"))
        )
        found = materialise(binary_metrics(judged, "_y", "_p", ["trial_id"]))
        scored.unpersist()
        return found

    choices = sorted({t[3] for t in trials})
    out, failed, error = None, 0, None
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        for samples, job in [(c, pool.submit(judge, c)) for c in choices]:
            try:
                part = job.result()
                out = part if out is None else out.unionByName(part)
            except Exception as e:      # whatever ends a trial counts as its failure
                failed, error = failed + sum(t[3] == samples for t in trials), e
    if out is None or failed > max_failed:
        raise RuntimeError(f"{failed} of {len(trials)} trials failed") from error
    return spark.createDataFrame(trials, TRIALS).join(out, "trial_id", "left")


def best_parameters(trials: DataFrame, space: SearchSpace) -> DataFrame:
    """One row: the best trial, not counting those after the first that reached the goal."""
    return best_trial(trials, "f1", "trial_id", space.goal)


def write_best_parameters(best: DataFrame, path: str) -> None:
    best.limit(1).write.mode("overwrite").parquet(path)


# Fit and evaluation --------------------------------------------------------------------------------------------


def train_and_evaluate(df: DataFrame, key: str, n_estimators: int = 100, contamination: float = 0.08,
                       max_samples: str | float = "auto", seed: int = 42, label: str = LABEL,
                       ) -> tuple[Forest, DataFrame]:
    """Fit on 80 % of every label, measure on the rest."""
    split = stratified_split(df, key, label, 0.2, seed)
    forest = fit_forest(split.filter("is_train"), key, n_estimators, max_samples, contamination, seed)
    held_out = decide(score_samples(split.filter("not is_train"), forest), forest)
    return forest, binary_metrics(held_out, label, predicted_anomaly())


# Registry ------------------------------------------------------------------------------------------------------

REGISTRY = ("name string, version string, run_id string, f1 double, precision double, recall double, "
            "n_estimators int, models string, feature_hash string, registered_at timestamp")
STAGE_EVENTS = "name string, version string, stage string, at timestamp"
RUNS = ("run_id string, experiment string, status string, start_time bigint, f1 double, precision double, "
        "recall double")


def schema_document(spark: SparkSession, version: str, columns: list[str] = FEATURES,
                    dialect: Dialect = CANONICAL) -> DataFrame:
    """One row: version, feature names, their number, their hash and the dialect that computes them."""
    return spark.range(1).select(
        F.lit(version).alias("version"), F.array(*[F.lit(c) for c in columns]).alias("features"),
        F.lit(len(columns)).alias("count"), F.lit(feature_hash(columns)).alias("hash"),
        F.lit(dialect.name).alias("dialect"))


class ModelRegistry:
    """Models as tables under one root: nodes by version, one registry row per version, stage events."""

    def __init__(self, spark: SparkSession, root: str, name: str = "forest"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name

    def register(self, forest: Forest, version: str, metrics: DataFrame | None = None,
                 dialect: Dialect = CANONICAL, run_id: str | None = None) -> None:
        """Write nodes and schema document first and the registry row last, so a listed version is complete."""
        forest.nodes.write.mode("overwrite").parquet(f"{self.root}/nodes/version={version}")
        schema_document(self.spark, version, forest.features, dialect).coalesce(1).write.mode("overwrite").json(
            f"{self.root}/schema/version={version}")
        found = metrics.first().asDict() if metrics is not None else {}
        models = json.dumps({"samples": forest.samples, "offsets": forest.offsets, "by": forest.by})
        row = (self.name, version, run_id, found.get("f1"), found.get("precision"), found.get("recall"),
               forest.n_estimators, models, feature_hash(forest.features))
        kinds = REGISTRY.rsplit(",", 1)[0]
        (self.spark.createDataFrame([row], kinds).withColumn("registered_at", F.current_timestamp())
         .coalesce(1).write.mode("append").parquet(f"{self.root}/registry"))

    def versions(self) -> DataFrame:
        """All versions with their current stage."""
        registry = read_or_empty(self.spark, f"{self.root}/registry", REGISTRY)
        newest = last_per_key(registry, ["name", "version"], F.col("registered_at"))
        return newest.join(current_stages(self.stage_events()), ["name", "version"], "left")

    def stage_events(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/stages", STAGE_EVENTS)

    def has(self, version: str, stage: str | None = None) -> bool:
        """Whether the version is listed, or was ever put in a stage."""
        rows = self.stage_events().filter(F.col("stage") == stage) if stage else read_or_empty(self.spark, f"{self.root}/registry", REGISTRY)
        return not rows.filter((F.col("name") == self.name) & (F.col("version") == version)).isEmpty()

    def promote(self, version: str, stage: str) -> None:
        if stage not in STAGES:
            raise ValueError(f"invalid stage {stage!r}: must be one of {STAGES}")
        (self.spark.createDataFrame([(self.name, version, stage)], "name string, version string, stage string")
         .withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/stages"))

    def latest(self) -> str | None:
        mine = self.versions().filter(F.col("name") == self.name)
        found = mine.agg(F.max_by("version", "registered_at").alias("v")).first()
        return found["v"]

    def serving(self) -> str | None:
        """The version to load: the highest in Production, else the highest of all."""
        row = serving_version(self.versions().filter(F.col("name") == self.name)).first()
        return row["version"] if row else None

    def load(self, version: str, columns: list[str] = FEATURES) -> Forest:
        """The model, after its feature hash was compared with ours."""
        row = self.versions().filter((F.col("name") == self.name) & (F.col("version") == version)).first()
        if row is None:
            raise ValueError(f"no version {version} of {self.name}")
        check_drift(row["feature_hash"], columns)
        models = json.loads(row["models"])
        nodes = self.spark.read.parquet(f"{self.root}/nodes/version={version}")
        return Forest(nodes, models["samples"], row["n_estimators"], list(columns), models["offsets"], models["by"])


def current_stages(events: DataFrame) -> DataFrame:
    """Latest stage per version; events with an unknown stage are ignored."""
    valid = events.filter(valid_stage(F.col("stage")))
    return last_per_key(valid, ["name", "version"], F.col("at")).select("name", "version", "stage")


def serving_version(versions: DataFrame) -> DataFrame:
    """Per name the version to load: in Production first, then the highest version number."""
    number = F.col("version").try_cast("double")
    order = F.struct((F.coalesce(F.col("stage"), F.lit("")) == "Production").cast("int"),
                     F.coalesce(number, F.lit(float("-inf"))), F.col("version"))
    return versions.groupBy("name").agg(F.max_by("version", order).alias("version"),
                                        F.max_by("stage", order).alias("stage"))


def append_run(spark: SparkSession, path: str, run_id: str, experiment: str, status: str, start_ms: int,
               metrics: DataFrame) -> None:
    found = metrics.first().asDict()
    row = (run_id, experiment, status, start_ms, found.get("f1"), found.get("precision"), found.get("recall"))
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)


# The run -------------------------------------------------------------------------------------------------------


def training_run(spark: SparkSession, logs: str, registry: ModelRegistry, state: str, version: str,
                 space: SearchSpace = MONTHLY_SEARCH, index_changes: Callable[[str], None] | None = None,
                 work: str | None = None, seed: int = 42) -> dict:
    """Fetch, features, search, train, register, promote, index changes, and only then advance the watermark.

    A step that raises ends the run: nothing after it happens and a run of another version starts at the old watermark.
    A run of the same version goes on after the last committed step of the journal and publishes once. `index_changes`
    may be called again if it ended without a commit, so it should be an upsert.
    """
    work = work or f"{registry.root}/work"
    journal = Journal(spark, f"{work}/journal", version)
    since = journal.step("since", lambda again: get_state(spark, state, "last_train_ts", "1970-01-01T00:00:00Z"))

    def make_features(again: bool) -> None:
        events = scan_since(spark, logs, since, inclusive=True)
        m = member_columns(events, CLOUDTRAIL)
        labelled = events.withColumn(LABEL, rule_label(m["error_code"], m["event_name"], m["identity_type"]))
        table = features(labelled, CANONICAL, CLOUDTRAIL, keep=("eventID", LABEL))
        conform(table, keep=("eventID",), label=LABEL).write.mode("overwrite").parquet(f"{work}/features/{version}")

    journal.step("features", make_features)
    stored = spark.read.parquet(f"{work}/features/{version}")

    def search(again: bool) -> None:
        trials = search_trials(stored, "eventID", draw_trials(space, seed), LABEL, seed)
        write_best_parameters(best_parameters(trials, space), f"{work}/best/{version}")

    journal.step("search", search)

    def register(again: bool) -> dict:
        best = spark.read.parquet(f"{work}/best/{version}").first()
        forest, metrics = train_and_evaluate(stored, "eventID", best["n_estimators"], best["contamination"],
                                             best["max_samples"], seed)
        metrics = materialise(metrics)
        if not (again and registry.has(version)):
            registry.register(forest, version, metrics)
        return metrics.first().asDict()

    metrics = journal.step("register", register)

    def promote(again: bool) -> None:
        if not (again and registry.has(version, "Production")):
            registry.promote(version, "Production")

    journal.step("promote", promote)
    if index_changes is not None:
        def index(again: bool) -> None:
            index_changes(since)

        journal.step("index", index)
    ended = journal.step("ended", lambda again: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"))

    def advance(again: bool) -> str:
        return advance_watermark(spark, state, at=datetime.fromisoformat(ended))

    return {"since": since, "watermark": journal.step("watermark", advance), **metrics}
