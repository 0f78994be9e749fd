"""Whole jobs on small logs: dataset build, training run, registry, federated rounds, change index and lookup."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logsieve.operators import split
from logsieve.operators.forest import fit_forest, score_forest
from logsieve.operators.labels import SchemaDriftError
from logsieve.plans.changes import build_change_index, change_documents, last_training, lookup_changes, relevant_changes
from logsieve.plans.datasets import build_dataset, feature_table, labelled_constant, labelled_rule, require_passed
from logsieve.plans.federated import federated_rounds
from logsieve.plans.training import (
    MONTHLY_SEARCH, WIDE_SEARCH, ModelRegistry, SearchSpace, append_run, best_parameters, draw_trials, schema_document,
    search_trials, serving_version, train_and_evaluate, training_run,
)
from logsieve.schema import CHUNKS, FEATURES, feature_hash
from logsieve.sources.json_logs import read_json_any, read_ndjson, read_records_json
from logsieve.sources.synthetic import synthetic_trail
from logsieve.sources.bucketed import BucketedTable
from logsieve.sources.tables import get_state, read_or_empty, read_runs


def write_logs(root, event, n=600, seed=1, start=0):
    """Log files with routine reads and some attacks; every file has 50 events."""
    rng = random.Random(seed)
    root.mkdir(parents=True, exist_ok=True)
    events = []
    for i in range(start, start + n):
        attack = rng.random() < 0.1
        events.append(event(
            eventID=f"e{i}", eventTime=f"2026-01-{1 + i % 28:02d}T{(rng.randint(0, 4) if attack else rng.randint(8, 17)):02d}:00:00Z",
            eventName=rng.choice(["CreateUser", "RunInstances"]) if attack else rng.choice(["ListBuckets", "DescribeVolumes", "PutRule"]),
            eventSource=rng.choice(["iam.amazonaws.com", "s3.amazonaws.com"]),
            errorCode="AccessDenied" if attack and rng.random() < 0.7 else "",
            readOnly=not attack and rng.random() < 0.7, userAgent="x" * (3 if attack else rng.randint(20, 60)),
            requestParameters={"k": "v" * (rng.randint(500, 900) if attack else rng.randint(1, 50)), "bucketName": f"b{i}"}))
    for i in range(0, n, 50):
        (root / f"{start + i}.json").write_text(json.dumps({"Records": events[i:i + 50]}))
    return events


def test_dataset_build(spark, tmp_path, event):
    write_logs(tmp_path / "raw" / "one", event, 300)
    lines = write_logs(tmp_path / "scratch", event, 100, 2, 1000)
    (tmp_path / "raw" / "two").mkdir()
    (tmp_path / "raw" / "two" / "aws.ndjson").write_text("\n".join(json.dumps(e) for e in lines))
    (tmp_path / "raw" / "three").mkdir()
    (tmp_path / "raw" / "three" / "list.json").write_text(json.dumps([event(eventID="z", eventSource="ec2.amazonaws.com")]))
    sources = {
        "one": labelled_rule(read_records_json(spark, str(tmp_path / "raw" / "one"))),
        "two": labelled_constant(read_ndjson(spark, str(tmp_path / "raw" / "two"))),
        "three": labelled_constant(read_json_any(spark, str(tmp_path / "raw" / "three"))),
    }
    table = feature_table(sources)
    assert table.columns == ["event_id", "raw_source", "source", *FEATURES, "label"] and table.count() == 401
    codes = {r.raw_source: r.event_source_enc for r in table.select("raw_source", "event_source_enc").distinct().collect()}
    assert codes == {s: i for i, s in enumerate(sorted(codes))}
    report = build_dataset(sources, str(tmp_path / "out"), 100, 50)
    failed = {r.check for r in report.filter("not passed").collect()}
    assert failed == {"anomaly_rate"}
    with pytest.raises(ValueError, match="anomaly_rate"):
        require_passed(report)
    nodes = spark.read.parquet(str(tmp_path / "out" / "federated"))
    assert {r.node for r in nodes.select("node").distinct().collect()} == {"node1", "node2"} and nodes.count() == 401


def test_trials_are_seeded_and_within_bounds():
    for space in (MONTHLY_SEARCH, WIDE_SEARCH):
        trials = draw_trials(space)
        assert trials == draw_trials(space) and len(trials) == space.trials
        for _, n, c, s in trials:
            assert space.n_estimators[0] <= n <= space.n_estimators[1] and space.contamination[0] <= c <= space.contamination[1]
            assert s in ("auto", "0.5", "0.8") if space is MONTHLY_SEARCH else 0.5 <= float(s) <= 1.0


def test_a_trial_equals_a_separate_training(spark):
    table = synthetic_trail(spark, 1500, 150).persist()
    trials = [(0, 5, 0.1, "auto"), (1, 12, 0.05, "auto"), (2, 8, 0.1, "0.5")]
    found = {r.trial_id: r for r in search_trials(table, "event_id", trials).collect()}
    for t, n, c, s in trials:
        _, metrics = train_and_evaluate(table, "event_id", n, c, s)
        alone = metrics.first()
        assert (found[t].n, found[t].f1, found[t].recall) == (alone.n, pytest.approx(alone.f1), pytest.approx(alone.recall))
    best = best_parameters(search_trials(table, "event_id", trials), SearchSpace(3, 0.99, (1, 2), (0, 1), ["auto"])).collect()
    assert len(best) == 1 and best[0].f1 == max(r.f1 for r in found.values())


def test_registry(spark, tmp_path):
    table = synthetic_trail(spark, 400, 40)
    model = fit_forest(table, "event_id", n_estimators=5)
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    assert registry.latest() is None and registry.serving() is None
    registry.register(model, "2")
    registry.register(model, "10")
    assert registry.latest() == "10" and registry.serving() == "10"
    registry.promote("2", "Production")
    assert registry.serving() == "2"
    registry.promote("2", "Archived")
    assert registry.serving() == "10"
    assert {r.version: r.stage for r in registry.versions().collect()} == {"2": "Archived", "10": None}
    with pytest.raises(ValueError):
        registry.promote("2", "Canary")
    loaded = registry.load("2")
    a = score_forest(table, loaded).select("event_id", "score")
    assert a.exceptAll(score_forest(table, model).select("event_id", "score")).count() == 0
    with pytest.raises(SchemaDriftError):
        registry.load("2", FEATURES[:17])
    with pytest.raises(ValueError):
        registry.load("3")
    document = schema_document(spark, "2").first()
    assert (document.hash, document.features, document["count"]) == (feature_hash(), FEATURES, 18)


def test_serving_version_prefers_production_then_number(spark):
    rows = [("m", "9", "Staging"), ("m", "10", None), ("m", "3", "Production"), ("k", "9", None), ("k", "10", None)]
    got = {r.name: r.version for r in serving_version(spark.createDataFrame(rows, "name string, version string, stage string")).collect()}
    assert got == {"m": "3", "k": "10"}


def test_training_run_and_failure(spark, tmp_path, event):
    logs, state = str(tmp_path / "logs"), str(tmp_path / "state")
    write_logs(tmp_path / "logs", event, 600)
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    space = SearchSpace(3, 0.99, (5, 10), (0.05, 0.15), ["auto"])

    def broken(since):
        raise RuntimeError("index failed")

    with pytest.raises(RuntimeError):
        training_run(spark, logs, registry, state, "1", space, broken)
    assert get_state(spark, state, "last_train_ts") is None
    seen = []
    result = training_run(spark, logs, registry, state, "2", space, seen.append)
    assert seen == ["1970-01-01T00:00:00Z"] and get_state(spark, state, "last_train_ts") == result["watermark"]
    assert registry.serving() == "2" and result["n"] == 120 and result["f1"] > 0.5
    with pytest.raises(ValueError):
        training_run(spark, str(tmp_path / "state"), registry, str(tmp_path / "other"), "3", space)


def test_federated_rounds(spark):
    table = synthetic_trail(spark, 1200, 120)
    nodes = table.withColumn("node", F.when(F.pmod(F.hash("event_id"), F.lit(3)) == 0, "node1").otherwise("node2"))
    per_node, rounds = federated_rounds(nodes, "event_id", rounds=3, n_estimators=10)
    rows = per_node.filter("round = 1").orderBy("node").collect()
    mean = sum(r.n * r.offset for r in rows) / sum(r.n for r in rows)
    assert [r.node for r in rows] == ["node1", "node2"] and all(r.global_offset == pytest.approx(mean) for r in rows)
    found = rounds.orderBy("round").collect()
    assert [r["round"] for r in found] == [1, 2, 3] and len({r.eval_f1 for r in found}) == 1
    assert found[0].eval_loss == pytest.approx(1 - found[0].eval_f1) and found[0].num_clients == 2
    with pytest.raises(ValueError):
        federated_rounds(nodes.filter("node = 'node1'"), "event_id", n_estimators=5)


def test_change_index(spark, tmp_path, event):
    events = write_logs(tmp_path / "logs", event, 200)
    changes = {e["eventID"] for e in events if not e["readOnly"] and e["eventName"] in ("CreateUser", "RunInstances", "PutRule")}
    table = BucketedTable(spark, str(tmp_path / "index"), CHUNKS, "event_id", 8)
    vectoriser, counts = build_change_index(spark, str(tmp_path / "logs"), "1970-01-01T00:00:00Z", table)
    assert counts.first() == (len(changes), 0, len(changes))
    rows = table.read().collect()
    assert {r.event_id for r in rows} == changes
    assert all(len(r.embedding) == 256 and r.resource.startswith("b") and r.raw_text.startswith("[2026-") for r in rows)
    _, again = build_change_index(spark, str(tmp_path / "logs"), "1970-01-01T00:00:00Z", table, vectoriser)
    assert again.first() == (0, len(changes), len(changes)) and table.read().count() == len(changes) and table.version() == 2
    _, none = build_change_index(spark, str(tmp_path / "logs"), "2100-01-01T00:00:00Z", table, vectoriser)
    assert none.first() == (0, 0, 0) and table.read().count() == len(changes)


def test_lookup_limit_comes_before_names(spark, tmp_path, event):
    write_logs(tmp_path / "logs", event, 200)
    events = read_records_json(spark, str(tmp_path / "logs"))
    start = F.lit("2026-01-01").cast("timestamp")
    newest = lookup_changes(events, start, 20)
    kept = events.filter("not readOnly").orderBy(F.desc("eventTime"), "eventID").limit(20).filter("eventName = 'RunInstances'")
    assert sorted(r.eventID for r in newest.collect()) == sorted(r.eventID for r in kept.collect())
    assert "RunInstances at 2026-01-" in change_documents(lookup_changes(events, start)).first().document
    top = relevant_changes(events, start, "ec2.amazonaws.com")
    assert top.columns == ["rank", "event_id", "document"] and top.count() == 3


def test_runs_anchor_the_lookup(spark, tmp_path):
    metrics = spark.createDataFrame([(0.9, 0.8, 0.7)], "f1 double, precision double, recall double")
    path = str(tmp_path / "runs")
    append_run(spark, path, "r1", "fed", "FINISHED", 1_000, metrics)
    append_run(spark, path, "r2", "fed", "FINISHED", 5_000, metrics)
    runs = read_or_empty(spark, path, "run_id string, experiment string, status string, start_time bigint, f1 double")
    assert [r.run_id for r in read_runs(runs, "fed").collect()] == ["r2", "r1"]
    assert spark.range(1).select(last_training(runs, "fed").alias("t")).first().t.second == 5
    with pytest.raises(ValueError):
        last_training(runs, "none")


def test_relevant_changes_without_vectors(spark, event):
    class Broken:
        def transform(self, df, column, output="embedding"):
            return df.withColumn(output, F.lit(None).cast("array<float>"))

    rows = [json.dumps(event(eventID=f"e{i:02d}")) for i in range(15)]
    from logsieve.schema import EVENT
    events = spark.read.schema(EVENT).json(spark.sparkContext.parallelize(rows))
    got = relevant_changes(events, F.lit("2025-01-01").cast("timestamp"), vectoriser=Broken())
    assert [r.event_id for r in got.collect()] == [f"e{i:02d}" for i in range(10)]


def test_half_split_when_a_node_is_too_small(spark):
    df = synthetic_trail(spark, 100, 10).withColumn("raw_source", F.lit("sns"))
    counts = {r.node: r["count"] for r in split.node_split(df, "raw_source", "event_id").groupBy("node").count().collect()}
    assert counts == {"node1": 55, "node2": 55}


@pytest.mark.parametrize("step, kind", [("register", "commit"), ("watermark", "intent")])
def test_a_killed_training_run_goes_on(spark, tmp_path, event, monkeypatch, step, kind):
    from logsieve.plans.journal import Journal

    write_logs(tmp_path / "logs", event, 300)
    registry, state = ModelRegistry(spark, str(tmp_path / "models")), str(tmp_path / "state")
    space = SearchSpace(1, 0.99, (5, 5), (0.1, 0.1), ["auto"])
    write, indexed = Journal._write, []

    def dying(self, name, what, outcome=None):
        if (name, what) == (step, kind) and not killed:
            killed.append(name)
            raise RuntimeError("killed")
        write(self, name, what, outcome)

    killed = []
    monkeypatch.setattr(Journal, "_write", dying)
    run = lambda: training_run(spark, str(tmp_path / "logs"), registry, state, "1", space, indexed.append)
    with pytest.raises(RuntimeError):
        run()
    assert get_state(spark, state, "last_train_ts") is None
    result = run()
    assert registry.versions().count() == 1 and registry.stage_events().count() == 1 and indexed == [result["since"]]
    assert spark.read.parquet(f"{registry.root}/registry").count() == 1
    assert get_state(spark, state, "last_train_ts") == result["watermark"] == run()["watermark"]
