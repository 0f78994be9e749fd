"""Runs that die between any two steps, and vocabularies that grow by increments."""

import math

import pytest
from pyspark.sql import functions as F

from logsieve.operators.retrieval import TextVectoriser
from logsieve.operators.vocabulary import Vocabulary
from logsieve.plans import journal as jn


class Died(Exception):
    pass


def test_a_run_killed_after_any_write_resumes_and_publishes_once(spark, tmp_path, monkeypatch):
    write = jn.Journal._write
    for kill in range(6):
        writes, published, calls = [], [], []

        def dying(self, step, kind, outcome=None):
            writes.append(step)
            write(self, step, kind, outcome)
            if len(writes) == kill + 1:
                raise Died

        def publish(again):
            if not (again and published):
                published.append("row")
            return {"n": len(published)}

        def job():
            journal = jn.Journal(spark, str(tmp_path / f"{kill}"), "run")
            journal.step("read", lambda again: calls.append("read") or "since")
            journal.step("publish", publish)
            return journal.step("end", lambda again: [1, None])

        monkeypatch.setattr(jn.Journal, "_write", dying)
        with pytest.raises(Died):
            job()
        assert job() == [1, None] and published == ["row"] and len(calls) <= 2
        assert {r.step for r in jn.Journal(spark, str(tmp_path / f"{kill}"), "run").status().filter("committed").collect()} == {"read", "publish", "end"}
        assert job() == [1, None] and published == ["row"]
    assert jn.Journal(spark, str(tmp_path / "0"), "another run").rows().isEmpty()


def test_increments_equal_one_fit_and_versions_stay(spark, tmp_path):
    texts = ["alpha beta beta", "alpha gamma", None, "", "delta, Delta! beta", "gamma gamma alpha", "..."]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, _extra string")
    vocabulary = Vocabulary(spark, str(tmp_path / "words"), 512)
    assert vocabulary.latest() == 0
    one = vocabulary.add(table.filter("id < 3"), "t", "a")
    first = vocabulary.vectoriser(one).transform(table, "t").collect()
    two = vocabulary.add(table.filter("id >= 3"), "t", "b")
    assert (one, two) == (1, 2) and vocabulary.add(table.filter("id < 3"), "t", "a") == 1 and vocabulary.latest() == 2
    refit = {r.id: r.embedding for r in TextVectoriser(512).fit(table, "t").transform(table, "t").collect()}
    for r in vocabulary.vectoriser().transform(table, "t").collect():
        assert (r.embedding is None) == (refit[r.id] is None)
        assert r.embedding is None or r.embedding == pytest.approx(refit[r.id], abs=1e-6)
    assert vocabulary.vectoriser(one).transform(table, "t").collect() == first
    total = vocabulary.versions().filter("version = 2").first()
    assert total.n == len(texts) and sum(total.frequencies) == 8
    assert vocabulary.add(table.filter(F.lit(False)), "t", "none") == 3 and vocabulary._totals(3) == vocabulary._totals(2)
    with pytest.raises(ValueError):
        vocabulary.vectoriser(9)
    weight = math.log((len(texts) + 1) / (3 + 1))
    assert any(abs(w - weight) < 1e-12 for w in [math.log((total.n + 1) / (f + 1)) for f in total.frequencies])


def test_change_index_with_a_vocabulary(spark, tmp_path, event):
    import json

    from logsieve.plans.changes import build_change_index
    from logsieve.schema import CHUNKS
    from logsieve.sources.bucketed import BucketedTable

    (tmp_path / "logs").mkdir()
    names = ["CreateUser", "RunInstances", "PutBucketPolicy"]
    records = [event(eventID=f"e{i}", eventName=names[i % 3], readOnly=False, managementEvent=True) for i in range(9)]
    (tmp_path / "logs" / "a.json").write_text(json.dumps({"Records": records}))
    index = BucketedTable(spark, str(tmp_path / "index"), CHUNKS, "event_id", 4)
    vocabulary = Vocabulary(spark, str(tmp_path / "words"))
    for _ in range(2):
        build_change_index(spark, str(tmp_path / "logs"), "1970-01-01T00:00:00Z", index, vocabulary=vocabulary)
    assert vocabulary.latest() == 1 and vocabulary.versions().first().n == 9
    assert index.read().count() == 9 and all(len(r.embedding) == 256 for r in index.read().collect())
