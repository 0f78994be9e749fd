"""Retries and dead letters over restarts."""

import time

from logsieve.streaming import retries as R


def until(check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.5)
    return False


def counts(spark, out):
    rows = R.read_batches(spark, f"{out}/retry_events", R.EVENTS).groupBy("message_id", "action").count().collect()
    return {(r.message_id, r.action): r["count"] for r in rows}


def test_three_failures_with_a_restart_end_in_the_dead_letter_table(spark, tmp_path):
    out, checkpoint, recovered = str(tmp_path / "out"), str(tmp_path / "checkpoint"), []

    def start(days):
        return R.start_retries(spark, out, checkpoint, lambda df, _: recovered.extend(r.source_file for r in df.collect()),
                               retry_after=1, dead_days=days, every="1 second")

    first = spark.createDataFrame([("bad", '{"Records": [{"eventID": "x"'), ("good", '{"Records": [{"eventID": "y"}]}'), ("late", "[1")], R.FAILURES)
    query = start(3 / 86_400)
    R.add_failures(first, f"{out}/failures", "scoring-0")
    assert until(lambda: ("bad", "retry") in counts(spark, out) and "good" in recovered)
    query.stop()
    query.awaitTermination()

    query = start(3 / 86_400)           # the count of failures goes on where it was
    assert until(lambda: ("bad", "dead") in counts(spark, out))
    dead = {r.message_id: r for r in R.dead_letter_table(spark, out).collect()}
    assert until(lambda: ("bad", "expired") in counts(spark, out) and ("late", "expired") in counts(spark, out))
    query.stop()
    query.awaitTermination()
    found = counts(spark, out)
    assert found[("bad", "retry")] == 2 and found[("bad", "dead")] == 1 and ("good", "dead") not in found
    assert recovered == ["good"]
    assert not dead or dead["bad"].attempts == 3
    assert R.dead_letter_table(spark, out).count() == 0


def test_failures_that_come_together_count_each(spark, tmp_path):
    out = str(tmp_path / "out")
    query = R.start_retries(spark, out, str(tmp_path / "checkpoint"), retry_after=600, every="1 second")
    R.add_failures(spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 2, R.FAILURES), f"{out}/failures", "0")
    assert until(lambda: ("a", "dead") in counts(spark, out))
    query.stop()
    query.awaitTermination()
    assert [(r.message_id, r.attempts) for r in R.dead_letter_table(spark, out).collect()] == [("a", 3)]
