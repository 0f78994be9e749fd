"""The ledger of log files: what is opened, late and rewritten files, broken input."""

import json
import os

import pytest

from logsieve.sources.file_ledger import FileLedger


def put(root, name, times, stamp=None):
    path = root / name
    path.write_text(json.dumps({"Records": [{"eventID": f"{name}-{i}", "eventTime": t} for i, t in enumerate(times)]}))
    if stamp:
        os.utime(path, (stamp, stamp))
    return path


@pytest.fixture
def ledger(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    put(logs, "a.json", ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"])
    put(logs, "b c.json", ["2024-01-02T00:00:00Z", "2024-01-05T12:00:00Z"])
    put(logs, "c.json", ["2024-01-09T00:00:00Z", "not a time"])
    (logs / "broken.json").write_text('{"Records": [{')
    (logs / "empty.json").write_text("")
    return FileLedger(spark, str(tmp_path / "ledger"), str(logs)), logs


def ids(df):
    return sorted(r.eventID for r in df.collect())


def names(paths):
    return [p.rsplit("/", 1)[1] for p in paths]


def test_only_files_that_reach_the_time_are_opened(ledger):
    kept, _ = ledger
    assert kept.refresh() == 4 and kept.refresh() == 0      # a file of no bytes is not listed
    scan = kept.scan_since("2024-01-05T12:00:00Z")
    assert ids(scan) == ["b c.json-1", "c.json-0"]
    assert names(kept.files_since("2024-01-05T12:00:00Z")) == ["b c.json", "c.json"] and len(scan.inputFiles()) == 2
    assert names(kept.files_since("2024-01-05T12:00:00Z", inclusive=False)) == ["c.json"]
    assert ids(kept.scan_since("2024-01-05T12:00:00Z", inclusive=False)) == ["c.json-0"]
    assert kept.scan_since("2030-01-01T00:00:00Z").count() == 0


def test_late_and_rewritten_files(ledger):
    kept, logs = ledger
    kept.refresh()
    put(logs, "late.json", ["2024-01-06T00:00:00Z"], stamp=1_000_000_000)       # older than all others by its file time
    assert kept.refresh() == 1
    assert ids(kept.scan_since("2024-01-05T13:00:00Z")) == ["c.json-0", "late.json-0"]
    put(logs, "a.json", ["2024-01-01T00:00:00Z", "2024-01-20T00:00:00Z", "2024-01-21T00:00:00Z"], stamp=4_000_000_000)
    assert kept.refresh() == 1
    assert ids(kept.scan_since("2024-01-15T00:00:00Z")) == ["a.json-1", "a.json-2"]
    assert kept.rows().count() == 5
    (logs / "c.json").unlink()
    assert ids(kept.scan_since("2024-01-05T13:00:00Z")) == ["a.json-1", "a.json-2", "late.json-0"]
