"""All queries of this folder with workers that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SF = Path("/root/testdata/sf0.001")
CODE = """
import sys
sys.path.insert(0, {repo!r})
from logsieve.session import get_session
spark = get_session("bare workers")

def missing(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("logsieve") is not None]}})

assert not any(r.found for r in spark.range(8).mapInArrow(missing, "found boolean").collect()), "the workers have the package"
from logsieve.llm.queries import QUERIES
for name, query in QUERIES.items():
    print(name, query(spark, {sf!r}).count(), flush=True)
"""


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_all_queries_run(tmp_path):
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    (tmp_path / "job.py").write_text(CODE.format(repo=str(REPO), sf=str(SF)))
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) >= 13
