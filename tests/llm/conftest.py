import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("no test data")
    return str(SF)


@pytest.fixture(scope="session")
def table(spark):
    """A documents-like table; extra columns carry names that operators use themselves."""
    def make(rows, **extra):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {k} string" for k in extra)
        full = [(i, t, None, None, None if t is None else len(t), *extra.values()) for i, t in rows]
        return spark.createDataFrame(full, schema)
    return make


CLASHES = {k: "x" for k in ("n_lines", "n_dropped", "fp", "key", "component_id", "class", "least", "node", "root", "_id", "_drops", "label", "score",
                            "piece", "length", "start", "offset", "sequence_id", "toxic", "n_words", "n", "shard", "before", "a", "b", "_lead")}


@pytest.fixture(scope="session")
def clashes():
    return CLASHES
