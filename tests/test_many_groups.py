"""Quantiles of many small groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import quantiles as qn


def test_quantiles_of_small_groups_need_no_passes(spark, monkeypatch):
    n = F.col("id")
    table = spark.range(3000).select(F.when(n < 500, 1).when(n < 2700, n).alias("g"), F.when(n % 11 > 0, (n * 7919 % 1000).cast("double")).alias("v"))
    passes = []
    statistics = qn.order_statistics
    monkeypatch.setattr(qn, "order_statistics", lambda *a: passes.append(a) or statistics(*a))
    qs = [0.0, 0.25, 0.9, 1.0]
    found = {}
    for rows in (50_000, 300, 0):      # all groups are sorted, some are, none is
        monkeypatch.setattr(qn, "SORTED_ROWS", rows)
        for method in ("linear", "index"):
            found[rows, method] = sorted(map(tuple, qn.exact_quantiles(table, "v", qs, "g", method).collect()), key=str)
        assert bool(passes) == (rows < 50_000)
    values = [r.v for r in table.filter("g = 1 and v is not null").collect()]
    assert [r[2] for r in found[50_000, "linear"] if r[0] == 1] == pytest.approx(np.quantile(values, qs))
    for method in ("linear", "index"):
        assert found[50_000, method] == found[300, method] == found[0, method]
