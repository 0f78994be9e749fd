"""Vector search against brute force, and the vectoriser against a plain computation."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsieve.operators import retrieval as rt


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, [0.0] * 8)]      # copies and a zero vector
    return spark.createDataFrame(rows, "id int, embedding array<float>").repartition(5).persist()


def brute(vectors, queries, k, metric="cosine"):
    rows = {r.id: np.asarray(r.embedding, dtype=float) for r in vectors.collect()}
    out = {}
    for q in queries.collect():
        a = np.asarray(q.embedding, dtype=float)

        def distance(i, a=a):
            b = rows[i]
            if metric == "inner":
                return round(-float(a @ b), 9)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            return round(1 - float(a @ b) / norm, 9) if norm else math.inf

        out[q.q] = sorted(rows, key=lambda i: (distance(i), i))[:k]
    return out


def found(hits):
    out = {}
    for r in hits.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "inner"])
def test_search_equals_brute_force_on_both_ways(vectors, monkeypatch, metric):
    queries = vectors.withColumnRenamed("id", "q").filter("q < 40 or q > 299")
    expected = brute(vectors, queries, 5, metric)
    assert found(rt.nearest(queries, vectors, 5, "q", "id", metric=metric)) == expected
    monkeypatch.setattr(rt, "MAX_QUERY_VALUES", 8)
    assert found(rt.nearest(queries, vectors, 5, "q", "id", metric=metric, block_rows=50)) == expected


def test_exact_search_meets_a_part_of_the_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(24, 12))
    rows = [(i, [float(x) for x in middles[i % 24] + 0.02 * rng.normal(size=12)]) for i in range(960)]
    rows += [(i, rows[7][1]) for i in range(960, 1440)]         # a third of the rows are one vector
    vectors = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(4)
    queries = vectors.withColumnRenamed("id", "q").filter("q % 40 = 7")
    asked, kept = [], rt.store
    monkeypatch.setattr(rt, "store", lambda df: (asked.append(out := kept(df)), out)[1])
    monkeypatch.setattr(rt, "LEAST_BLOCK", 16)
    monkeypatch.setattr(rt, "PAIRS_PER_TASK", 500)
    ix = rt.exact_index(vectors, "id", lists=24)
    hits = rt.nearest_exact(queries, ix, 4, "q", "id", block_rows=100)
    assert found(hits) == brute(vectors, queries, 4)
    size = ix.rings["n"]
    met = sum(int(size.iloc[a].sum()) for df in asked if "asked" in df.columns for (a,) in df.select("asked").collect())
    groups = sum(len(df.select("qid").collect()) for df in asked if "asked" in df.columns and df.filter("reached > 2").isEmpty())
    assert met < 0.5 * groups * len(rows)


def test_partitioning_and_k_beyond_the_table(vectors):
    queries = vectors.withColumnRenamed("id", "q").filter("q = 7")
    hits = rt.nearest(queries, vectors.limit(3), 5, "q", "id")
    assert hits.count() == 3
    base = found(rt.nearest(queries, vectors, 9, "q", "id"))
    for n in (1, 4, 16):
        assert found(rt.nearest(queries, vectors.repartition(n), 9, "q", "id")) == base


def test_zero_query_and_empty_index(spark, vectors):
    zero = spark.createDataFrame([(1, [0.0] * 8)], "q int, embedding array<float>")
    hits = rt.nearest(zero, vectors, 5, "q", "id").collect()
    assert len(hits) == 5 and all(h.distance is None for h in hits)
    assert rt.nearest(zero, vectors.limit(0), 5, "q", "id").count() == 0
    assert rt.nearest(zero.limit(0), vectors, 5, "q", "id").count() == 0


def test_unit_vectors_near_the_first_axis(spark):
    index = spark.createDataFrame([(1, [1.0] + [0.0] * 1535), (2, [0.0, 1.0] + [0.0] * 1534)], "id int, embedding array<float>")
    query = spark.createDataFrame([(0, [0.99, 0.01] + [0.0] * 1534)], "q int, embedding array<float>")
    assert rt.nearest(query, index, 1, "q", "id").first().id == 1


def test_wrong_dimension_is_set_aside(spark):
    df = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 3), (3, None)], "id int, embedding array<float>")
    good, bad = rt.split_by_dimension(df, 4)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_expressions_equal_numpy(vectors):
    row = vectors.filter("id = 3").select(
        rt.cosine_distance(F.col("embedding"), F.reverse("embedding")).alias("d"), rt.normalised(F.col("embedding")).alias("u"),
        "embedding").first()
    a = np.asarray(row.embedding)
    assert row.d == pytest.approx(1 - a @ a[::-1] / (a @ a))
    assert np.linalg.norm(row.u) == pytest.approx(1.0)
    zero = vectors.filter("id = 302").select(rt.cosine_distance(F.col("embedding"), F.col("embedding")).alias("d")).first()
    assert zero.d is None


def test_inverted_file(vectors, tmp_path, spark, monkeypatch):
    index = vectors.filter("id < 300")
    centres = rt.train_lists(index, "id", lists=6)
    placed = rt.assign_lists(index, centres)
    placed.write.partitionBy("list_id").parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    queries = index.withColumnRenamed("id", "q").filter("q < 60")
    exact = found(rt.nearest(queries, index, 5, "q", "id"))
    assert found(rt.nearest_in_lists(queries, stored, centres, 5, "q", "id", probes=6)) == exact
    some = found(rt.nearest_in_lists(queries, stored, centres, 5, "q", "id", probes=3))
    recall = sum(len(set(some[q]) & set(exact[q])) for q in exact) / (5 * len(exact))
    assert recall > 0.6
    one = queries.filter("q = 1")
    pruned = rt.nearest_in_lists(one, stored, centres, 5, "q", "id", probes=1)
    assert "PartitionFilters: [list_id" in pruned._jdf.queryExecution().toString().replace("isnotnull(list_id", "list_id")
    monkeypatch.setattr(rt, "MAX_QUERY_VALUES", 8 * 20)
    assert found(rt.nearest_in_lists(queries, stored, centres, 5, "q", "id", probes=3)) == some


def test_payload_joins_either_way(vectors):
    hits = rt.nearest(vectors.withColumnRenamed("id", "q").filter("q < 3"), vectors, 2, "q", "id")
    payload = vectors.withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    for small in (1000, 1):
        rows = rt.with_payload(hits, payload, "id", ["text"], small).collect()
        assert len(rows) == 6 and all(r.text == f"t{r.id}" for r in rows)


def test_vectoriser_equals_plain_weights(spark):
    texts = ["alpha beta beta", "alpha gamma", "delta, Delta! été", "", None, "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    vectoriser = rt.TextVectoriser(512).fit(df, "t")
    rows = {r.id: r.embedding for r in vectoriser.transform(df, "t").collect()}
    assert rows[3] is None and rows[4] is None and rows[5] is None
    words = {i: [w for w in re.split(r"[^\w]+", (t or "").lower()) if w] for i, t in enumerate(texts)}
    documents_with = lambda w: sum(w in ws for ws in words.values())
    for i in (0, 1, 2):
        weights = {w: words[i].count(w) * math.log((len(texts) + 1) / (documents_with(w) + 1)) for w in set(words[i])}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        assert sorted(x for x in rows[i] if x) == pytest.approx(sorted(w / norm for w in weights.values()), rel=1e-5)
    good, failed = rt.embedded(vectoriser.transform(df, "t"))
    assert (good.count(), failed.count()) == (3, 3)


def test_long_texts_are_used_whole(spark):
    text = "start " + "filler " * 20_000 + "ending"
    df = spark.createDataFrame([(1, text), (2, text.replace("ending", "other"))], "id int, t string")
    vectoriser = rt.TextVectoriser(4096).fit(df, "t")
    a, b = (r.embedding for r in vectoriser.transform(df, "t").orderBy("id").collect())
    assert a != b
    cut = rt.TextVectoriser(4096, max_chars=8000).fit(df, "t")
    a, b = (r.embedding for r in cut.transform(df, "t").orderBy("id").collect())
    assert a == b


def test_first_documents(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": range(30)}))
    assert [r.id for r in rt.first_documents(df, F.col("id")).collect()] == list(range(10))
