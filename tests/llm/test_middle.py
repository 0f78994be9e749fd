"""Fill-in-middle against a plain version, text by text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from logsieve.llm import middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "\n\t ", "a", " a", "a ", "a b", "é b \x0b 中文 😀\x1cd ", "x <P> y", "<S>", "a<M>", "< P> <P", "one two\n\nthree  four ", "  z\x85 q",
         "<|endoftext|> \\ $1 \\1", "w " * 70_000, "a" * 400_000]


def plain(doc_id, text, plan=M.Plan()):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (plan.prefix, plan.suffix, plan.middle)) or h3 % 100 >= plan.rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < plan.spm:
        return doc_id, n, "spm", len(p), len(m), plan.suffix + s + plan.prefix + p + plan.middle + m
    return doc_id, n, "psm", len(p), len(m), plan.prefix + p + plan.suffix + s + plan.middle + m


@pytest.mark.parametrize("plan", [M.Plan(), M.Plan(seed=7, rate=100, spm=0), M.Plan(rate=100, spm=100, prefix="[[a]]", suffix="[[b]]", middle="[[c]]"), M.Plan(rate=0)])
def test_against_a_plain_version(spark, table, clashes, plan):
    rows = [(i * 37 + k, t) for i in range(3) for k, t in enumerate(TEXTS)] + [(None, "a b c"), (5, None), (5, None), (6, "same row"), (6, "same row"), (-3, "a b c d")]
    df = M.fill_in_middle(table(rows, **clashes).repartition(3), plan)
    got = df.withColumn("back", M.restored(F.col("output"), F.col("form"), plan)).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(plain(i, t, plan)) for i, t in rows)
    texts = {plain(i, t, plan): t or "" for i, t in rows}
    assert all(r.back == texts[tuple(r)[:6]] for r in got)


def test_rates_and_empty_table(spark, table):
    df = M.fill_in_middle(table([(i, f"a{i} b c d e") for i in range(4000)]))
    forms = {r.form: r["count"] for r in df.groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 1600) < 150 and abs(forms["psm"] - 400) < 100
    empty = M.fill_in_middle(table([]))
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and empty.count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("x1", "a b c"), ("x2", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n, r.form, r.output) for r in M.fill_in_middle(df, M.Plan(rate=100)).collect()}
    assert got["x2"] == (0, "plain", "") and got["x1"] == tuple(plain("x1", "a b c", M.Plan(rate=100))[k] for k in (1, 2, 5))
