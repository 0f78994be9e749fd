"""Features against plain Python, the cascade, and the labelled junk."""

from collections import Counter

from pyspark.sql import functions as F

from logsieve.llm import quality as Q


def plain(text):
    text = text or ""
    words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " ", "\n\n", "one", "a b c", "a b c d", "a b c a b c", "x x x x", "x x x", "a\x1cb\x85c d", "l\nl\nm\n l", "é # 中 $$ <|> *&%",
         "a b c " * 20000, "q\r\nq\r\n", "the cat sat. the cat sat. the dog the cat sat."]


def test_features_match_plain_python(table):
    rows = list(enumerate(TEXTS))
    df = Q.judge(table(rows), features=Q.BASE)
    got = {r.doc_id: tuple(r[n] for n in Q.BASE) for r in df.select("_row.doc_id", "_features.*").collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_verdict_does_not_depend_on_the_order(table, clashes):
    rows = [(1, " ".join(f"some{k} words{k * 7} differ" for k in range(40))), (2, "SHOUT!! " * 3 + " ".join(f"LOUD{k}!!" for k in range(80))),
            (3, " ".join(f"w{k}%%%" for k in range(80))), (None, None), (4, "same words here " * 40), (1, "short")]
    df = table(rows, **clashes)
    text = F.coalesce(F.col("text"), F.lit(""))
    want = None
    for rules in (Q.RULES, Q.RULES[::-1], Q.RULES[3:] + Q.RULES[:3]):
        got = sorted(repr((r.doc_id, r.bad)) for r in df.select("doc_id", Q.verdict(text, rules).isNotNull().alias("bad")).collect())
        want = want or got
        assert got == want
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert [r.doc_id for r in kept.collect()] == [1]


def test_order_is_rejection_per_cost(table):
    rows = [(k, "word " * 5 if k % 2 else " ".join(f"w{k}{j}" for j in range(60))) for k in range(40)]
    order = Q.rule_order(table(rows))
    assert [s / c for _, c, s in order] == sorted((s / c for _, c, s in order), reverse=True)
    assert {r.name: s for r, _, s in order}["few_words"] == 0.5


def test_empty_table_and_no_python(table, sf, spark):
    assert Q.judge(table([])).count() == 0
    plan = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"), features=Q.BASE)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_labelled_junk_goes_and_good_documents_stay(spark, sf):
    docs = Q.judge(spark.read.parquet(f"{sf}/documents.parquet"), features=["n_words"])
    rows = docs.select("_row.doc_id", "_features.n_words", "_rejected_by").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    junk = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and r.n_words >= 50]
    assert sum(r._rejected_by is not None for r in junk) >= 0.9 * len(junk)
    assert sum(r._rejected_by is None for r in good) >= 0.99 * len(good)
