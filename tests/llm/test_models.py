"""Language identification and toxicity: features, gradients, held-out accuracy, odd inputs."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from logsieve.llm import language as L
from logsieve.llm import toxicity as T
from logsieve.llm.texts import fold, fold_of


def test_folds(spark):
    rows = spark.createDataFrame([(1,), (27,), (None,), (-5,)], "doc_id bigint")
    got = {r.doc_id: r.f for r in rows.select("doc_id", fold(rows.doc_id, 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in (1, 27, None, -5)}
    assert all(fold_of(i, 5) == f for i, f in got.items())


def test_words_and_ngrams():
    words, number, text = L.bag_of_words(pa.array(["The cat, the\x0bCAT9dog", None, "", "12 — !", "É 中"]))
    assert [(words[n], int(t)) for n, t in zip(number, text)] == [("the", 0), ("cat", 0), ("the", 0), ("cat", 0), ("dog", 0), ("é", 4), ("中", 4)]
    hashes, ends = L.ngrams(["ab", "ab", "x"])
    assert np.diff([0, *ends]).tolist() == [10, 10, 6]       # <ab> has 4 + 3 + 2 + 1, <x> 3 + 2 + 1
    assert hashes[:10].tolist() == hashes[10:20].tolist()


def test_language_scores_are_those_of_single_texts():
    model = L.fit(["the cat and the dog"] * 9 + ["der hund und die katze"] * 9, ["en"] * 9 + ["de"] * 9)
    texts = ["the dog", "die katze", "", None, "123", "the " * 3000]
    k, p, has = model.scores(pa.array(texts))
    for i, t in enumerate(texts):
        one = model.scores(pa.array([t]))
        assert (k[i], has[i]) == (one[0][0], one[2][0]) and abs(p[i] - one[1][0]) < 1e-9
    assert [model.languages[i] for i in k[:2]] == ["en", "de"] and has.tolist() == [True, True, False, False, False, True]


def test_language_query_on_held_out_documents(spark, sf):
    from logsieve.llm.queries import op6_language_id
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold_of(r.doc_id, 5) == 0) for r in rows) and 0.1 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    accepted = [r for r in held if r.accepted]
    assert accepted and np.mean([r.lang_pred == docs[r.doc_id].lang for r in accepted]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(table, clashes):
    rows = [(1, None), (2, ""), (3, "12 !"), (None, "the cat"), (1, "the cat"), (4, "中文")]
    model = L.fit(["the cat and the dog"] * 9 + ["der hund und die katze"] * 9, ["en"] * 9 + ["de"] * 9)
    got = sorted((repr(r.doc_id), r.lang_pred in ("en", "de"), r.lang_pred) for r in L.predict(table(rows, **clashes), model).collect())
    assert [g[1] for g in got] == [False, True, False, False, True, True]
    assert L.predict(table([]), model).count() == 0
    assert L.predict(table([(1, "a")]), L.fit([], [])).first().lang_pred == "und"


def test_language_sample_is_a_hash_choice(table):
    rows = table([(k, f"text {k}") for k in range(900)]).selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'a', if(doc_id % 3 = 1, 'b', null)) as lang")
    texts, langs = L.sample_of(rows, 100)
    assert 60 < langs.count("a") < 140 and 60 < langs.count("b") < 140
    assert (texts, langs) == L.sample_of(rows.repartition(7), 100)


def test_gradients():
    net = T.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, codes, length = ["idiot", "the", "of", "and"], np.array([[0, 1, 2, 4, 4], [3, 1, 0, 2, 2], [2, 4, 4, 4, 4]]), np.array([3, 5, 1])
    y, w = np.array([1, 0, 1.0]), np.ones(3) / 3
    grads, _ = net.gradients(words, codes, length, y, w)
    whole, grams, _ = T.word_features(words)
    rng = np.random.default_rng(0)
    for name, g in grams_and(grads):
        at = (int(whole[0]), 1) if name == "words" else (int(grams[2]), 2) if name == "chars" else tuple(rng.integers(0, n) for n in net.p[name].shape)
        kept, loss = net.p[name][at], []
        for step in (1e-3, -1e-3):
            net.p[name][at] = kept + step
            loss.append(net.gradients(words, codes, length, y, w)[1])
        net.p[name][at] = kept
        assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-3, abs=2e-5)


def grams_and(grads):
    return sorted(grads.items())


def test_every_word_is_in_a_window_and_padding_does_not_count():
    sizes = [0, 1, 47, 48, 49, 80, 81, 200]
    text = np.repeat(np.arange(len(sizes)), sizes)
    number = np.arange(len(text))
    codes, length, of = T.windows_of(number, text, len(sizes), 9999)
    for t, n in enumerate(sizes):
        own = [codes[k][:length[k]].tolist() for k in np.flatnonzero(of == t)]
        assert sorted({x for w in own for x in w}) == number[text == t].tolist()
        assert all(a[T.STEP:] == b[:len(a) - T.STEP] for a, b in zip(own, own[1:]))
    net = T.Network()
    x, _ = net.inputs(["a", "b"])
    short = net.forward(x, np.array([[0, 1]]), np.array([2]))
    assert net.forward(x, np.array([[0, 1, 2, 2, 2]]), np.array([2])) == pytest.approx(short, abs=1e-5)


def test_toxicity_query(spark, sf):
    from logsieve.llm.queries import op1_toxicity
    rows = op1_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert all(r.held_out == (fold_of(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_documents(spark):
    """About 3,600 labels, a tenth of them toxic, some without any sign of it in the text."""
    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels, "doc_id")
    scores = {r.doc_id: r for r in T.toxicity(known.select("doc_id", "text"), labels).collect()}
    held = [(scores[r.doc_id], r.toxic) for r in known.select("doc_id", "toxic").collect() if scores[r.doc_id].held_out]
    bad, good = np.array([s.score for s, y in held if y]), np.array([s.score for s, y in held if not y])
    assert np.mean(bad[:, None] > good) > 0.92
    assert np.mean(good >= 0.7) < 0.02 and np.mean(bad >= 0.7) > 0.6


def test_toxicity_cases(table, clashes):
    bad = [f"you are an idiot and a moron number {k}" for k in range(60)]
    good = [f"you are a reader and a friend number {k}" for k in range(120)]
    model = T.fit(bad + good, [1] * 60 + [0] * 120, epochs=5)
    rows = [(1, "what an idiot he is and a moron"), (2, "what a reader he is and a friend"), (3, None), (4, ""), (5, "1 2"), (None, bad[0]),
            (6, "friend of a reader " * 4000 + " idiot moron idiot moron " + "friend of a reader " * 4000), (1, "what an idiot he is and a moron")]
    got = {(r.doc_id): r.score for r in T.score_texts(table(rows, **clashes).repartition(3), model).collect()}
    assert got[3] == got[4] == got[5] == 0
    assert min(got[1], got[None], got[6]) > got[2]
    assert T.score_texts(table([]), model).count() == 0
    assert T.fit(["a"], [1]).scores(pa.array(["b"]))[0] > 0.9 and T.fit([], []).scores(pa.array(["b"]))[0] < 0.1
