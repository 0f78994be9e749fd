"""run() against a plain version of its five stages."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from logsieve.llm import decontam, line_dedup, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def good(text):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    again = len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)})
    n, chars = len(words), sum(map(len, words))
    return not (n < 50 or 100 * again > 50 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n or 2 * text.count("!") > n
                or 100 * sum(c.isupper() for c in text) > 40 * chars or chars > 12 * n or 2 * chars < 5 * n
                or 2 * (len(lines) - len(set(lines))) > len(text.split("\n")))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_run_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if good(t or "")}
    holders = defaultdict(set)
    for i, t in docs.items():
        for k in line_dedup.line_keys(t):
            if len(k.decode()) >= 40:
                holders[k].add(i)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    docs = {i: "\n".join(x for x, k in zip(t.split("\n"), line_dedup.line_keys(t)) if keeper.get(k, i) == i) for i, t in docs.items()}
    ids = sorted(docs)
    prints = dict(zip(ids, (int(x) for x in simhash.fingerprints_of([docs[i] for i in ids]))))
    top = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    docs = {i: docs[i] for i in ids if top[i] == i}
    items = [decontam.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not any(decontam.least_distance(x, decontam.plain(t)) <= decontam.budget(x) for x in items)}
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = set()
    for i, t in docs.items():
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        want |= {(i, p, a, min(2048, n - a)) for p, a in enumerate(range(0, n, 2048))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in rows} == want and len(rows) == len(want)


def test_stages_return_the_columns_of_documents(spark, table, clashes):
    df = table([(1, "one two"), (None, None), (2, "")], **clashes)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns
