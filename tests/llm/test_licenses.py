"""The similarity join against comparing every block with every template."""

import math
import random
import re
import time

from logsieve.llm import licenses as L


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def slow(text, templates, threshold, across=True):
    own = words(text)
    starts, base = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for i in range(len(own) - len(p) + 1):
            if own[i:i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, score = set(base), 1.0 if starts else 0.0
    width = max([L.BLOCK_WORDS, *(2 * len(words(t)) for _, t in templates)])
    for part in [*(text or "").split("\n"), *([text or ""] if across else [])]:
        w = words(part)
        for a in range(0, max(1, len(w)), width // 2):
            block = set(w[a:a + width])
            for label, t in templates:
                t = set(words(t))
                share = len(t & block) / len(t)
                if len(t & block) >= (len(t) if len(t) < L.WHOLE_BELOW else math.ceil(threshold * len(t) - 1e-9)):
                    labels.add(label)
                    score = max(score, share)
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), score


def test_scan_matches_all_pairs():
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in L.TEMPLATES for w in words(t)}) + ["zed", "É", "mit"]
    counts = {w.encode(): rng.randrange(50) for w in vocabulary}
    some = 0
    for threshold in (0.5, 0.8, 1.0):
        join = L.make_join(counts, L.TEMPLATES, threshold)
        for _ in range(150):
            parts = []
            for _ in range(rng.randint(0, 6)):
                t = words(rng.choice(L.TEMPLATES)[1])
                t = [w for w in t if rng.random() < 0.9] + [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 60]))]
                if rng.random() < 0.5:
                    rng.shuffle(t)
                parts.append(rng.choice([" ", ", ", "--"]).join(w.upper() if rng.random() < 0.2 else w for w in t))
            text = rng.choice(["\n", " "]).join(parts)
            got = L.scan(text, join, across=True)
            assert got == slow(text, L.TEMPLATES, threshold)
            assert L.scan(text, join) == slow(text, L.TEMPLATES, threshold, across=False)
            some += len(got[5]) > 0
    assert some > 100


def test_cases(table, clashes):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (None, "cc by-nc"), (4, "x " * 100_000 + "Under the MIT license, under\nthe mit LICENSE"),
            (5, "Apache License, Version 2.0 and CC-BY-NC"), (1, "Released under the MIT License."), (6, "under the mit licenses"), (7, "é中 under the émit license")]
    got = sorted((repr(tuple(r)) for r in L.find_licenses(table(rows, **clashes).repartition(3)).collect()))
    want = sorted(repr((i, *slow(t, L.TEMPLATES, L.THRESHOLD))) for i, t in rows)
    assert got == want
    assert L.find_licenses(table([])).count() == 0


def test_counts_cover_all_documents(table):
    rows = [(k, "MIT mit x license" if k % 3 else None) for k in range(30)]
    assert L.word_counts(table(rows).repartition(5)) == {b"mit": 40, b"license": 20}


def test_query_on_the_documents(spark, sf):
    from logsieve.llm.queries import op5_license_scans
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_license_scans(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, base, first, last, own, labels, score = slow(docs[r.doc_id], L.TEMPLATES, L.THRESHOLD)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (n, base, first, last, ",".join(own), ",".join(labels))
        assert abs(r.score - score) < 1e-12


def test_one_word_tells_short_templates_apart(table):
    wrong = ["Licensed under CC BY 4.0", "Released under the Apache License", "released under the bsd license",
             "Licensed under the GNU General Public License version 2", "licensed under CC-BY"]
    right = {"Licensed under CC BY-NC 4.0": ["cc-by-nc"], "Released under the MIT license": ["mit"], "Licensed under the GNU General Public License, version 3": ["gpl-3"]}
    rows = list(enumerate([*wrong, *right]))
    got = {r.doc_id: r.labels for r in L.find_licenses(table(rows)).collect()}
    assert [got[k] for k in range(len(wrong))] == [[]] * len(wrong)
    assert [got[len(wrong) + k] for k in range(len(right))] == list(right.values())


def test_a_whole_license_as_template():
    rng = random.Random(8)
    license_ = [f"word{rng.randrange(900)}" for _ in range(1500)]
    templates = [*L.TEMPLATES, ("whole", " ".join(license_))]
    join = L.make_join({}, templates)
    text = "\n".join(" ".join(license_[a:a + 9]) for a in range(0, 1500, 9) if rng.random() < 0.95)
    text = "zed " * 3333 + text + " zed" * 5000
    got = L.scan(text, join, across=True)
    assert got[5] == ["whole"] and 0.8 <= got[6] < 1 and got == slow(text, templates, L.THRESHOLD)
    assert L.scan(" ".join(license_[:700]), join, across=True)[5] == []


def test_long_texts_of_phrases_take_time_in_proportion():
    join = L.make_join({})
    text = "under the MIT license " * 400_000
    began = time.perf_counter()
    got = L.scan(text, join, across=True)
    assert got[1:4] == (400_000, 0, 4 * 399_999) and time.perf_counter() - began < 60
