"""Golay keys in every case; fingerprints and classes against plain versions."""

import random

import numpy as np
import pytest

from logsieve.llm import simhash as S
from logsieve.llm.components import components


def classes(prints):
    """doc -> smallest doc reachable over at most two differing bits."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_words_within_two_bits_share_a_golay_key():
    table = S.key_errors()
    words = np.arange(2048)                 # one of each coset: the rest is the same up to a codeword
    base = S.golay_keys(words, table)
    assert sorted(set((base >= 0).sum(axis=1).tolist())) == [1, 6]
    for i in range(23):
        for j in range(i + 1):
            other = S.golay_keys(words ^ (1 << i) ^ (1 << j if j < i else 0), table)
            assert ((base[:, :, None] == other[:, None, :]) & (base[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprints_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    table = S.key_errors()
    fp = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    keys = [set(S.fuzzy_keys(fp[i:i + 1], table)[1].tolist()) for i in range(len(fp))]
    for i in range(64):
        for j in range(i, 64, 5):
            other = fp ^ np.uint64(1 << i) ^ np.uint64(0 if i == j else 1 << j)
            row, key = S.fuzzy_keys(other, table)
            for k in range(len(fp)):
                assert keys[k] & set(key[row == k].tolist())


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_lose_nothing(spark, bucket):
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:40]:
        for _ in range(8):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp bigint").repartition(5)
    edges = S.links(df, pair_bucket=bucket)
    assert edges.filter("bit_count(a ^ b) > 2 or a >= b").count() == 0
    root = {r.node: r.root for r in components(edges).collect()}
    got = {f: root.get(v, v) for f, v in signed.items()}
    want = classes(fps if isinstance(fps, dict) else {f: f for f in fps})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == g) for g in set(m.values()))
    assert groups(got) == groups(want)


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2300) for i in range(200)]
    edges = chain + star + chain[:50]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {2000 + i: 2000 for i in range(1, 200)} | {2300: 2000}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_fingerprint(text):
    import xxhash
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_match_a_plain_version(spark):
    texts = [None, "", " \n", "One", "One two", "A b c", "a  B\tc\x0bd é\x1fx y", "the cat the cat the cat the", "x y z " * 70000, "é É ñ 中 文"]
    assert [int(x) for x in S.fingerprints_of(texts)] == [slow_fingerprint(t) for t in texts]
    row = spark.sql("select xxhash64('the cat the') as h").first()
    import xxhash
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"the cat the", 42)      # the usual function of that seed


def near(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def test_classes_of_documents(table, clashes):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(12)]
    rows = [(k, base[k % 12] if k % 3 else near(rng, base[k % 12])) for k in range(90)]
    rows += [(500, None), (501, ""), (502, " \t"), (None, base[0]), (None, "alone in its class, without an id"), (7, rows[7][1])]
    got = S.near_duplicates(table(rows, **clashes).repartition(6)).collect()
    assert len(got) == len(rows)
    prints = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    want = classes(prints)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted(repr(r.component_id) for r in got if r.doc_id is None) == sorted([repr(want[min(i for i in prints if prints[i] == slow_fingerprint(base[0]))]), "None"])
    assert S.near_duplicates(table([])).count() == 0


def test_one_document_of_each_class_stays(table, clashes):
    rows = [(5, "same words in here"), (2, "same words in here"), (2, "same words in here"), (9, "other things altogether, nothing alike"), (None, "same words in here")]
    df = S.keep_one(table(rows, **clashes))
    assert df.columns == table([], **clashes).columns
    assert sorted(repr(r.doc_id) for r in df.collect()) == ["2", "9", "None"]


def test_no_text_is_lost_where_an_id_has_several(table):
    a, b = "first text with words of its own", "second thing, nothing in common here"
    rows = [(1, a), (1, b), (2, b), (3, a), (1, a)]
    assert sorted((r.doc_id, r.text) for r in S.keep_one(table(rows)).collect()) == [(1, a), (1, b)]
