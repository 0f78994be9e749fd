"""Edit matching against a full dynamic programme."""

import random

import pytest

from logsieve.llm import decontam as D


def slow(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edit(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1:], text[:at] + "z" + text[at:], text[:at] + "z" + text[at + 1:]])
    return text


def test_distance_matches_the_full_table():
    rng = random.Random(0)
    for _ in range(300):
        item = "".join(rng.choice("abc é") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text += edit(rng, item, 3) + text
        assert D.least_distance(item, text) == slow(item, text)


def test_pieces_cover_the_item():
    for n in (1, 16, 17, 333):
        item = "x" * n
        parts = D.pieces(item, D.budget(item))
        assert len(parts) == n // 16 + 1 and "".join(p for _, p in parts) == item


def test_search_finds_exactly_what_is_within_budget():
    rng = random.Random(3)
    items = [(k, D.plain(" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(rng.randint(3, 30))))) for k in range(12)]
    search = D.Searcher(items, 16)
    hits = 0
    for _ in range(150):
        k, item = rng.choice(items)
        text = D.plain("aa bb " + edit(rng, item, rng.randint(0, 2 + len(item) // 12)) + " cc " + edit(rng, rng.choice(items)[1], 1))
        want = [(j, slow(x, text)) for j, x in items if slow(x, text) <= D.budget(x)]
        assert search.find(text) == want
        hits += len(want)
    assert hits > 100


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "The quick, brown fox jumps over the lazy dog near the river bank"), (2, None), (3, " !"), (None, "unnamed"), (4, "Été"),
            (1, "A second text under the same number, long enough to be found")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_matches_and_cases(table, bench, clashes):
    leak = "so the QUICK brown fox jumps over -- the lazy dog near the river bank."
    rows = [(1, leak), (2, "x " * 50_000 + leak), (3, leak.replace("jumps", "jumped")), (4, "nothing here"), (5, None), (6, ""), (None, leak), (1, leak),
            (7, "un été chaud"), (8, leak[:40]), (9, "a second text under the same number long enough to be found")]
    got = sorted((repr(r.doc_id), r.item_id, r.edits) for r in D.matches(table(rows, **clashes).repartition(3), bench).collect())
    want = sorted([("1", 1, 0), ("1", 1, 0), ("2", 1, 0), ("3", 1, 2), ("None", 1, 0), ("7", 4, 0), ("9", 1, 0)])
    assert got == want
    in_blocks = D.matches(table(rows), bench, block_chars=10)       # a block for each item
    assert sorted((repr(r.doc_id), r.item_id, r.edits) for r in in_blocks.collect()) == want
    for block_chars in (10, 10 ** 6):
        kept = D.without_leaks(table(rows, _dirty="x", **clashes), bench, block_chars=block_chars)
        assert kept.columns == table([], _dirty="x", **clashes).columns
        assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8]


def test_ids_of_any_type(spark, table):
    items = spark.createDataFrame([("a/1", "some words that are in the text"), ("b", "others")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "Some words that are, in the text!"), ("y", "none")], "doc_id string, text string")
    assert [tuple(r) for r in D.matches(docs, items).collect()] == [("x", "a/1", 0)]
    assert [r.doc_id for r in D.without_leaks(docs, items).collect()] == ["y"]


def test_empty_sides(spark, table, bench):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.matches(table([]), bench).count() == 0
    assert D.matches(table([(1, "a")]), none).count() == 0
    assert D.without_leaks(table([(1, "a")]), none).count() == 1


def test_all_planted_passages_are_found(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id for r in D.matches(docs, items).collect()}
    texts = [r.text for r in items.collect()]
    assert got == {r.doc_id for r in docs.collect() if any(t in r.text for t in texts)} and got
