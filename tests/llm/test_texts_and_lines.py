"""Line dedup against a plain version, and its filters."""

import random
from collections import defaultdict

import numpy as np
import pytest

from logsieve.llm import line_dedup as L


def plain(rows, min_chars, min_docs):
    held = defaultdict(set)
    for i, t in rows:
        for k in L.line_keys(t):
            if i is not None and len(k.decode()) >= min_chars:
                held[k].add(i)
    keeper = {k: max(ids) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, L.line_keys(t)) if i is None or keeper.get(k, i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(df, **kw):
    rows = L.dedup_lines(df, **kw).select("_row.doc_id", "_cut.*").collect()
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows], key=repr)


def test_lines_match_a_plain_version(table, clashes):
    rng = random.Random(4)
    lines = [f" Line number {k} is shared é\t" for k in range(8)] + ["short", "", "x" * 30, "É" * 20 + "a", "é" * 20 + "A"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, lines[0]), (None, None), (200, None), (201, ""), (202, "\n".join(lines * 300)), (3, rows[3][1]), (3, rows[3][1])]
    got = run(table(rows, **clashes).repartition(7), min_chars=20, min_docs=5, bits=1 << 20)
    assert got == plain(rows, 20, 5)
    assert any(r[3] for r in got)
    joined = run(table(rows, **clashes).repartition(7), min_chars=20, min_docs=5, bits=1 << 20, most_sent=0)
    assert joined == got


def test_a_tiny_filter_only_costs_work(table):
    rows = [(i, "\n".join(f"a line of this document {i % 7} {j}" for j in range(40))) for i in range(30)]
    old, L.HASHES = L.HASHES, 1
    try:
        assert run(table(rows).repartition(3), min_chars=10, min_docs=4, bits=1 << 20) == plain(rows, 10, 4)
    finally:
        L.HASHES = old


def test_empty_table_and_size(table):
    assert run(table([])) == []
    with pytest.raises(ValueError):
        run(table([(1, "a")]), bits=1000)


def test_a_key_of_two_tasks_is_in_the_merged_filter():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    a, b = L.Pair(L.SEGMENT), L.Pair(L.SEGMENT)
    a.add(hashes[:300])
    b.add(hashes[200:])
    twice = a.twice | b.twice | (a.once & b.once)
    assert L.Pair.has(twice, L.places(hashes[200:300], L.SEGMENT)).all()
    assert L.Pair.has(twice, L.places(hashes[:200], L.SEGMENT)).mean() < 0.05
    a.add(np.repeat(hashes[:1], 2))
    assert L.Pair.has(a.twice, L.places(hashes[:1], L.SEGMENT)).all()


@pytest.mark.parametrize("n", [0, 5, 5000, 40000])
def test_segments_pack(n):
    part = np.zeros(L.SEGMENT >> 3, np.uint8)
    L.Pair.put(part, np.random.default_rng(n).integers(0, L.SEGMENT, n))
    assert (L._unpack(L._pack(part)) == part).all()


def test_the_documents_lose_only_what_all_merge_steps_agree_on(table, monkeypatch):
    rows = [(i, f"this line is in every one of the documents, number\nown {i}") for i in range(40)]
    monkeypatch.setattr(L, "FAN_IN", 3)
    assert run(table(rows).repartition(16), min_chars=40, min_docs=5, bits=1 << 21) == plain(rows, 40, 5)
