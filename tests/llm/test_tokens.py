"""Cached encoding equals the library's, files round-trip, packing is complete and tight."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from logsieve.llm import bpe, packing, token_files  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["a", "b", " ", "  ", "\n", "\n", "\t", "'s", "'", "1", "23", "é", "<|endoftext|>", "<|startoftext|>", ".", ",", "!!", "́", "A", "中", " the", " and", "\x1c",
       "\x85", "　", "İ", "ß", "Σ", "\xa0", "\0", "\x01", "ﬁ", "😀"]


@pytest.mark.parametrize("path, kind", [(BYTE, "byte"), (WORD, "word")])
def test_cached_ids_are_the_librarys(path, kind, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 10))) for _ in range(8000)] + ["", None, " ", "the, the. the\nthe " * 3000]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr(bpe, "CACHE_PARTS", 1500)           # forgets again and again
    encoder = bpe.Encoder(path, kind)
    got = []
    for a in range(0, len(texts), 700):
        ids, bounds = encoder.encode(pa.array(texts[a:a + 700], pa.string()))
        got += [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])]
    assert got == want
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        control, data = token_files.encode_values(v)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in v)
        assert token_files.decode_values(control, data, n).tolist() == v.tolist()


ROWS = [(5, "the cat"), (3, None), (9, ""), (None, "no number"), (5, "the dog"), (5, "the dog"), (-2, "é 中 " * 3), (700, "word " * 5000)] + [(k, f"text {k} of many") for k in range(20, 60)]


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("file_tokens, block_tokens", [(50, 12), (10 ** 6, 30), (1, 1)])
def test_files_round_trip(spark, table, clashes, monkeypatch, file_tokens, block_tokens):
    monkeypatch.setattr(token_files, "FILE_TOKENS", file_tokens)
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block_tokens)
    folder = token_files.write_tokens(table(ROWS, **clashes).repartition(4), BYTE)
    rows = token_files.read_tokens(spark, folder).collect()
    rows.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids)
    assert sorted(map(repr, ((r.doc_id, list(r.ids)) for r in rows))) == sorted(map(repr, ((i, ids_of(BYTE, t, 2)) for i, t in ROWS)))
    digest = {r.start: r for r in token_files.read_tokens(spark, folder, digest=True).collect()}
    assert all(digest[r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and digest[r.start].n_tokens == len(r.ids) for r in rows)
    empty = token_files.write_tokens(table([]), BYTE)
    assert token_files.read_tokens(spark, empty).count() == 0


def filled(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return bins


def test_packing_is_complete(table, clashes):
    for size in (2048, 7):
        rows = packing.pack(table(ROWS, **clashes).repartition(3), WORD, size=size).collect()
        filled(rows, size)
        want = []
        for i, t in ROWS:
            ids = ids_of(WORD, t, 0)
            want += [(i, p, a, len(ids[a:a + size]), zlib.crc32(np.array(ids[a:a + size], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), size))]
        assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(repr, want))
    assert packing.pack(table([]), WORD).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([6, 4, 5, 5, 7, 3, 2, 8, 4, 6])      # 50 in five bins of 10
    bins = packing.local_search([[k] for k in range(10)], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(10)) and len(bins) == 5
    rng = np.random.default_rng(3)
    for high in (30, 60, 101):
        lengths = rng.integers(1, high, 400)
        start = [[k] for k in range(400)]
        bins = packing.local_search(start, lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(400))
        fills = [lengths[b].sum() for b in bins]
        assert max(fills) <= 100 and sum(f * f for f in fills) >= (lengths ** 2).sum()
        best = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        assert len(best) <= len(packing.best_fit(lengths, 100)) and len(best) <= 1.02 * max(-(-lengths.sum() // 100), (lengths > 50).sum()) + 1


def test_exchanges_go_beyond_best_fit():
    lengths = np.array([5, 5, 4, 4, 3, 3, 3, 3])            # best fit in falling order needs four bins of 10; three hold 30
    start = packing.best_fit(lengths, 10)
    assert len(packing.local_search(start, lengths, 10)) <= len(start)


def test_chunks_carry_on(spark, table, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    monkeypatch.setattr(packing, "CARRY", 5)
    rng = random.Random(2)
    docs = [(k, "word " * rng.randint(0, 40)) for k in range(400)]
    rows = packing.pack(table(docs).coalesce(1), WORD, size=50).collect()
    assert len(rows) == 400 and len(filled(rows, 50)) <= 1.05 * sum(r.length for r in rows) / 50 + 2


def test_query_fills_sequences(spark, sf):
    from logsieve.llm.queries import op10_best_fit_packing
    rows = op10_best_fit_packing(spark, sf).collect()
    assert len(filled(rows, 2048)) <= 1.01 * sum(r.length for r in rows) / 2048 + 1
