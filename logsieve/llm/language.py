"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Every word, in lower case between marks, gives its character n-grams; an n-gram's hash names a row of the embedding
table, and a text is the average over all its n-grams. Table and softmax are trained by stochastic gradient descent.
Averaging is linear, so for scoring the table is folded with the softmax into one small row per hash, and all n-grams
of the different words of a batch are scored at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.texts import longest_within, shipped, slices

UNKNOWN = "und"
BUCKETS = 1 << 15
WIDTH = 16
SIZES = (1, 2, 3, 4)        # of the n-grams
SAMPLE_BYTES = 1 << 26      # that the fitted texts have together, at most; the longest are left out where they pass it
ROWS_PER_LANGUAGE = 200     # the sample that is fitted has about so many labelled texts of each language
LEAST_STEPS = 300           # of gradient descent, however few the examples
CHUNK_WORDS = 60            # training examples are so many consecutive words
ACCURACY = 0.99             # of what is not rejected, on held-back examples

#: Every ASCII character but letters becomes a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def bag_of_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words with a letter, word numbers of all texts, text of each).

    White space, ASCII digits and punctuation separate words.
    """
    plain = pa.array([(t or "").lower().encode().translate(_LETTERS) for t in texts.to_pylist()], pa.large_binary()).cast(pa.large_string())
    cut = pc.utf8_split_whitespace(plain)
    words = cut.flatten().dictionary_encode()
    known = words.dictionary.to_pylist()
    good = np.array([w.isascii() and w != "" or any(c.isalpha() for c in w) for w in known], bool)
    number = np.cumsum(good) - 1
    codes = words.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    keep = good[codes] if len(codes) else np.zeros(0, bool)
    return [w for w, g in zip(known, good) if g], number[codes[keep]], text[keep]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, word by word, and where each word's end)."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))      # characters to the word's end
    owners, hashes = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), 0x9E3779B97F4A7C15 + n & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in range(n):
            h = (h ^ chars[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        owners.append(owner[at])
        hashes.append((h % np.uint64(BUCKETS)).astype(np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.cumsum(np.bincount(owner, minlength=len(words)))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray               # (buckets, languages): embeddings folded with the softmax
    bias: np.ndarray
    sharpness: float = 1.0          # 1 / temperature
    threshold: float = 0.0          # scores below are not accepted

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logits of each text, number of its n-grams)."""
        words, number, text = bag_of_words(texts)
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if words:
            hashes, ends = ngrams(words)
            starts = np.concatenate([[0], ends[:-1]])
            own = np.add.reduceat(self.table[hashes], starts, axis=0)
            counts = ends - starts
            n = np.bincount(text, counts[number], len(texts))
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(text, own[number, k], len(texts))
        return total / np.maximum(n, 1)[:, None] + self.bias, n

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, its probability, whether the text has a letter)."""
        z, n = self.logits(texts)
        p = softmax(self.sharpness * z)
        return p.argmax(axis=1), p.max(axis=1), n > 0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def chunks(text: str) -> list[str]:
    words = text.split()
    return [" ".join(words[a:a + CHUNK_WORDS]) for a in range(0, len(words), CHUNK_WORDS)]


def fit(texts: list[str], langs: list[str], epochs: int = 3, batch: int = 32, rate: float = 4.0, seed: int = 5) -> Model:
    """Trains on four fifths of the texts and calibrates on the rest."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    back = rng.random(len(texts)) < 0.2
    parts = [[(c, languages.index(g)) for t, g, b in zip(texts, langs, back) if b == held for c in chunks(t)] for held in (False, True)]
    train = parts[0] or parts[1]
    words, number, text = bag_of_words(pa.array([c for c, _ in train], pa.large_string()))
    y = np.array([k for _, k in train])
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    if words:
        hashes, ends = ngrams(words)
        starts = np.concatenate([[0], ends[:-1]])
        sizes = np.bincount(text, minlength=len(train))
        firsts = np.cumsum(sizes) - sizes
        each = -(-len(train) // batch)
        epochs = max(epochs, -(-LEAST_STEPS // each))
        steps = epochs * each
        done = 0
        for _ in range(epochs):
            order = rng.permutation(np.flatnonzero(sizes))
            for a in range(0, len(order), batch):
                rows = order[a:a + batch]
                own = np.concatenate([number[firsts[r]:firsts[r] + sizes[r]] for r in rows])
                of = np.repeat(np.arange(len(rows)), sizes[rows])
                counts = ends[own] - starts[own]
                grams = hashes[np.repeat(starts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
                of = np.repeat(of, counts)
                n = np.bincount(of, minlength=len(rows))
                # a text as counts of the n-grams it has: one small matrix, no scatter into the table
                used, grams = np.unique(grams, return_inverse=True)
                weight = np.bincount(of * len(used) + grams, minlength=len(rows) * len(used)).reshape(len(rows), -1) / n[:, None]
                mean = weight @ table[used]
                delta = softmax(mean @ out + bias)
                delta[np.arange(len(rows)), y[rows]] -= 1
                step = rate * (1 - done / steps) / len(rows)
                back_ = delta @ out.T
                out -= step * mean.T @ delta
                bias -= step * delta.sum(axis=0)
                table[used] -= step * 10 * (weight.T @ back_)
                done += 1
    model = Model(languages, (table @ out).astype(np.float32), bias)
    return calibrate(model, parts[1] or parts[0])


def calibrate(model: Model, held: list[tuple[str, int]]) -> Model:
    """Sets the sharpness of least log loss, and the lowest threshold whose accepted examples are right often enough."""
    z, n = model.logits(pa.array([c for c, _ in held], pa.large_string()))
    z, y = z[n > 0], np.array([k for _, k in held])[n > 0]
    if not len(y):
        return model
    grid = [2.0 ** (k / 2) for k in range(-6, 11)]
    model.sharpness = min(grid, key=lambda s: -np.log(softmax(s * z)[np.arange(len(y)), y] + 1e-12).mean())
    p = softmax(model.sharpness * z)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= ACCURACY)
    model.threshold = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def sample_of(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """About `rows_per_language` labelled texts of each language, whole, chosen by a hash of their id; `SAMPLE_BYTES` at most."""
    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row per language
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(rows_per_language / n)).otherwise(chance)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(drawn < chance).select("text", "lang")
    rows = chosen.filter(F.octet_length("text") <= longest_within(chosen, "text", SAMPLE_BYTES)).collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of each whole text.

    A null text and one without letters are `und` with score 0 and not accepted. The score is the calibrated
    probability of the predicted language; `accepted` is whether it reaches the threshold, and a caller that prefers
    no answer to a doubtful one filters on it. Ties go to the first language by name. Every row gives a row; only
    doc_id and text are read, so extra columns cannot clash; an empty table gives no rows.
    """
    sent = shipped(docs.sparkSession, model)        # buckets x languages numbers
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for batch in slices(batches, bytes_each=8_000_000):
            k, p, has = m.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m.languages[i] if h else UNKNOWN for i, h in zip(k, has)]), pa.array(np.where(has, p, 0.0)),
                 pa.array(has & (p >= m.threshold))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {id_type}, lang_pred string, score double, accepted boolean")
